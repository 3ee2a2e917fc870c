"""URL filters: host rules, host word segmentation and a naive Bayes score.

Host rules come first: a rule (host, path prefix) fits its host and every subdomain, the
longest fitting rule wins.  Where none fits, the host's names are split into words by
Viterbi over a unigram model (``cheappillsonline`` is ``cheap pills online``), and multinomial
naive Bayes scores the host's and the path's tokens.

The unigram model is learned from the corpus: ``vocabulary`` counts the words of all pages'
texts and paths, and keeps those that are at least ``least_share`` of all, so at most
1 / least_share of them, whatever the corpus; half of the probability is the labelled
examples'.  What no word explains is a run, which costs by its length.  Two letters are a
word only between longer ones (``houseofcards``): they fit anywhere else.  Naive Bayes is
fitted to the labelled table below, about 230 names and paths; words outside it say nothing.

Work is a map over the rows, with a memo of hosts in each task: no shuffle but that of the
word counts, pre-aggregated, so a hot host costs nothing.  Defined cases: null or no ``://``
gives empty host and path, no rule and what the method says of no tokens (allow); names of any
length are split whole; splits of equal cost go to fewer tokens, log odds of 0 to allow;
repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, per_text, worker_memo

#: The rules of the contract, (host, path prefix, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Labelled names and paths from which both models are fitted.
EXAMPLES = {
    "block": """
        spam farm, casino win, cheap pills, free bets, ads track, poker bonus, online casino, slot jackpot, viagra pharmacy,
        buy pills online, adult video, porn tube, sex cam, xxx movies, hot girls dating, payday loan, quick cash loans,
        click track, ads track pixel, ad server, popup ads, banner ads click, free iphone prize, lottery winner, betting odds, bet win money,
        replica watches, cheap meds, diet pills, weight loss pills, crack keygen, warez torrent, phishing login verify,
        malware download, escort service, gambling spins, free spins bonus, link farm, seo spam, cheap replica bags, hack cheats,
        adult chat, adult movies, adult toys, nude photos, nude webcam, live cams, erotic stories, erotic massage, fetish club, naked girls, hentai, milf,
        roulette, blackjack tips, baccarat, sportsbook, bingo bonus, bookmaker odds, slots jackpot, poker room, vegas casino,
        cialis online, levitra, tramadol, xanax, steroids, pharmacy discount, keto diet, male enhancement, botox deals,
        payday advance, instant loans, credit repair, forex signals, crypto giveaway, bitcoin doubler, make money fast, work from home riches,
        adserver, doubleclick, popunder, tracker pixel, clickbait, affiliate clicks, backlinks, traffic exchange, banner exchange, telemetry,
        torrents, nulled scripts, serial keys, cracked software, keylogger, trojan, ransomware, spyware, fake login, account verify,
        counterfeit, fake watches, replica handbags, fake diploma, essay writing cheap, spam mailer, bulk email, gift cards free
    """,
    "allow": """
        news, daily news, science journal, city library, university research, open source project, cooking recipes, travel guide,
        history museum, health care clinic, public school, weather report, local news, music review, book club, garden tips,
        math forum, developer docs, software engineering blog, football club, art gallery, film festival, government services,
        community forum, photo archive, language learning, world atlas, bird watching, chess club, economics review,
        blog post, article, wiki page, about us, contact, documentation, tutorial, support help, index html,
        shop online, free library, win award, cheap flights, health pills facts, family farm,
        adult education, adult literacy class, free lessons, online course, dating fossils, loan desk library, fast trains, money museum, live music,
        bus tickets, train station, airport guide, hotel reviews, city council, parliament, court records, tax office, police department, fire service,
        hospital, nursing school, dental practice, pharmacy college, medicine journal, physics, chemistry, biology, astronomy, geology, mathematics,
        poetry, novels, theatre, opera house, orchestra, painting, photography club, architecture, design studio, craft market,
        bakery, restaurant menu, coffee house, farmers market, wine tasting, hiking trails, cycling, running club, swimming pool, tennis,
        insurance advice, bank branch, accounting, business weekly, finance news, jobs board, career advice, real estate, furniture, hardware store,
        kindergarten, college admissions, student union, alumni, church, charity, volunteer, wildlife park, forestry, water quality,
        data archive, computer science, programming, linux kernel, compiler, database, statistics, translation, dictionary, encyclopedia
    """,
}


#: Words of structure: they say nothing about what a host holds.
NEUTRAL = frozenset("www m mobile wap amp web site home blog blogs post posts article articles index page pages html htm php asp aspx jsp static cdn img".split())
#: Names that stand for a part of a site when they are a subdomain.
PARTS = NEUTRAL | frozenset("news shop store forum community docs wiki help support contact about mail media photo archive".split())


#: Share of all words that one must have to be in the vocabulary.
LEAST_SHARE = 5e-6
#: What isn't text in a page.
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>|&\w+;"


def vocabulary(pages: DataFrame, url_col="url", html_col="html", least_share: float = LEAST_SHARE) -> dict[str, int]:
    """Counts of the common words of all pages' texts and paths: at most 1 / least_share."""
    path = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "://[^/?#]*([^?#]*)", 1)
    text = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), MARKUP, " ")
    words = pages.select(F.explode(F.split(F.lower(F.concat_ws(" ", text, path)), "[^a-z]+")).alias("w")).where(F.length("w").between(2, 24))
    counts = materialise(words.groupBy("w").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {r.w: r.n for r in counts.where((F.col("n") >= 2) & (F.col("n") >= least_share * total)).collect()}


WORD, SHORT, RUN, BEGIN = range(4)


class HostModel:
    """Unigram word model for segmentation and multinomial naive Bayes over the examples' words."""

    def __init__(self, counts: dict[str, int] | None = None, examples: dict[str, str] = EXAMPLES, start: float = 10.0, unknown: float = 2.0):
        texts = {k: [t.split() for t in v.replace("\n", " ").split(",")] for k, v in examples.items()}
        own = Counter(w for ts in texts.values() for t in ts for w in t)
        counts, share = counts or {}, 0.5 if counts else 1.0
        n, total = sum(own.values()), max(1, sum(counts.values()))
        self.cost = {w: -math.log(share * own[w] / n + (1 - share) * counts.get(w, 0) / total) for w in own.keys() | counts.keys() if len(w) > 1}
        self.longest = max(map(len, self.cost))
        self.start, self.unknown = start, unknown
        self.prior = {k: math.log(len(v) / sum(map(len, texts.values()))) for k, v in texts.items()}
        self.like = {}
        for k, ts in texts.items():
            c = Counter(w for t in ts for w in t)
            size = sum(c.values())
            self.like[k] = {w: math.log((c[w] + 0.5) / (size + 0.5 * len(own))) for w in own}

    def segment(self, name: str) -> list[str]:
        """The cheapest split of ``name`` into words and runs of unknown characters.  A run is one token and
        costs ``start`` and ``unknown`` a character; words of two letters stand between longer ones only."""
        # per end and kind of the last token: (cost, tokens, where that token starts, kind before it)
        best: list[dict[int, tuple]] = [{BEGIN: (0.0, 0, 0, BEGIN)}]
        for end in range(1, len(name) + 1):
            found: dict[int, tuple] = {}

            def offer(kind, way, found=found):
                if kind not in found or way < found[kind]:
                    found[kind] = way

            for start in range(max(0, end - self.longest), end - 1):
                c = self.cost.get(name[start:end])
                if c is None:
                    continue
                kind = SHORT if end - start == 2 else WORD
                for before, (cost, tokens, _, _) in best[start].items():
                    if kind == WORD or before == WORD:
                        offer(kind, (cost + c, tokens + 1, start, before))
            for before, (cost, tokens, start, first) in best[end - 1].items():
                if before == RUN:
                    offer(RUN, (cost + self.unknown, tokens, start, first))
                elif before != SHORT:
                    offer(RUN, (cost + self.start + self.unknown, tokens + 1, end - 1, before))
            best.append(found)
        out, end = [], len(name)
        kind = min((way[:2], k) for k, way in best[end].items() if k != SHORT)[1]
        while end:
            _, _, start, before = best[end][kind]
            out.append(name[start:end])
            end, kind = start, before
        return out[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        """Segmented names of the host, but the last (the registry's), and of the path."""
        names = re.findall(r"[^\W_]+", host.rpartition(".")[0] if "." in host else host) + re.findall(r"[^\W\d_]+", path.lower())
        return [w for x in names for w in self.segment(x)]

    def score(self, host: str, path: str) -> float:
        """log odds of block; a token unknown to both classes says nothing, nor does structure."""
        labels = host.split(".")
        while len(labels) > 2 and labels[0] in PARTS:
            del labels[0]
        host = ".".join(labels)
        s = self.prior["block"] - self.prior["allow"]
        for w in self.tokens(host, path):
            if w in self.like["block"] and w not in NEUTRAL:
                s += self.like["block"][w] - self.like["allow"][w]
        return s


@lru_cache(1)
def model() -> HostModel:
    """The model without a corpus: the examples' words only."""
    return HostModel()


def split_url(url: str) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    m = re.match(r"[^/?#]*", rest)
    host = m[0]
    path = re.match(r"[^?#]*", rest[m.end() :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def fitting_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def judge(pages: DataFrame, rules=RULES, counts: dict[str, int] | None = None, id_col="page_id", url_col="url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row; score is the method's log odds of block.
    counts: the corpus' common words, of ``vocabulary``."""
    name = uuid.uuid4().hex
    sent = pages.sparkSession.sparkContext.broadcast(counts or {})  # at most 1 / least_share words
    names = {"host": "string", "path": "string", "rule": "string", "verdict": "string", "score": "double"}

    def make():
        m, score = worker_memo(("url", name), lambda: (lambda m: (m, lru_cache(100_000)(m.score)))(HostModel(sent.value)))

        def one(url):
            host, path = split_url(url)
            s = score(host, path) if len(host) + len(path) < 2000 else m.score(host, path)  # the memo keeps short ones
            rule, verdict = fitting_rule(host, path, rules) or (None, "block" if s > 0 else "allow")
            return host, path, rule, verdict, s

        def f(urls):
            rows = [one(u) for u in urls]
            return {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return f

    return per_text(pages, make, names, id_col, url_col).withColumnRenamed("doc_id", "page_id")
