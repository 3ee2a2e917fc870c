import hashlib
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeframe.llm import ann, bpe, html_text, langid, license, lm, neardup, packing, quality, url_filter

from .cases import ROWS, SF, awkward, documents, empty, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLIP = public_tokenizers.path("word_bpe_49k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def docs_of(spark, which):
    return awkward(spark) if which == "awkward" else spark.read.parquet(f"{SF}/documents.parquet")


def plain(which):
    return [r[:4] for r in ROWS] if which == "awkward" else documents()


both = pytest.mark.parametrize("which", ["awkward", "sf"])


# 1 packing
@both
def test_packing_covers_every_id_once(spark, which):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(CLIP)
    want = Counter()
    for d, t, *_ in plain(which):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes()) if len(ids) <= 4096 else zlib.crc32(ids[:4096].tobytes())] += 1
    out = rows(packing.pack(docs_of(spark, which), CLIP))
    got = Counter((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in out if r["start"] == 0)
    assert got == want
    tokens = sum(k[1] * v for k, v in want.items())
    assert sum(r["length"] for r in out) == tokens
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    if which == "sf":
        assert len(bins) * 4096 < 1.02 * tokens + 4096


def test_packing_reads_back_the_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(CLIP)
    out = defaultdict(list)
    for r in rows(packing.pack(docs_of(spark, "sf"), CLIP, with_ids=True)):
        out[r["doc_id"]].append((r["start"], r["ids"]))
    for d, t, *_ in documents():
        ids = [i for _, p in sorted(out[d]) for i in p]
        assert ids == tok.encode(t, add_special_tokens=False).ids + [2]


@given(st.lists(st.integers(1, 100), max_size=80))
@settings(max_examples=60, deadline=None)
def test_first_fit_decreasing_is_first_fit(lengths):
    bins, _ = packing.first_fit_decreasing(lengths, 100)
    free = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        j = next((j for j, f in enumerate(free) if f >= lengths[i]), None)
        if j is None:
            j = len(free)
            free.append(100)
        free[j] -= lengths[i]
        assert bins[i] == j


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_word_encoder_is_the_tokenizer(text):
    enc = packing.encoder(CLIP)
    want = np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert enc.batch([text]) == [want]


#: Words that lower-casing and NFC change in number of characters or pieces.
ODD_WORDS = ["IT'S", "hello", "İ1", "world", "ŉ", "ǰ", "N'T", "a'S", "'S'", "ΑΣ", "é'RE", "ﬁx", "Å", "12'Ll", "don't", "DON'T", "\u0301a", "ß", "Ǆ1", "it’s", "x<|endoftext|>y", "e\u0301", "İ'S"]


@given(st.permutations(ODD_WORDS))
@settings(max_examples=100, deadline=None)
def test_word_encoder_in_any_order(words):
    enc = packing.encoder(CLIP)
    enc.memo = {}
    text = " ".join(words)
    assert enc.batch([text]) == [np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_word_encoder_under_any_hash_seed(seed):
    code = "import sys; from gaugeframe.llm.packing import WordEncoder as E; e = E(sys.argv[1]); t = sys.argv[2]; w = e.plain([t]); sys.exit(e.batch([t]) != w)"
    ran = subprocess.run([sys.executable, "-c", code, CLIP, " ".join(ODD_WORDS)], env=os.environ | {"PYTHONHASHSEED": str(seed)}, cwd=Path(__file__).parents[2])
    assert ran.returncode == 0


def test_packing_spreads_equal_rows_and_one_long_text(spark):
    df = spark.createDataFrame([(1, "same words")] * 900 + [(2, "long " * 60000)], "doc_id long, text string")
    out = rows(packing.pack(df, CLIP, group_pieces=100))
    groups = Counter(r["sequence_id"] >> 32 for r in out)
    assert len(groups) == 10 and max(groups.values()) < 150
    assert sorted((r["start"], r["length"]) for r in out if r["doc_id"] == 2)[-1][0] == 14 * 4096 and len(out) == 915


# 2 URL filters
def test_url_rules():
    f = lambda u: (lambda hp: (*hp, url_filter.fitting_rule(*hp)))(url_filter.split_url(u))
    assert f("http://www.Example.com/en/1?x#y") == ("www.example.com", "/en/1", ("www.example.com/en/", "allow"))
    assert f("http://m.example.com/en/1")[2] == ("example.com/en/", "block")
    assert f("https://a.net/es/")[2] == ("net/es/", "block")
    assert f("https://anet/es/")[2] is None
    assert f("https://x.com")[1:] == ("", None)
    assert f("https://x.com?q=/en/")[:2] == ("x.com", "")
    assert f("no scheme") == ("", "", None)
    assert f("http://a://b/c") == ("a:", "//b/c", None)


def test_segmentation():
    m = url_filter.model()
    assert m.segment("cheappillsonline") == ["cheap", "pills", "online"]
    assert m.segment("thadsen") == ["thadsen"]
    assert "".join(m.segment("qqqcasinozz")) == "qqqcasinozz"
    assert m.segment("") == []
    for host in ("spam-farm.example.org", "www.casino-win.example.org", "m.freebets.example.net", "ads-track.example.org", "cheappills.example.net"):
        assert m.score(host, "/en/1") > 0, host
    for host in ("ththre.example.com", "blog.tiontion.example.org", "therer.example.org", "citylibrary.example.org", ""):
        assert m.score(host, "/fr/825") <= 0, host


def every_split(m, name):
    """(cost, tokens, split) of every split by brute force."""

    def go(at, last):
        if at == len(name):
            if last != "short":
                yield 0.0, 0, []
            return
        for end in range(at + 1, len(name) + 1):
            w = name[at:end]
            kinds = [("run", m.start + m.unknown * len(w))] if last not in ("run", "short") else []
            if w in m.cost and (len(w) > 2 or last == "word"):
                kinds.append(("short" if len(w) == 2 else "word", m.cost[w]))
            for kind, cost in kinds:
                for c, n, rest in go(end, kind):
                    yield cost + c, n + 1, [w, *rest]

    return go(0, "begin")


def cost_of(m, name, split):
    return min(c for c, _, s in every_split(m, name) if s == split)


@given(st.lists(st.sampled_from(["home", "and", "garden", "of", "in", "cards", "house", "news", "new", "the", "x", "qz", "times"]), max_size=4))
@settings(max_examples=150, deadline=None)
def test_segmentation_by_exhaustion(parts):
    m = url_filter.HostModel({"home": 500, "and": 9000, "garden": 300, "of": 9500, "in": 9100, "cards": 90, "house": 400, "new": 2000, "york": 100, "times": 300, "the": 20000, "news": 300})
    name = "".join(parts)[:12]
    got = m.segment(name)
    cost, tokens, _ = min(((round(c, 9), n, s) for c, n, s in every_split(m, name)))
    assert "".join(got) == name and round(cost_of(m, name, got), 9) == cost and len(got) == tokens


def test_vocabulary_from_the_corpus(spark):
    text = "the home and garden pages of the new york times, and a house of cards in the garden <b class=casino>by</b> the home "
    df = spark.createDataFrame([(i, f"http://x.org/{'poker' if i else 'home'}/", f"<p>{text * 30}</p><script>var spamword</script>") for i in range(2)] + [(2, None, None)], "page_id long, url string, html string")
    counts = url_filter.vocabulary(df)
    assert counts["garden"] == 120 and counts["home"] == 121 and "casino" not in counts and "spamword" not in counts and "a" not in counts
    m = url_filter.HostModel(counts)
    assert m.segment("homeandgarden") == ["home", "and", "garden"] and m.segment("thenewyorktimes") == ["the", "new", "york", "times"]
    assert m.segment("houseofcards") == ["house", "of", "cards"] and m.segment("zzofqq") == ["zzofqq"]
    long = "x" * 392 + "onlinecasinopoker" + "y" * 700
    assert "casino" in m.segment(long) and m.segment("") == []
    clashing = df.withColumns({c: F.lit("x") for c in ("w", "n", "doc_id", "text", "host", "path", "rule", "verdict", "score")})
    assert url_filter.vocabulary(clashing) == counts and url_filter.judge(clashing, counts=counts).count() == 3
    assert url_filter.vocabulary(df.limit(0)) == {}


def test_structure_does_not_outweigh_a_name():
    m = url_filter.model()
    for sub in ("", "blog.", "www.", "m.", "news.", "www.blog.", "shop."):
        for name in ("adult-x", "casino-win", "cheappills", "nudewebcam"):
            assert m.score(f"{sub}{name}.example.net", "/blog/1.html") > 0, (sub, name)
        for name in ("citylibrary", "adult-education", "poetry", "thadsen"):
            assert m.score(f"{sub}{name}.example.net", "/blog/1.html") <= 0, (sub, name)


def test_url_query_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (None, "http://a.net/es/"), (2, ""), (2, ""), (3, "http://" + "x" * 100000)], "page_id long, url string")
    got = {(r["page_id"], r["verdict"], r["rule"]) for r in rows(url_filter.judge(df))}
    assert (1, "allow", None) in got and (None, "block", "net/es/") in got
    assert url_filter.judge(df.limit(0)).count() == 0


# 3 ANN
def test_ann_recall_and_distances(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, np.float64) for r in v.collect()}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    got = defaultdict(list)
    for r in rows(ann.search(v)):
        got[r["query_id"]].append(r)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - data[q]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        mine = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        for r in mine:
            assert abs(r["score"] - np.linalg.norm(data[r["vec_id"]] - data[q])) < 1e-12
        hits += len(set(want) & {r["vec_id"] for r in mine})
        total += 10
    assert hits / total >= 0.9


def test_ann_edge_cases(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, nan]), (4, [1.0, None]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (None, [1.0, 1.0]), (100, [1.0, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows(ann.search(df)))
    assert got == [(0, 1, 5), (0, 2, 6), (0, 3, 100), (100, 1, 0), (100, 2, 5), (100, 3, 6)]
    assert ann.search(df.limit(0)).count() == 0
    hot = spark.range(3000).selectExpr("id as vec_id", "array(1.0f, 2.0f) as embedding")
    got = [r["vec_id"] for r in sorted(rows(ann.search(hot).where("query_id = 0")), key=lambda r: r["rank"])]
    assert got == list(range(1, 11))


def test_ann_repeated_rows_and_clashing_columns(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [1.0, 0.1]), (3, [1.0, 0.1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for c in ("row", "shard", "asks", "v", "score", "rank", "query_id", "n"):
        df = df.withColumn(c, F.lit("x"))
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in rows(ann.search(df)))
    near, far = round(0.1, 6), round(2**0.5, 6)
    other = round((1 + 0.81) ** 0.5, 6)
    want = Counter({(0, 1, 0, 0.0): 2, (0, 2, 3, near): 2, (0, 3, 3, near): 2, (0, 4, 0, far): 2, (0, 1, 3, other): 1, (0, 2, 3, other): 1, (0, 3, 0, far): 1})
    want[0, 4, 0, far] += 1
    assert got == want


def test_ann_does_not_depend_on_shards(spark):
    """Small shards search each for itself; their lists join."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    one, many = (Counter((r["query_id"], r["vec_id"]) for r in rows(ann.search(df, shard_rows=s))) for s in (65536, 50))
    assert sum((one & many).values()) >= 0.9 * sum(one.values())


def test_forest_levels():
    """The halved search finds the level that ascending bit by bit stops at; prefixes are those of the strings."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    f = ann.HashPrefixForest(x, 6)
    keys, own = f.hashes(x[:20]), f.hashes(x)
    stops = f.stops(keys, 120)
    for j in range(20):
        same = np.array([[ann.BITS - int(a ^ b).bit_length() for b in t] for a, t in zip(keys[:, j], own)])
        up = next(u for u in range(ann.BITS + 1) if (same >= ann.BITS - u).sum() >= 120)
        assert stops[j] == up
        assert (f.shared(keys[:, j], up) == np.maximum(same - (ann.BITS - up) + 1, 0).sum(0)).all()


# 4 LM
@both
def test_lm_counts_and_base_score(spark, which):
    data = plain(which)
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, *_ in data]
    toks = [WORDS.findall(lower(t or "")) + [None] for _, t, *_ in data]
    c = Counter(w for h, ts in zip(held, toks) if not h for w in ts)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for (d, *_), h, ts in zip(data, held, toks):
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)
        want[d, h, len(ts), sum(c[w] > 0 for w in ts), n, round(base, 6)] += 1
    out = rows(lm.score_documents(docs_of(spark, which)))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    if which == "sf":
        for held_out in (True, False):
            some = [r for r in out if r["held_out"] == held_out]
            assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)
    assert all(r["score"] < 0 for r in out)


def lm_plain(data, weights):
    """Deleted interpolation token by token: Counter of (id, score), and the tokens put aside."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, *_ in data]
    texts = [WORDS.findall(lower(t or "")) + [lm.END] for _, t, *_ in data]

    def grams(ts):
        c = Counter({("n",): len(ts), lm.START: 1})
        for i, w in enumerate(ts):
            c[w] += 1
            v = ts[i - 1] if i else lm.START
            c[v, w] += 1
            if i:
                c[(ts[i - 2] if i > 1 else lm.START), v, w] += 1
        return c

    def tokens(ts, c, kinds):
        for i, w in enumerate(ts):
            v = ts[i - 1] if i else lm.START
            before = ((ts[i - 2] if i > 1 else lm.START), v) if i else lm.START
            triple = ((ts[i - 2] if i > 1 else lm.START), v, w) if i else (v, w)
            yield lm.estimates(*(np.array([c[k]]) for k in (w, v, (v, w), before, triple)), c["n",], kinds)

    def total(of):
        c = Counter()
        for ts, o in zip(texts, of):
            if o:
                c.update(grams(ts))
        return c, sum(c[k] > 0 for k in c if isinstance(k, (str, bytes)) and k != lm.START)

    every, kinds = total([not h for h in held])
    scores = Counter()
    for (d, *_), h, ts in zip(data, held, texts):
        c = every
        if not h:
            c = Counter(every)
            c.subtract(grams(ts))
        scores[d, round(float(sum(np.log10((weights[r] * p).sum()) for r, p in tokens(ts, c, kinds))), 5)] += 1

    def put_aside(flags):
        c, k = total([not h and not f for h, f in zip(held, flags)])
        found = [x for ts, h, f in zip(texts, held, flags) if f and not h for x in tokens(ts, c, k)]
        return np.concatenate([r for r, _ in found]), np.concatenate([p for _, p in found])

    return scores, put_aside


def some_weights():
    w = np.random.default_rng(1).random((2 * lm.LEVELS, 4))
    w[: lm.LEVELS, 3] = w[0, 2] = 0
    return w / w.sum(1, keepdims=True)


@both
def test_lm_score_by_brute_force(spark, which):
    data = [(d, t[:4000] if t else t) for d, t, *_ in plain(which)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = lm_plain(data, some_weights())[0]
    for sizes in ({}, {"block_bytes": 5000, "bucket_bytes": 2000, "fanout": 3}):  # one block and bucket; many of them, through relays
        out = rows(lm.score_documents(df, weights=some_weights(), **sizes))
        assert Counter((r["doc_id"], round(r["score"], 5)) for r in out) == want


def test_lm_weights_by_brute_force(spark):
    """The EM on the table of cells does as well as the EM on all tokens put aside."""
    data = [(d, t[:3000]) for d, t, *_ in documents() if t]
    df = spark.createDataFrame(data, "doc_id long, text string")
    flags = [r.f for r in df.select((F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(5)) == 0).alias("f")).collect()]
    row, p = lm_plain(data, some_weights())[1](flags)
    weights = lm.expectation_maximisation(row, p, np.ones(len(row)))
    cells = lm.tabulate(row, p)
    n = cells["n"]
    means = np.stack([np.full(len(n), p[0, 0]), *[cells[f"p{j}"] / n for j in (1, 2, 3)]], 1)
    rough = lm.expectation_maximisation(cells["cell"] // lm.BINS**3, means, n)
    best, got = (np.log((w[row] * p).sum(1)).mean() for w in (weights, rough))
    assert got > best - 0.002 * abs(best)
    want = sum(s * k for (_, s), k in lm_plain(data, weights)[0].items())
    assert abs(sum(r["score"] for r in rows(lm.score_documents(df))) / want - 1) < 0.005


def test_lm_tells_texts_that_occur_twice(spark):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{min(rng.zipf(1.2), 3000)}" for _ in range(150))
    data = [(i, text()) for i in range(400)]
    data += [(400 + i, data[i][1]) for i in range(60)]
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in rows(lm.score_documents(spark.createDataFrame(data, "doc_id long, text string")))}
    twice, once = (np.array([out[i] for i in ids if zlib.crc32(str(i).encode()) % 5 != 1]) for ids in (range(60), range(60, 400)))
    assert np.mean([np.mean(t > once) for t in twice]) > 0.75


def test_lm_is_a_distribution():
    """Weights of every row sum to 1, and give nothing to what can't follow."""
    row, p = np.array([lm.LEVELS + 1, 1, 0]), np.array([[1e-3, 0.1, 0.2, 1.0], [1e-3, 0.1, 0.5, 0], [1e-3, 0.2, 0, 0]])
    w = lm.expectation_maximisation(row, p, np.array([5.0, 7.0, 2.0]))
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 2] == 0 and (w[: lm.LEVELS, 3] == 0).all()


def test_lm_packing_of_numbers():
    k = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm.unpack_keys(lm.pack_keys(k)) == k).all()
    c = np.arange(77, dtype=np.uint64) * 2**33  # counts over 32 bits
    assert (lm.unpack_numbers(lm.pack_numbers(c), np.uint64) == c).all()


# 5 quality
@both
def test_quality_base(spark, which):
    want = Counter()
    for d, t, *_ in plain(which):
        t = t or ""
        w = WORDS.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), failed] += 1
    out = rows(quality.line_quality(docs_of(spark, which)))
    keys = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert Counter(tuple(r[k] for k in keys) for r in out) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in out)


def test_quality_removes_common_lines(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    menu = " ".join(f"menu{j}" for j in range(60))
    data = [(i, f"{own(i)}\nhome about contact", None, "h", 0) for i in range(60)]
    data += [(100 + i, f"{menu}\nMENU  {i % 7}", None, "h", 0) for i in range(40)] + [(200 + i, own(1000), None, "h", 0) for i in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["kept"] for r in rows(quality.line_quality(df, min_docs=5, max_share=0.05))}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(40))
    assert all(kept[200 + i] for i in range(50))  # copies of one text are one document
    assert {r["doc_id"] for r in rows(quality.keep_good(df, min_docs=5, max_share=0.05))} == {k for k, v in kept.items() if v}
    assert quality.keep_good(awkward(spark)).columns == awkward(spark).columns


def test_quality_limit_does_not_grow_with_the_host(spark):
    """The registered query's own parameters: 25 of 400 texts share a line, 19 another."""
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    line = lambda i: "\nHome  About contact" if i < 25 else "\nin nineteen texts" if i < 44 else ""
    data = [(i, own(i) + line(i), None, "h", 0) for i in range(400)] + [(400 + i, own(25) + line(25), None, "h", 0) for i in range(50)]
    data += [(500 + i, own(500 + i) + line(0), None, None if i < 20 else "small", 0) for i in range(39)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["n_words"] - r["n_left"] for r in rows(quality.line_quality(df))}
    assert all(got[i] == (3 if i < 25 else 0) for i in range(400))
    assert all(got[500 + i] == (3 if i < 20 else 0) for i in range(39))  # a null host of 20 texts, and a host of 19


def test_quality_sql_where_lines_go(spark):
    """The registered SQL beside the registered parameters, on documents that fall for their lines only."""
    import duckdb

    from gaugeframe.llm.oracle import ORACLES

    from ..compare import bag

    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    menu = "\n".join(" ".join(f"menu{k}x{j}" for j in range(20)) for k in range(3))
    data = [(i, f"{own(i, 70)}\n{menu if i < 30 else ''}", "en", "h", 0) for i in range(60)] + [(100 + i, f"{menu}\n{own(100 + i, 10)}", "en", "h", 0) for i in range(25)]
    data += [(200, None, None, None, 0), (201, menu, "en", "other", 0), *[(300 + i, f"{menu}\n{own(300, 9)}", "en", None, 0) for i in range(40)]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = quality.line_quality(df)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    rel = con.sql(ORACLES["op5_line_quality"])
    assert bag(out.columns, out.collect()) == bag(rel.columns, rel.fetchall())
    kept = {r["doc_id"]: r["kept"] for r in rows(out)}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(25)) and all(kept[300 + i] for i in range(40)) and kept[201]


# 6 near duplicates
def brute_components(data):
    sets, ids = [], []
    for d, t, *_ in data:
        w = WORDS.findall(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        ids.append(d)
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if ids[i] is None or ids[j] is None:
                continue
            x = len(sets[i] & sets[j])
            if (sets[i] and sets[j] and 100 * x >= 75 * (len(sets[i]) + len(sets[j]) - x)) or (ids[i] == ids[j] and sets[i] and sets[j]):
                up[top(i)] = top(j)
    low = defaultdict(list)
    for i in range(len(ids)):
        if ids[i] is not None:
            low[top(i)].append(ids[i])
    return Counter((d, len(s), min(low[top(i)]) if d is not None else None) for i, (d, s) in enumerate(zip(ids, sets)))


@pytest.mark.parametrize("exact", [False, True])
@both
def test_near_duplicates(spark, which, exact):
    out = rows(neardup.near_duplicates(docs_of(spark, which), exact=exact))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(plain(which))
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_chains_and_shared_passages(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"v{rng.integers(0, 5000)}"
    data, passage = [], [word() for _ in range(60)]
    for g in range(12):
        text = [word() for _ in range(int(rng.integers(20, 400)))]
        for _ in range(20):  # each a few words from the one before: a chain, not a star
            data.append((len(data), " ".join(text), None, None))
            text = list(text)
            for _ in range(int(rng.integers(0, max(2, len(text) // 40)))):
                text[int(rng.integers(0, len(text)))] = word()
    for _ in range(60):  # a passage and little else
        data.append((len(data), " ".join(passage + [word() for _ in range(int(rng.integers(5, 60)))]), None, None))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    for exact in (False, True):
        out = rows(neardup.near_duplicates(df, exact=exact))
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(data)


def test_near_duplicates_hot_classes_and_ids(spark):
    """A class over the limit for broadcasts, empty texts, an id with many texts, and classes of two."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    data = [(i, text(0)) for i in range(1500)] + [(2000 + i, "") for i in range(300)] + [(3000, text(i)) for i in range(90, 240)] + [(4000 + i, text(300 + i // 2)) for i in range(60)]
    data += [(5000, text(0)), (3000, text(400)), (5001, text(400))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = Counter((r["doc_id"], r["component_id"]) for r in rows(neardup.near_duplicates(df)))
    want = Counter({(i, 0): 1 for i in range(1500)}) + Counter({(2000 + i, 2000 + i): 1 for i in range(300)}) + Counter({(3000, 3000): 151})
    want += Counter({(4000 + i, 4000 + i // 2 * 2): 1 for i in range(60)}) + Counter({(5000, 0): 1, (5001, 3000): 1})
    assert out == want


@pytest.mark.parametrize("shape", ["chain", "shuffled", "star", "pairs"])
def test_components_in_few_rounds(spark, monkeypatch, shape):
    n, rng = 1000, np.random.default_rng(8)
    name = rng.permutation(n) if shape == "shuffled" else np.arange(n)
    ends = {"star": [(n, i) for i in range(n)], "pairs": [(2 * i, 2 * i + 1) for i in range(n // 2)]}.get(shape) or [(int(name[i]), int(name[i + 1])) for i in range(n - 1)]
    made = []
    whole = neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df: made.append(1) or whole(df))
    got = {r["node"]: r["comp"] for r in rows(neardup.components(spark.createDataFrame(ends, "a long, b long")))}
    assert got == ({i: i // 2 * 2 for i in range(n)} if shape == "pairs" else dict.fromkeys(set(sum(ends, ())), 0))
    assert len(made) <= (4 * np.log2(n) if shape == "shuffled" else 15)  # tables written: three a round, and one a doubling


# 7 HTML
def test_html_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href=/a>a</a><li><a href=/b>b</a></ul></nav><!-- ad <p>no</p> --><div class="ad">buy this now today</div>
    <div class="cookie-notice">We use cookies on this site</div><aside>see also this</aside>
    <article><h1>Title &amp; more</h1><p>One.<p><b>Two  has
    &lt;words&gt; &eacute;<br>and a < b<p>Es.</p><form><input><button>Send</button></form>
    <div class="comments"><p>Nice article, thank you so much for it</p></div></article><footer>&copy; host</footer>"""
    assert html_text.main_blocks(page) == ["Title & more", "One.", "Two has <words> é and a < b", "Es."]
    assert html_text.main_blocks(None) == html_text.main_blocks("") == html_text.main_blocks("<p>") == []
    bare = "<body><div><a href=x>Home</a> <a href=y>News</a></div><div>" + "long text here " * 20 + "</div><div>" + "more of the text " * 20 + "</div><div><a href=z>imprint</a></div>"
    assert len(html_text.main_blocks(bare)) == 2


def test_html_names_of_other_things():
    """Names that speak of another part say nothing, and names that only hold such a word are hints."""
    text = lambda i: f"Paragraph {i} goes on for quite a while, with words enough to be read as text of its own and not as a label."
    plain = "".join(f"<p>{text(i)}</p>" for i in range(4))
    want = [text(i) for i in range(4)]
    for names in ('id="page" class="site no-sidebar"', 'class="layout has-header"', 'class="with-comments"', 'class="hideNav"'):
        assert html_text.main_blocks(f"<body><div {names}>{plain}</div></body>") == want, names
    for names in ("related-work", "search-theory", "the-privacy-debate", "comment-on-method"):
        assert html_text.main_blocks(f"<article><h1>Title</h1>{plain}<div class={names}><p>{text(9)}</p></div></article>") == ["Title", *want, text(9)], names
    for names in ("cookie-notice", "related-posts", "sidebar-left", "commentList", "post-comments", "ad-slot-3", "site-footer", "main-nav"):
        assert html_text.main_blocks(f"<article><h1>Title</h1>{plain}<div class={names}><p>{text(9)}</p></div></article>") == ["Title", *want], names
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i} here</a></li>" for i in range(6)) + "</ul>"
    assert html_text.main_blocks(f"<body><div>{links}</div><div>{plain}</div><div>{links}</div></body>") == want  # no names at all


def test_html_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>One two three.</p></article>")] * 2, "page_id long, url string, html string")
    for c in ("doc_id", "text", "n_chars"):
        df = df.withColumn(c, F.lit("x"))
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in rows(html_text.extract(df))] == [(1, "u", "One two three.", 14)] * 2


def test_html_long_attribute_values():
    for q, other in ("\"'", "'\""):
        for value in ("x>y " * 3000, f"<p class=ad>{other} display:none hidden " * 200):
            page = f"<article><p data-x={q}{value}{q}>One two three.</p><div data-x={q}{value}{q} class={q}ad{q}>buy this now today</div></article>"
            assert html_text.main_blocks(page) == ["One two three."]
    assert html_text.main_blocks("<article><p title=it's>One.</p><p>It's two.</p></article>") == ["One.", "It's two."]
    assert html_text.main_blocks('<article><p title="one>Two words.</p><p>Three.</p></article>') == ["Two words.", "Three."]
    for odd in ("<a href='" * 50000, "<a " + "x " * 300000, "<a b=\"'" * 50000, "<a =" + "=" * 300000, "<p title=\"x" * 2 + "<" * 100000):
        html_text.main_blocks(odd)


def test_html_on_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r["page_id"]: r for r in rows(html_text.extract(df))}
    for p in rows(df):
        article = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)[1]
        parts = [re.sub(r"<[^>]*>", " ", x) for x in re.split(r"</?(?:p|h1)>", article)]
        import html

        want = "\n\n".join(s for x in parts if (s := " ".join(html.unescape(x).split())))
        assert out[p["page_id"]]["text"] == want and out[p["page_id"]]["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, None, None), (None, "u", "<p>" * 20000), (2, "u", "<" * 20000), (3, "u", "<a href='" * 5000)], "page_id long, url string, html string")
    assert html_text.extract(odd).count() == 4 and html_text.extract(df.limit(0)).count() == 0


# 8 licenses
@both
def test_license_base(spark, which):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for d, t, *_ in plain(which):
        w, hits, labels = words.findall(lower(t or "")), [], set()
        for k, p in license.PHRASES.items():
            p = p.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            hits += at
            labels |= {k} if at else set()
        want[d, len(w), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))] += 1
    out = rows(license.scan(docs_of(spark, which)))
    assert Counter(tuple(r[k] for k in "doc_id n_words n_base first_word last_word base_labels".split()) for r in out) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)


def test_license_spans(spark):
    mit = license.TEMPLATES["mit"][2]
    words = mit.split()
    changed = " ".join(words[:12] + ["really"] + words[12:30] + words[31:])
    texts = ["Released under the MIT License.", f"foo {changed} bar", " ".join(words[:15]), "the MIT license was released under pressure", "x " * 500 + "Licensed under the Apache License, Version 2.0 " * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in rows(license.scan(df))}
    assert got == {0: "mit", 1: "mit", 2: "", 3: "", 4: "apache-2.0"}
    assert license.scan(empty(spark)).count() == 0


def test_license_versions(spark):
    notice, long = license.TEMPLATES["gpl-3.0"]
    stem = "This work is licensed under the GNU General Public License"
    texts = [notice, license.TEMPLATES["gpl-2.0"][0], stem + ".", stem + ", version 1.", f"{stem}, version 2. {stem}, version 3.", long, long.replace("version 3", "version 2")]
    texts += ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2", "Licensed under the Apache License, Version 1.1"]
    texts += [license.TEMPLATES["mpl-2.0"][0], license.TEMPLATES["mpl-2.0"][0].replace("2.0", "1.1")]
    df = spark.createDataFrame([(i, f"some words before {t} and after it") for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r["labels"] for r in sorted(rows(license.scan(df)), key=lambda r: r["doc_id"])]
    assert got == ["gpl,gpl-3.0", "gpl,gpl-2.0", "gpl", "gpl", "gpl,gpl-2.0,gpl-3.0", "gpl,gpl-3.0", "gpl", "apache-2.0", "apache-2.0", "", "mpl-2.0", ""]
    every = [(label, t) for label, ts in license.TEMPLATES.items() for t in ts]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(every)], "doc_id long, text string")
    for r in rows(license.scan(df)):
        assert [x for x in r["labels"].split(",") if x not in license.PHRASES] == [every[r["doc_id"]][0]] and r["score"] == 1


def test_license_sql_on_edited_texts(spark):
    """Whole licence texts with words lost, put in and swapped, beside the registered SQL."""
    import duckdb

    from gaugeframe.llm.oracle import ORACLES

    from ..compare import bag

    rng, data = np.random.default_rng(6), []
    for _, label, words, _ in license.template_rows(license.TEMPLATES, 4):
        for share in (0, 0.02, 0.06, 0.2):
            w = [x if rng.random() >= share else rng.choice([f"other {x}", "", "else"]) for x in words]
            data.append((len(data), " ".join(["before this"] * int(rng.integers(0, 9)) + w + ["and after"] * 3)))
    data += [(900, None), (901, ""), (901, ""), (902, "CC-BY all rights reserved general Public\nLicense cc by"), (903, "\u212a licensed under the MIT licen\u017fe")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = license.scan(df)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"text": object}).where(lambda d: d.notna(), None))
    rel = con.sql(ORACLES["op8_license_scan"])
    assert bag(out.columns, out.collect()) == bag(rel.columns, rel.fetchall())
    got = {r["doc_id"]: r["labels"].split(",") for r in rows(out)}
    names = [label for _, label, _, _ in license.template_rows(license.TEMPLATES, 4)]
    assert all(label in got[4 * i] and label in got[4 * i + 1] for i, label in enumerate(names) if len(license.template_rows(license.TEMPLATES, 4)[i][2]) > 40)


# 9 BPE
@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_is_tiktoken(text):
    import tiktoken

    c = bpe.coder(MULTI, public_tokenizers.PATTERN)
    enc = _encoding() if not hasattr(test_bpe_is_tiktoken, "enc") else test_bpe_is_tiktoken.enc
    test_bpe_is_tiktoken.enc = enc
    assert isinstance(enc, tiktoken.Encoding)
    assert c.encode(text) == enc.encode_ordinary(text)


def _encoding():
    import tiktoken

    c = bpe.coder(MULTI, public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


@both
def test_bpe_digests(spark, which):
    enc, want = _encoding(), Counter()
    for d, t, *_ in plain(which):
        ids = enc.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    out = rows(bpe.round_trip_digests(docs_of(spark, which), MULTI, public_tokenizers.PATTERN))
    assert Counter(tuple(r[k] for k in "doc_id n_tokens ids_sha256 decoded_sha256".split()) for r in out) == want


def test_bpe_long_pieces_and_decoding(spark):
    enc, c = _encoding(), bpe.coder(MULTI, public_tokenizers.PATTERN)
    for t in ("a" * 5000, "ab" * 3000, "été" * 2000, " " * 4000 + "x", "=-" * 3000):
        assert c.encode(t) == enc.encode_ordinary(t)
    df = awkward(spark)
    back = rows(bpe.decode_documents(bpe.encode_documents(df, MULTI, public_tokenizers.PATTERN), MULTI, public_tokenizers.PATTERN))
    assert Counter((r["doc_id"], bytes(r["data"])) for r in back) == Counter((r[0], (r[1] or "").encode()) for r in ROWS)


# 10 language ID
def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {d: (t, lang) for d, t, lang, _ in documents("/root/testdata/sf0.01")}
    out = [r for r in rows(langid.identify(df)) if r["held_out"]]
    assert {r["doc_id"] for r in out} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    right = [r["lang_pred"] == truth[r["doc_id"]][1] for r in out if any(c.isalpha() for c in truth[r["doc_id"]][0])]
    assert np.mean(right) > 0.95
    assert np.mean([r["rejected"] for r in out]) < 0.03


def test_language_edge_cases(spark):
    out = rows(langid.identify(awkward(spark)))
    assert len(out) == len(ROWS)
    for r in out:
        t = {x[0]: x[1] for x in ROWS if x[0] not in (1, None)}.get(r["doc_id"], "a")
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), r
        assert 0 <= r["score"] <= 1
    assert langid.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in rows(langid.identify(awkward(spark).drop("lang").selectExpr("*", "cast(null as string) lang")))} == {"und"}


# every operator on an empty table
def test_empty(spark):
    e = empty(spark)
    for f in (lambda: packing.pack(e, CLIP), lambda: lm.score_documents(e), lambda: quality.line_quality(e), lambda: neardup.near_duplicates(e), lambda: license.scan(e), lambda: bpe.round_trip_digests(e, MULTI, public_tokenizers.PATTERN)):
        assert f().count() == 0
