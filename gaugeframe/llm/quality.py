"""Quality rules from cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; per host (``source``) each line's number of distinct
documents is counted.  A line that at least ``min_docs`` of a host's documents carry (and,
where ``max_share`` is given, more than that share of them) is boilerplate: it is removed.
A document of whose words less than ``min_left`` is left is depleted: rejected.

The limit is a number of documents, so it doesn't rise with the host.  Documents count once
per distinct text, so exact copies don't turn their own lines into boilerplate.  How many
lines of a host pass the limit grows with the host, so no list of them is joined to its
documents: each document gets the list of its own lines over the limits.

Defined cases: null or blank text has no words, hence fails the base rules; a null host is
a host of its own; a text of any length is read whole; a line in exactly ``min_docs`` texts is
over the limit, and a document with exactly ``min_left`` of its words stays; repeated rows each get a row; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let, materialise

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


#: The most common lines that are broadcast (a few MB); a larger table is joined by a shuffle.
BROADCAST = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, ASCII_SPACE), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in some 3-word window found at least twice.  Windows are hashed, sorted
    with their places, and compared with their neighbours."""

    def marked(w):
        windows = F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )
        return let(windows, repeated)

    def repeated(h):
        def places(s):
            same = F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, places))

    return let(words, marked)


def _lines(text: Column) -> Column:
    """The lines that have a word, with their text as it stands."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def _without(text: Column, lines: Column) -> Column:
    """``text`` less the lines whose hash is in ``lines``; the others stay as they stand."""
    own = lambda x: F.xxhash64(F.lower(F.array_join(words_of(x), " ")))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(lines, own(x))), "\n")


def _hashed(text: Column) -> Column:
    """(hash of the normalised line, its words) of each line with a word."""
    return F.transform(
        _lines(text),
        lambda x: let(
            words_of(x),
            lambda w: F.struct(F.xxhash64(F.lower(F.array_join(w, " "))).alias("h"), F.size(w).alias("n")),
        ),
    )


def _doc_lines(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """(host, doc, h): the distinct line hashes of each distinct text of a host."""
    d = docs.select(F.col(host_col).cast("string").alias("host"), F.xxhash64(F.col(text_col)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.select("host", "doc", F.explode(F.array_distinct(F.transform(_hashed(F.col("text")), lambda x: x.h))).alias("h")).distinct()


def common_lines(docs: DataFrame, text_col="text", host_col="source", min_docs=20, max_share=0.0) -> DataFrame:
    """(host, doc, lines): per distinct text of a host the hashes of its lines over the limits;
    texts without such lines have no row."""
    lines = _doc_lines(docs, text_col, host_col)
    over = lines.groupBy(F.col("host").alias("host2"), F.col("h").alias("h2")).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    if max_share:
        d = docs.select(F.col(host_col).cast("string").alias("host3"), F.xxhash64(F.col(text_col)).alias("doc")).distinct()
        hosts = d.groupBy("host3").agg(F.count("*").alias("docs"))
        over = over.join(hosts, F.col("host2").eqNullSafe(F.col("host3"))).where(F.col("n") > max_share * F.col("docs"))
    over = materialise(over.select("host2", "h2"))
    if over.count() <= BROADCAST:
        over = F.broadcast(over)
    hits = lines.join(over, F.col("host").eqNullSafe(F.col("host2")) & (F.col("h") == F.col("h2")), "left_semi")
    return hits.groupBy("host", "doc").agg(F.collect_list("h").alias("lines"))


def line_quality(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", min_docs=20, max_share=0.0, min_left=0.3, min_words=50, max_repeat=0.5, carry=False) -> DataFrame:
    """One row per row of ``docs``: id, the base counts, base_failed, n_left (words in lines
    that stay) and kept; with ``carry`` also the row, as a struct ``row``, its text without the
    lines over the limits."""
    common = common_lines(docs, text_col, host_col, min_docs, max_share).select(F.col("host").alias("host2"), F.col("doc").alias("doc2"), "lines")
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.xxhash64(F.col(text_col)).alias("doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.struct(*[docs[c] for c in docs.columns]).alias("row")] * carry,
    )
    t = F.col("text")
    d = d.select(
        "doc_id",
        "host",
        "doc",
        *["row"] * carry,
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words_of(t), lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat"))).alias("w"),
        _hashed(t).alias("hashed"),
    )
    gone = F.aggregate(
        F.filter("hashed", lambda x: F.array_contains(F.col("lines"), x.h)), F.lit(0), lambda acc, x: acc + x.n
    )
    d = d.join(common, F.col("host").eqNullSafe(F.col("host2")) & (F.col("doc") == F.col("doc2")), "left")
    n, rep = F.col("w.n_words").cast("long"), F.col("w.n_repeat").cast("long")
    failed = (n < min_words) | (rep > max_repeat * n)
    left = n - F.when(F.col("lines").isNull(), F.lit(0)).otherwise(gone)
    row = []
    if carry:
        t = F.col("row").getField(text_col)
        row = [F.col("row").withField(f"`{text_col}`", F.when(F.col("lines").isNull(), t).otherwise(_without(t, F.col("lines")))).alias("row")]
    return d.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", rep.alias("n_repeat_words"),
        failed.alias("base_failed"), left.cast("long").alias("n_left"), (~failed & (left >= min_left * n)).alias("kept"), *row,
    )


def keep_good(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their text without the lines over the limits.
    The text is shuffled once, to meet the list of these lines."""
    return line_quality(docs, id_col, text_col, host_col, carry=True, **limits).where("kept").select("row.*")
