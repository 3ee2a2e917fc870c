"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its hashed word shingles; its sketch is the ``k`` smallest hashes.
Documents with equal sets are one class, which its smallest id represents, so exact copies
cost nothing further.  An inverted list per retained hash value holds the representatives
that retained it; representatives that share enough values are candidates.  The union of two
sketches estimates the similarity and filters, and the exact Jaccard of the full sets decides.

Nothing is capped, and no list is expanded into all its pairs:

* A small sketch of ``screen`` values screens out documents that share too few of them with
  anyone; sets, and sketches of ``k`` values, are made for the rest only.
* Similar sets share at least ``need(size)`` sketch values (five standard deviations below
  what ``similarity`` predicts; for sets smaller than the sketch, exactly).  So a value need
  only be listed among the rarest size - need + 1 of a sketch: passages that very many
  documents share are listed only for documents that hold little else.
* In each of ``rounds`` passes every list is compared with one head, a star; the links found
  are contracted into components.  Then only members of different components are compared, which
  leaves the result exact: a pair inside one component can't change it.  Long lists are compared
  block by block in numpy, and only similar pairs come out, as few as connect the same members.

A pair exactly at the threshold is lost if its sketches agree five standard deviations less
than expected, twice in 10 million pairs.  ``exact=True`` loses none: full sets take the sketches'
place, and lists hold what the prefix filter needs, at the cost of longer lists.

Links and components stay distributed: each node points to its smallest neighbour, pointers are
doubled until they reach a root, and the links between roots go on, so that the rounds grow with
the logarithm of a chain's length.  Copies find their class without one task for a class: the
classes of very many copies, of which there can only be few, are broadcast.

Defined cases: null text, or text without words, has no shingles and links with nothing;
fewer words than a shingle are one shingle; repeated rows each get a row; rows that share an
id are one document, linked whatever their texts; a null id links with nothing and isn't
kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, ship, small, worker_memo
from .lm import mix

MEMO = 150_000


class WordHashes(dict):
    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = h
        return h


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles, A-Z lower-cased."""
    memo, out = worker_memo(("neardup",), WordHashes), []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        n = len(words)
        if n < width:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], np.uint64))
            continue
        w = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
        h = w[: n - width + 1]
        for j in range(1, width):
            h = mix(h, w[j : n - width + 1 + j])
        out.append(np.unique(h))
    return out


def need(size: int, k: int, similarity: float) -> int:
    """Sketch values that a set of ``size`` shares with any set that similar to it."""
    exact = math.ceil(similarity * size - 1e-9)
    if size < similarity * k:
        return exact
    return max(1, min(exact, math.floor(k * similarity - 5 * math.sqrt(k * similarity * (1 - similarity)))))


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> tuple[float, int]:
    """Jaccard by the k smallest of the union of two sketches; and how many there were."""
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / max(1, len(union)), len(union)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(docs: DataFrame, width: int, k: int | None, digest: bool, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n and the k smallest hashes (all if None), as signed longs in unsigned order; with
    ``digest`` also the 128-bit hash of the set."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n", "hashes"] + ["sh1", "sh2"] * digest

    def run(batches):
        for b in small(batches):
            sets = shingle_sets(b.column(1).to_pylist(), width)
            cols = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64()))]
            if digest:
                digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                cols += [pa.array([(d >> at) % 2**64 - 2**63 for d in digests], pa.int64()) for at in (0, 64)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return d.mapInArrow(run, "doc_id long, n long, hashes array<long>" + (", sh1 long, sh2 long" if digest else ""))


def _roots(parent: DataFrame) -> DataFrame:
    """(a, p) with p the root that the pointers of ``parent`` lead to; pointers go to smaller nodes."""
    while True:
        hops = parent.where("a <> p").select(F.col("a").alias("via"), F.col("p").alias("next"))
        hops = hops.join(parent.select(F.col("p").alias("via")).distinct(), "via")  # pointers that others lead to
        if hops.isEmpty():
            return parent
        further = parent.join(hops, F.col("p") == F.col("via"), "left").select("a", F.coalesce("next", "p").alias("p"))
        further = materialise(further)
        release(parent)
        parent = further


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of the links (a, b)."""
    edges = materialise(links.where("a <> b").select("a", "b").distinct())
    labels = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = _roots(materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))))
        further = materialise(labels.join(parent, F.col("comp") == F.col("a"), "left").select("node", F.coalesce("p", "comp").alias("comp")))
        pa_, pb = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        rest = edges.join(pa_, "a").join(pb, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        rest = materialise(rest.distinct())
        release(labels, parent, edges)
        labels, edges = further, rest
    release(edges)
    return labels


#: Classes that are broadcast, at most; a class is if it holds more than this share of all rows.
HOT_CLASSES = 100_000


def _shared_ids(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share an id.  An id's classes meet in 64 groups
    first, so that no id has one task for all."""
    ids = members.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    of = members.select("doc_id", "sh1", "sh2").join(ids, "doc_id", "left_semi").join(classes.select("sh1", "sh2", "rep"), ["sh1", "sh2"])
    of = materialise(of.select("doc_id", "rep", F.pmod(F.xxhash64("rep"), F.lit(64)).alias("part")).distinct())
    heads = of.groupBy("doc_id", "part").agg(F.min("rep").alias("head"))
    tops = heads.groupBy("doc_id").agg(F.min("head").alias("top"))
    links = of.join(heads, ["doc_id", "part"]).select(F.col("head").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(heads.join(tops, "doc_id").select(F.col("top").alias("a"), F.col("head").alias("b")))
    return links.where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width=5, percent=75, k=256, screen=24, rounds=1, exact=False, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    similarity = percent / 100
    if exact:
        k = screen = None
    ship(docs.sparkSession)
    every = materialise(_sets(docs, width, screen, True, id_col, text_col))
    members = every.where("n > 0 and doc_id is not null")
    # equal sets have equal sketches
    classes = members.groupBy("sh1", "sh2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    classes = materialise(classes)
    reps = classes.select("rep", "n", "hashes")
    involved = _shared(reps, screen, similarity).select("rep").distinct()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(involved, F.col("doc_id") == F.col("rep"), "left_semi")
    full = _sets(texts, width, None, False, "doc_id", "text").where("n > 0")
    full = materialise(full.select(F.col("doc_id").alias("rep"), "n", "hashes").dropDuplicates(["rep", "hashes"]))
    reps = full.select("rep", "n", (F.slice("hashes", 1, k) if k else F.col("hashes")).alias("hashes"))
    lists = materialise(_lists(reps, k, similarity))

    links = _shared_ids(members, classes)
    for turn in range(rounds + 1):
        links = materialise(links)
        labels = components(links)
        labelled = lists.join(labels, F.col("rep") == F.col("node"), "left").select("v", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
        pairs = _star(labelled, turn) if turn < rounds else _between(labelled, full, percent)
        fits = pairs.where((F.col("na") >= similarity * F.col("nb")) & (F.col("nb") >= similarity * F.col("na")))
        pairs = fits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = links.unionByName(_verified(pairs, reps, full.drop("n"), k, percent))
    labels = components(links)
    return _of_rows(every, classes, labels)


def _of_rows(every: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The result: each row finds the component of its class, or its own if it's the only one."""
    n = every.count()
    hot = max(1000, -(-n // HOT_CLASSES))  # under n / hot classes hold more rows
    copied = classes.where("m > 1").join(labels, F.col("rep") == F.col("node"), "left").select("sh1", "sh2", "m", F.coalesce("comp", "rep").alias("comp"))
    copied = materialise(copied)
    rows = every.select("doc_id", "n", "sh1", "sh2").join(F.broadcast(copied.where(F.col("m") > hot).drop("m")), ["sh1", "sh2"], "left")
    known = (F.col("n") == 0) | F.col("doc_id").isNull() | F.col("comp").isNotNull()
    done = rows.where(known).select("doc_id", "n", F.coalesce("comp", "doc_id").alias("comp"))
    rest = rows.where(~known).drop("comp").join(copied.where(F.col("m") <= hot).drop("m"), ["sh1", "sh2"], "left")
    rest = rest.join(labels.select("node", F.col("comp").alias("own")), F.col("doc_id") == F.col("node"), "left")
    out = done.unionByName(rest.select("doc_id", "n", F.coalesce("comp", "own", "doc_id").alias("comp")))
    comp = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("comp")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(False)).alias("kept"))


def _shared(reps: DataFrame, k: int | None, similarity: float) -> DataFrame:
    """(rep, n, vs, least): the sketch values that another representative retained too, rarest
    first, of those that hold at least as many (least) as a similar one would share."""
    values = reps.select("rep", F.explode("hashes").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    kept = values.join(often, "v").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"))
    if k is None:
        least = F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int")
    else:
        least = F.element_at(F.array(*[F.lit(need(s, k, similarity)) for s in range(k + 1)]), F.size("hashes") + 1)
    sizes = reps.select(F.col("rep").alias("rep2"), "n", least.alias("least"))
    return kept.join(sizes, F.col("rep") == F.col("rep2")).where(F.size("vs") >= F.col("least")).select("rep", "n", "vs", "least")


def _lists(reps: DataFrame, k: int | None, similarity: float) -> DataFrame:
    """(v, rep, n): the inverted lists of the rarest retained values that candidates must share.
    Values of one representative only would come first in the order; they're no one else's."""
    front = F.slice("vs", 1, F.size("vs") - F.col("least") + 1)
    return _shared(reps, k, similarity).select("rep", "n", F.explode(front).alias("x")).select(F.col("x.v").alias("v"), "rep", "n")


def _star(lists: DataFrame, turn: int) -> DataFrame:
    """Every member of a list with the list's head, where their components differ."""
    rank: Column = F.col("rep") if not turn else F.xxhash64("rep", F.lit(turn))
    heads = lists.groupBy("v").agg(F.min(F.struct(rank.alias("o"), "rep", "n", "comp")).alias("h"))
    out = lists.join(heads, "v").where((F.col("rep") != F.col("h.rep")) & (F.col("comp") != F.col("h.comp")))
    return out.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("h.rep").alias("b"), F.col("h.n").alias("nb"))


def _between(lists: DataFrame, full: DataFrame, percent: int, small=32, block=512) -> DataFrame:
    """Members of a list that lie in different components.  Lists of up to ``small`` members are
    joined with themselves, at most ``small`` rows a member.  Longer lists are dealt into blocks;
    every two blocks meet in a task that compares their sets and returns only the similar."""
    mixed = lists.groupBy("v").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("v", "m")
    left = lists.join(mixed.where(F.col("m") <= small), "v", "left_semi")
    right = left.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("comp2"))
    little = left.join(right, "v").where(F.col("comp") < F.col("comp2")).select(F.col("rep").alias("a"), F.col("n").alias("na"), "b", "nb")

    parts = F.ceil(F.col("m") / block).cast("int")
    members = lists.join(mixed.where(F.col("m") > small).select("v", parts.alias("parts")), "v")
    members = members.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("v", "rep", "n", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    members = members.join(full.select("rep", "hashes"), "rep")

    def compare(key, t):
        i, j = key[1].as_py(), key[2].as_py()
        own, comp, rep = (t[c].to_numpy() for c in ("own", "comp", "rep"))
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = np.zeros((0, 2), np.int64)
        if len(np.unique(comp)) > 1:
            flat = t["hashes"].combine_chunks()
            both, n = overlaps(flat.flatten().to_numpy(), flat.value_lengths().to_numpy(), x, y)
            near = (100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)) & (comp[x][:, None] != comp[y][None, :])
            u, w = np.nonzero(near)
            first = spanning(comp[x[u]], comp[y[w]])
            out = np.stack([rep[x[u[first]]], rep[y[w[first]]]], 1)
        pairs = np.unique(np.sort(out, 1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    many = members.groupBy("v", "i", "j").applyInArrow(compare, "a long, b long")
    size = F.lit(1).cast("long")  # sizes were compared
    return little.unionByName(many.select("a", size.alias("na"), "b", size.alias("nb")))


def spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of pairs (a, b) that connect all that the pairs connect: fewer than there are ends."""
    ends, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, out = list(range(len(ends))), []
    for i, (u, w) in enumerate(zip(code[: len(a)].tolist(), code[len(a) :].tolist(), strict=True)):
        while up[u] != u:
            up[u] = u = up[up[u]]
        while up[w] != w:
            up[w] = w = up[up[w]]
        if u != w:
            up[w] = u
            out.append(i)
    return out


def overlaps(values: np.ndarray, lengths: np.ndarray, x: np.ndarray, y: np.ndarray, width=1024) -> tuple[np.ndarray, np.ndarray]:
    """Intersection sizes of the sets in rows ``x`` with those in rows ``y``, and all sets' sizes.
    values: the sets one after another.  Values of one set only can't be shared: they drop out."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    row, code = row[keep], number[code[keep]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(x), len(y)), np.float32)
    at = np.full(len(lengths), -1)
    at_x, at_y = at.copy(), at.copy()
    at_x[x], at_y[y] = np.arange(len(x)), np.arange(len(y))
    for a in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(code, [a, a + width])
        r, c = row[i:j], code[i:j] - a
        p, q = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
        p[at_x[r[at_x[r] >= 0]], c[at_x[r] >= 0]] = 1
        q[at_y[r[at_y[r] >= 0]], c[at_y[r] >= 0]] = 1
        out += p @ q.T
    return np.rint(out).astype(np.int64), lengths.astype(np.int64)


def _verified(pairs: DataFrame, reps: DataFrame, full: DataFrame, k: int | None, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; the sketches, if shorter, filter first."""

    def both(p, t):
        a, b = t.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), t.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
        return p.join(a, "a").join(b, "b").select("a", "b", "ha", "hb")

    def tested(test):
        def run(batches):
            for t in batches:
                x, y = ([np.asarray(v.values, dtype=np.int64).view(np.uint64) for v in t.column(i)] for i in (2, 3))
                yield t.filter(pa.array([test(u, v) for u, v in zip(x, y, strict=True)], pa.bool_())).select(["a", "b"])

        return run

    def near(u, v):
        j, n = estimate(u, v, k)
        s = percent / 100
        return j >= s - 5 * math.sqrt(s * (1 - s) / max(1, n)) if n >= k else 100 * j >= percent - 1e-6

    passed = both(pairs, reps).mapInArrow(tested(near), "a long, b long").distinct() if k else pairs
    return both(passed, full).mapInArrow(tested(lambda u, v: similar(u, v, percent)), "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group, one row of each id and text.  A row
    without an id is the document of its text, behind the ids under 2**62."""
    text = F.xxhash64(F.col(text_col))
    stand_in = text.bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    d = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), stand_in).alias("id"), text.alias("doc"), F.col(text_col).alias("text")
    )
    kept = near_duplicates(d.select("id", "text"), id_col="id", text_col="text", **options).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return d.drop("text").join(kept, F.col("id") == F.col("kept_id"), "left_semi").dropDuplicates(["id", "doc"]).select("row.*")
