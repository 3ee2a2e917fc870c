"""Language-model scoring by deleted interpolation.

p(w | u v) mixes the maximum-likelihood trigram c(u v w)/c(u v), the bigram c(v w)/c(v), the
unigram c(w)/N and the uniform 1/(V+1).  The weights depend on how often the context occurs,
by its power of two: on c(u v) where the pair was seen, else on c(v).  They are learned by
expectation-maximisation: of the training documents a fifth is put aside, the counts of the
rest give the estimates, and the weights make the documents put aside most likely.  The final
estimates count both parts, and a training document is scored with its own counts deleted, so
that it doesn't predict itself and its score compares with a held-out document's.

Counting is distributed.  Documents are packed into blocks of about ``block_bytes`` of text,
where they stand; blocks are written once, as numbers of their own words.  A block counts its own words, pairs and triples in
numpy, as hashes, and sends each counting bucket one packed row of its distinct keys and
counts; a bucket adds up what all blocks sent and answers each block with the corpus counts of
that block's keys, in its order.  So keys cross the network once a block, pre-aggregated, hot
words weigh no more than rare ones, equal rows burden no block, and neither vocabulary nor
counts ever meet in one place.  Blocks and buckets follow the bytes of the input.  Beyond
``fanout`` buckets blocks don't send to each of them: a block sends to ``fanout`` relays of its
region (``fanout`` blocks), which merge what the region's blocks share before they pass it on, so
rows grow as blocks times buckets over ``fanout`` squared.  Counts have 64 bits, hashes (up to 64) as many
as keep the chance of a false match under one in a million at the input's size.

Defined cases: a null text is the empty one: it has the end token alone; rows with a null id are
training rows; repeated rows count as often as they stand (each deletes its own counts only);
a text is held whole in one task, whatever its length; other columns are ignored; an empty table
gives an empty result; without training text every token has the uniform probability 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import forget_shuffles, give_back, holdout, materialise, ship, small

#: Fixed names of the end token, and of the context before the first word.  No word holds a blank.
END, START = b" end", b" start"
LEVELS = 40  # context-frequency buckets
STEP = 1.0  # resolution of log2 p in the EM's table of held-out tokens; cells keep their means
BINS = 40


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Words to numbers, in order of first sight, and the texts' tokens as numbers."""

    def __init__(self):
        super().__init__({START: 0, END: 1})
        self.sizes, self.parts = [], []

    def __missing__(self, word):
        n = self[word] = len(self)
        return n

    def add(self, text: bytes) -> None:
        words = text.lower().split()
        self.sizes.append(len(words) + 1)
        self.parts += [np.fromiter(map(self.__getitem__, words), np.uint32, len(words)), np.ones(1, np.uint32)]

    def packed(self) -> tuple[list[int], bytes, bytes]:
        """(tokens of each text, hashes of the words in order, all tokens)."""
        return self.sizes, np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self)).tobytes(), pack_numbers(np.concatenate(self.parts))


def pack_numbers(x: np.ndarray) -> bytes:
    """Rising or small unsigned numbers: differences if rising, byte planes, zstd."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack_numbers(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data, np.uint64), dtype=np.uint64)


class Block:
    """A block's tokens.  keys: the sorted hashes of its distinct words (even), pairs and triples
    (odd).  Each token's places in them: word, context (the word before), pair (both), first (the
    pair before; of a text's first token, the start), triple (of a first token, its pair)."""

    def __init__(self, sizes: list[int], hashes: bytes, words: bytes, bits: int):
        hashes, word = np.frombuffer(hashes, np.uint64), unpack_numbers(words, np.uint32).astype(np.int32)
        self.n = np.array(sizes, np.int64)
        self.begin = np.cumsum(self.n) - self.n
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[self.begin] = 0
        pairs, pair = np.unique(context.astype(np.int64) << 32 | word, return_inverse=True)
        two = mix(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF])
        inner = np.ones(len(word), bool)
        inner[self.begin] = False
        inner = np.flatnonzero(inner)
        triples, triple = np.unique(pair[inner - 1].astype(np.int64) << 32 | word[inner], return_inverse=True)
        three = mix(two[triples >> 32] + np.uint64(3), hashes[triples & 0xFFFFFFFF])
        cut, one = np.uint64(64 - bits), np.uint64(1)
        every = np.concatenate([(hashes >> cut) & ~one, (two >> cut) | one, (three >> cut) | one])
        self.keys, place = np.unique(every, return_inverse=True)
        place = place.astype(np.int32)
        self.word, self.context, self.start = place[word], place[context], int(place[0])
        self.pair = place[len(hashes) :][pair]
        self.first = np.full(len(word), self.start, np.int32)
        self.first[inner] = self.pair[inner - 1]
        self.triple = self.pair.copy()
        self.triple[inner] = place[len(hashes) + len(two) :][triple]
        self.inner = inner

    def counts(self, of: np.ndarray) -> np.ndarray:
        """Counts of the keys in the documents flagged."""
        size, tokens = len(self.keys), self.of_documents(of)
        inner = self.inner[tokens[self.inner]]
        out = np.bincount(self.word[tokens], minlength=size) + np.bincount(self.pair[tokens], minlength=size) + np.bincount(self.triple[inner], minlength=size)
        out[self.start] = of.sum()
        return out

    def own(self, places: np.ndarray) -> np.ndarray:
        """Per token how often its own document holds the key at its place."""
        key = np.repeat(np.arange(len(self.n)), self.n) * len(self.keys) + places
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        return n[at]

    def per_document(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.begin) if len(x) else np.zeros(0, x.dtype)

    def of_documents(self, flags: np.ndarray) -> np.ndarray:
        """The documents' flags for each token."""
        return np.repeat(flags, self.n)


def bucket_bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Positions where sorted keys enter each bucket: buckets are equal ranges of the hash."""
    edges = np.array([(i << bits) // buckets for i in range(buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def level(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 of its count)."""
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, LEVELS - 1), 0).astype(np.int64)


def estimates(word, context, pair, first, triple, tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(the weights' row, n x 4 probabilities: uniform, unigram, bigram, trigram) from counts of keys.
    Rows 0 to LEVELS - 1 are for the levels of c(v), where the pair of words before is unseen; then
    those of c(u v)."""
    p = np.stack([np.full(len(word), 1 / (kinds + 1)), word / max(tokens, 1), pair / np.maximum(context, 1), triple / np.maximum(first, 1)], 1)
    p[first <= 0, 3] = 0
    return np.where(first > 0, LEVELS + level(first), level(context)), p


def tabulate(row: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens with the same row and about the same probabilities: cell number, how many, and sums."""
    with np.errstate(divide="ignore"):
        bins = np.where(p[:, 1:] > 0, np.minimum(np.floor(-np.log2(p[:, 1:]) / STEP) + 1, BINS - 1), 0).astype(np.int64)
    cell, at = np.unique(((row * BINS + bins[:, 0]) * BINS + bins[:, 1]) * BINS + bins[:, 2], return_inverse=True)
    sums = {f"p{j}": np.bincount(at, p[:, j], len(cell)) for j in (1, 2, 3)}
    return {"cell": cell, "n": np.bincount(at, minlength=len(cell)), **sums}


def expectation_maximisation(row: np.ndarray, p: np.ndarray, n: np.ndarray, rounds=60) -> np.ndarray:
    """Weights (uniform, unigram, bigram, trigram) of each row that make ``n`` tokens of each cell
    (its row and probabilities) most likely.  A row without tokens takes the weights of the nearest
    below it of the same kind, else of all tokens together."""

    def fit(p, n):
        w = np.full(4, 0.25)
        for _ in range(rounds):
            share = w * p
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            w = (share * n[:, None]).sum(0) + [0.05, 0.01, 0.01, 0.01]
            w /= w.sum()
        return w

    weights = np.full((2 * LEVELS, 4), 0.25)
    weights[:] = fit(p, n) if len(n) else 0.25
    for b in range(2 * LEVELS):
        own = row == b
        if own.any():
            weights[b] = fit(p[own], n[own])
        elif b % LEVELS > 1:
            weights[b] = weights[b - 1]
    weights[0, 2] = 0  # nothing follows an unseen context
    weights[:LEVELS, 3] = 0
    return weights / weights.sum(1, keepdims=True)


def _blocks(docs: DataFrame, modulus: int, remainder: int, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, aside, bytes, ids, held_out, sizes, hashes, words): the tokens of documents where they
    stand, those put aside for the EM in blocks of their own."""
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8").alias("text"),
        holdout(id_col, modulus, remainder).alias("held_out"),
        (F.pmod(F.xxhash64(id_col, text_col, F.lit(5)), F.lit(5)) == 0).alias("aside"),
    )
    kind = d.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    class Open:
        def __init__(self):
            self.ids, self.held, self.words, self.size = [], [], Words(), 0

    kinds = {"aside": pa.bool_(), "bytes": pa.int64(), "ids": pa.list_(id_type), "held_out": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "hashes": pa.binary(), "words": pa.binary()}

    def run(batches):
        now = {False: Open(), True: Open()}

        def close(aside):
            o, now[aside] = now[aside], Open()
            row = [aside, o.size, o.ids, o.held, *o.words.packed()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds.values(), strict=True)], names=list(kinds))

        for b in small(batches):
            for doc_id, text, held, aside in zip(*(c.to_pylist() for c in b.columns), strict=True):
                o = now[aside]
                o.ids.append(doc_id), o.held.append(held), o.words.add(text)
                o.size += len(text) + 1
                if o.size >= block_bytes:
                    yield close(aside)
                    give_back()
        for aside in (False, True):
            if now[aside].ids:
                yield close(aside)
        now.clear()
        give_back()

    schema = f"aside boolean, bytes long, ids array<{kind.simpleString()}>, held_out array<boolean>, sizes array<long>, hashes binary, words binary"
    # a written row's place is the same whenever it is read again
    return materialise(d.mapInArrow(run, schema)).withColumn("block", F.monotonically_increasing_id())


def _sums(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What senders' rows (keys; parts: counts retained, then put aside) add up to: the keys, 2 x keys
    counts, and each row's places in them."""
    keys = [unpack_keys(x) for x in t["keys"].to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    places = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    total = np.zeros((2, len(every)), np.int64)
    for x, at in zip(t["parts"].to_pylist(), places, strict=True):
        total[:, at] += unpack_numbers(x, np.uint64).astype(np.int64).reshape(2, -1)
    return every, total, places


def _pack(x: np.ndarray) -> bytes:
    return pack_numbers(np.ascontiguousarray(x.astype(np.uint64)).reshape(-1))


def _cut(keys: np.ndarray, parts: np.ndarray, buckets: int, bits: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Packed rows of sorted keys and their counts for each bucket that they reach."""
    bounds = bucket_bounds(keys, buckets, bits).tolist()
    cuts = [(p, i, j) for p, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if j > i]
    return [p for p, _, _ in cuts], [pack_keys(keys[i:j]) for _, i, j in cuts], [_pack(parts[:, i:j]) for _, i, j in cuts]


TOTALS = ["tokens", "kinds", "retained", "kept_kinds"]


def _count(blocks: DataFrame, buckets: int, fanout: int, bits: int) -> DataFrame:
    """(block, aside, bucket, counts, totals): packed corpus counts of each block's keys, bucket after
    bucket; the totals stand in some row of each bucket."""
    first = min(buckets, fanout)

    def count(batches):
        for b in batches:
            for block, aside, held, *packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = Block(*packed, bits)
                counts = own.counts(~np.array(held, bool))
                parts = np.zeros((2, len(counts)), np.int64)
                parts[int(aside)] = counts
                to, keys, parts = _cut(own.keys, parts, first, bits)
                del own, counts
                give_back()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array([block] * len(to), pa.int64()), pa.array([aside] * len(to), pa.bool_()), pa.array(keys, pa.binary()), pa.array(parts, pa.binary())],
                    names=["bucket", "block", "aside", "keys", "parts"],
                )

    start = np.uint64((xxhash.xxh3_64_intdigest(START) >> (64 - bits)) & ~1)

    def answer(key, t):
        give_back()  # what the bucket before took
        every, total, places = _sums(t)
        words = (every & np.uint64(1) == 0) & (every != start)
        both, n = total.sum(0), len(t)
        found = [both[words].sum(), (both[words] > 0).sum(), total[0][words].sum(), (total[0][words] > 0).sum()]
        out = t.drop_columns(["keys", "parts"]).append_column("counts", pa.array([_pack(total[:, at]) for at in places], pa.binary()))
        for name, v in zip(TOTALS, found, strict=True):
            out = out.append_column(name, pa.array([int(v)] + [0] * (n - 1), pa.int64()))
        return out

    answered = "counts binary, " + ", ".join(f"{c} long" for c in TOTALS)
    sent = blocks.select("block", "aside", "held_out", "sizes", "hashes", "words").mapInArrow(count, "bucket int, block long, aside boolean, keys binary, parts binary")
    if first == buckets:
        return materialise(sent.groupBy("bucket").applyInArrow(answer, f"bucket int, block long, aside boolean, {answered}"))

    # relays: sent's buckets are pages of finer ones
    sent = materialise(sent.withColumnRenamed("bucket", "page").withColumn("region", F.expr(f"pmod(xxhash64(block), {max(1, -(-blocks.count() // fanout))})")))

    def relay(key, t):
        every, total, _ = _sums(t)
        to, keys, parts = _cut(every, total, buckets, bits)
        n = len(to)
        return pa.table({"bucket": pa.array(to, pa.int32()), "page": pa.array([key[0].as_py()] * n, pa.int32()), "region": pa.array([key[1].as_py()] * n, pa.int64()), "keys": pa.array(keys, pa.binary()), "parts": pa.array(parts, pa.binary())})

    passed = sent.groupBy("page", "region").applyInArrow(relay, "bucket int, page int, region long, keys binary, parts binary")
    finer = materialise(passed.groupBy("bucket").applyInArrow(answer, f"bucket int, page int, region long, {answered}"))

    def back(left, right):
        _, _, places = _sums(left)
        right = right.sort_by("bucket")
        total = np.concatenate([unpack_numbers(x, np.uint64).reshape(2, -1) for x in right["counts"].to_pylist()], 1)
        n = len(left)
        out = {"bucket": left["page"], "block": left["block"], "aside": left["aside"], "counts": pa.array([_pack(total[:, at]) for at in places], pa.binary())}
        return pa.table(out | {c: pa.array([sum(right[c].to_pylist())] + [0] * (n - 1), pa.int64()) for c in TOTALS})

    return materialise(sent.groupBy("page", "region").cogroup(finer.groupBy("page", "region")).applyInArrow(back, f"bucket int, block long, aside boolean, {answered}"))


def score_documents(
    docs: DataFrame, modulus=5, remainder=1, id_col="doc_id", text_col="text", block_bytes=1 << 22, bucket_bytes=1 << 22, fanout=1024, weights: np.ndarray | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-half unigrams, of all training tokens) and score (the model's), both log10 of the text.
    ``weights``: given instead of learned."""
    ship(docs.sparkSession)
    blocks = _blocks(docs, modulus, remainder, id_col, text_col, block_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = min(64, 22 + max(1, size).bit_length())  # under 3 keys for 2 bytes; one bit tells kinds apart
    answers = _count(blocks, max(1, -(-size // bucket_bytes)), fanout, bits)
    totals = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS]).first()
    forget_shuffles(docs.sparkSession)  # nothing reads the counting shuffle any more

    def counted(a: pa.Table) -> np.ndarray:
        """Counts of the block's keys in the retained part and in that put aside."""
        return np.concatenate([unpack_numbers(x, np.uint64).reshape(2, -1) for x in a.sort_by("bucket")["counts"].to_pylist()], 1).astype(np.int64)

    def read(t: pa.Table) -> tuple[Block, np.ndarray]:
        give_back()  # what the block before took
        row = t.to_pylist()[0]
        return Block(row["sizes"], row["hashes"], row["words"], bits), np.array(row["held_out"], bool)

    together = lambda b, a: b.groupBy("block").cogroup(a.select("block", "bucket", "counts").groupBy("block"))
    packed = blocks.select("block", "ids", "held_out", "sizes", "hashes", "words")

    def aside_tokens(t, a):
        """Table of the training tokens that were put aside, for the EM."""
        b, held = read(t)
        of, counts = b.of_documents(~held), counted(a)[0]
        cells = tabulate(*estimates(*(counts[x[of]] for x in (b.word, b.context, b.pair, b.first, b.triple)), totals.retained, totals.kept_kinds))
        return pa.table({k: pa.array(v, pa.float64() if k[0] == "p" else pa.int64()) for k, v in cells.items()})

    if weights is None:
        cells = together(packed.where(F.col("aside")), answers.where(F.col("aside"))).applyInArrow(aside_tokens, "cell long, n long, p1 double, p2 double, p3 double")
        # bounded by the resolution, whatever the corpus
        cells = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "p1", "p2", "p3")]).collect()
        n = np.array([r.n for r in cells], float)
        p = np.array([[r.n / (totals.kept_kinds + 1), r.p1, r.p2, r.p3] for r in cells]).reshape(-1, 4) / n[:, None]
        weights = expectation_maximisation(np.array([r.cell // BINS**3 for r in cells], int), p, n)
    tokens, kinds = totals.tokens, totals.kinds

    def score(t, a):
        b, held = read(t)
        counts, train = counted(a).sum(0), b.of_documents(~held)
        word = counts[b.word]
        base = np.log10((word + 0.5) / (tokens + 0.5 * (kinds + 1)))
        less = {k: counts[x] - np.where(train, b.own(x), 0) for k, x in (("word", b.word), ("pair", b.pair), ("triple", b.triple))}
        # a context stands in a document as often as it is a word, or pair, there; the start once
        first_token = np.zeros(len(word), bool)
        first_token[b.begin] = True
        start = counts[b.start] - train.astype(np.int64)
        before = lambda x: np.where(first_token, start, np.concatenate([x[:1], x[:-1]]))
        rest = tokens - np.where(train, b.of_documents(b.n), 0)
        row, p = estimates(less["word"], before(less["word"]), less["pair"], before(less["pair"]), less["triple"], 1, kinds)
        p[:, 1] /= np.maximum(rest, 1)
        p = (weights[row] * p).sum(1) if tokens else np.ones(len(word))
        per, n = b.per_document, len(b.n)
        return pa.table({
            "doc_id": t["ids"].combine_chunks().flatten(), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(b.n, pa.int64()), "n_known": pa.array(per((word > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array([tokens] * n, pa.int64()), "base_score": pa.array(per(base), pa.float64()), "score": pa.array(per(np.log10(p)), pa.float64()),
        })

    return together(packed, answers).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
