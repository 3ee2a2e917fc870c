"""Packing token sequences: first-fit decreasing with a tournament tree, in random groups.

A document's ids are cut into pieces of at most the capacity: full pieces are sequences of
their own, and the rest is packed.  The pieces are written once, then dealt into groups of
about ``group_pieces`` by the hash of their place in what was written, so that neither a
very long document nor any number of equal rows makes a group larger.  Each group is packed
on its own by first-fit decreasing, where a tournament tree over the bins' free space finds
the first bin that fits in O(log n).  A group's memory is a few numbers a piece, and nothing
crosses groups, so padding stays at about half a sequence a group and groups run on any
executor.

Defined cases: a null text is the empty one (only the end id); a null id is kept; a text of
any length is encoded whole; pieces of equal length are placed in the order of id and start
(equal rows in any order, as they are interchangeable); repeated rows are packed each for
itself; columns other than the id and the text are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from contextlib import contextmanager

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, per_text, worker_memo

#: Entries of the memos of words and of pieces; beyond it they are encoded each time.
MEMO = 900_000
#: White space for Python's split() that the tokenizer's pattern doesn't take for white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class FirstFitTree:
    """Free space of the bins in the leaves, the larger child in every inner node."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.size)

    def take(self, need: int) -> tuple[int, int]:
        """Put ``need`` into the first bin with room; (bin, where in it is given by the room before)."""
        most, i = self.most, 1
        while i < self.size:
            i *= 2
            i += most[i] < need
        room = most[i]
        most[i] = room - need
        at = i - self.size
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return at, room


def first_fit_decreasing(lengths, capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, 0 < length <= capacity; equal lengths keep their order."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    tree = FirstFitTree(len(lengths), capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bins[i], room = tree.take(lengths[i])
        offsets[i] = capacity - room
    return bins, offsets


class WordEncoder:
    """Ids of whole texts as little-endian bytes.  The tokenizer drops white space and merges
    within the pieces of its pattern only, so words are encoded apart and memoised.  On ASCII its
    normaliser only lower-cases, so the pattern gives an ASCII word's pieces, and their ids are
    memoised too.  Other words change under normalisation in ways of their own: they are encoded in
    lines, and each id is a word's from whose characters the tokenizer says it came."""

    #: Fixed value: the tokenizer's pattern, of normalised text.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    LINE = 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, new: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces of ASCII; the last id of a piece is one that ends a word."""
        out = {}
        for i in range(0, len(new), self.LINE):
            line = new[i : i + self.LINE]
            data = self.plain([" ".join(line)])[0]
            stops = ((np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1) * 4).tolist()
            if len(stops) != len(line):
                raise AssertionError(f"{len(stops)} pieces where the pattern says {len(line)}")
            out.update((w, data[a:b]) for w, a, b in zip(line, [0, *stops[:-1]], stops, strict=True))
        return out

    def _others(self, new: list[str]) -> dict[str, bytes]:
        """Ids of distinct words of any characters, none of which may hold a special token."""
        out = {}
        lines = [new[i : i + self.LINE] for i in range(0, len(new), self.LINE)]
        for line, e in zip(lines, self.tokenizer.encode_batch([" ".join(line) for line in lines], add_special_tokens=False), strict=True):
            stops = np.cumsum([len(w) + 1 for w in line])  # each word, and the blank behind it
            of = np.searchsorted(stops, np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0], "right")
            cuts = np.searchsorted(of, np.arange(len(line) + 1)) * 4
            data = np.array(e.ids, "<u4").tobytes()
            if (np.diff(of) < 0).any():
                raise AssertionError("the tokenizer's ids are out of order")
            out.update((w, data[a:b]) for w, a, b in zip(line, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return out

    def words(self, new: list[str]) -> dict[str, bytes]:
        special = [w for w in new if "<|" in w]  # may begin a special token
        out = dict(zip(special, self.plain(special), strict=True))
        out |= self._others([w for w in new if not w.isascii() and w not in out])
        parts = {w: [w.lower()] if w.isalpha() else self.PIECES.findall(w.lower()) for w in new if w not in out}
        with extended(self.pieces, self._pieces(list(set().union(*parts.values()).difference(self.pieces)))) as known:
            out.update((w, b"".join([known[p] for p in ps])) for w, ps in parts.items())
        return out

    def batch(self, texts: list[str], at_once: int = 250) -> list[bytes]:
        out = []
        for i in range(0, len(texts), at_once):
            part = [t.split() if not any(c in t for c in SEPARATORS) else [t] for t in texts[i : i + at_once]]
            found = [list(map(self.memo.get, ws)) for ws in part]
            new = {w for ws, ids in zip(part, found, strict=True) if None in ids for w, x in zip(ws, ids, strict=True) if x is None}
            whole = [w for ws, t in zip(part, texts[i : i + at_once], strict=True) if ws == [t] for w in ws if w in new]
            fresh = self.words(list(new.difference(whole))) | dict(zip(whole, self.plain(whole), strict=True))
            out += [b"".join(ids if None not in ids else [fresh[w] if x is None else x for w, x in zip(ws, ids, strict=True)]) for ws, ids in zip(part, found, strict=True)]
            if len(self.memo) + len(fresh) <= MEMO:
                self.memo.update(fresh)
        return out


@contextmanager
def extended(memo: dict, fresh: dict):
    """``memo`` with ``fresh``, which stay if there is room."""
    memo.update(fresh)
    try:
        yield memo
    finally:
        if len(memo) > MEMO:
            for k in fresh:
                del memo[k]


def encoder(path: str) -> WordEncoder:
    return worker_memo(("packing", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """(doc_id, pieces array<struct<start, length, ids_crc32[, ids]>>, doc_tokens) per row."""
    kind = "array<struct<start:bigint,length:bigint,ids_crc32:bigint" + (",ids:array<int>" if with_ids else "") + ">>"
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        enc = encoder(path)

        def f(texts):
            cut, totals = [], []
            for data in enc.batch(texts):
                data += end
                totals.append(len(data) // 4)
                row = []
                for a in range(0, len(data), 4 * capacity):
                    part = data[a : a + 4 * capacity]
                    piece = {"start": a // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                    row.append(piece | ({"ids": np.frombuffer(part, "<u4").astype("i4").tolist()} if with_ids else {}))
                cut.append(row)
            return {"pieces": cut, "doc_tokens": totals}

        return f

    return per_text(docs, make, {"pieces": kind, "doc_tokens": "long"}, id_col, text_col)


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, group_pieces: int = 16384, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids).  sequence_id is unique over the result: group * 2**32 + bin."""
    p = pieces(docs, path, end_id, capacity, id_col, text_col, with_ids)
    flat = materialise(p.select("doc_id", "doc_tokens", F.explode("pieces").alias("p")).select("doc_id", "doc_tokens", "p.*"))
    groups = max(1, -(-flat.count() // group_pieces))
    # a written row's place is the same whenever it is read again, unlike that of a row behind a shuffle
    flat = flat.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(17)), F.lit(groups)))
    kind = p.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.replace(", ", ",").split(",")]

    def run(key, t):
        import pyarrow as pa

        group = int(key[0].as_py())
        order = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(order["length"].to_pylist(), capacity)
        order = order.append_column("sequence_id", pa.array([group << 32 | b for b in bins], pa.int64()))
        return order.append_column("offset", pa.array(offsets, pa.int64())).select(names)

    return flat.groupBy("group").applyInArrow(run, schema)
