"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

A text is split by the vocabulary's pattern.  Each piece's bytes are mapped to Latin-1 so
that the automaton can match them; the matches give, for every start, the tokens that
begin there, longest first.  The encoder takes the longest, and backs up when a token can't
stand next to its predecessor.  Two tokens are compatible when merging their joined bytes
gives the two tokens back; that is memoised, and a position found dead is never entered
again, so a piece takes linear time.  The result equals the exact rank-by-rank merges.

Defined cases: a null text is the empty one, which has no tokens and decodes to no bytes;
a null id is kept; a text of any length is encoded whole, piece by piece; matches that begin
together are of different lengths, so nothing ties; repeated rows each get a row; columns other
than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, worker_memo

#: Entries of the memos of pieces and of pairs; a full memo is emptied.
MEMO = 400_000


class BytePairCoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.auto = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.auto.add_word(b.decode("latin-1"), (len(b), i))
        self.auto.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, str]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "BytePairCoder":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """The defining procedure, for short inputs: join the leftmost pair of lowest rank, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        if (one := self.ranks.get(data)) is not None:
            return [one]
        n = len(data)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, token) in self.auto.iter(data.decode("latin-1")):
            starts[end + 1 - size].append((size, token))  # ends rise, so sizes do
        out: list[int] = []
        tries = [len(starts[0])]  # per depth: the options not yet tried at that start, longest last
        at, dead = [0], bytearray(n + 1)
        while at[-1] < n:
            pos, options = at[-1], starts[at[-1]]
            k = tries[-1]
            while k:
                k -= 1
                size, token = options[k]
                if not dead[pos + size] and self.stands(token) and (not out or self.compatible(out[-1], token)):
                    tries[-1] = k
                    out.append(token)
                    at.append(pos + size)
                    tries.append(len(starts[pos + size]) if pos + size < n else 0)
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[pos] = 1
                out.pop(), at.pop(), tries.pop()
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in self.encode_piece(p.encode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha256 of the decimal ids, sha256 of the decoded bytes)."""
        memo = self.pieces
        total, decimals, decoded = 0, [], []
        for p in self.split(text):
            if (known := memo.get(p)) is None:
                ids = self.encode_piece(p.encode("utf-8", "surrogatepass"))
                if len(memo) >= MEMO:
                    memo.clear()
                known = (len(ids), ",".join(map(str, ids)), self.decode(ids))
                if len(p) <= 64:
                    memo[p] = known
            total += known[0]
            decimals.append(known[1])
            decoded.append(known[2])
        return total, hashlib.sha256(",".join(decimals).encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()


def coder(path: str, pattern: str) -> BytePairCoder:
    """One coder per worker process."""
    return worker_memo(("bpe", path, pattern), lambda: BytePairCoder.from_file(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids array<int>) per row."""

    def make():
        c = coder(path, pattern)
        return lambda texts: {"ids": [c.encode(t) for t in texts]}

    return per_text(docs, make, {"ids": "array<int>"}, id_col, text_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids); null ids decode to no bytes."""

    def make():
        c = coder(path, pattern)
        return lambda _, ids: {"data": [c.decode(i or []) for i in ids]}

    return per_text(encoded.withColumn("text", F.lit("")), make, {"data": "binary"}, extra={"ids": F.col("ids")})


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: encoding and decoding in one pass."""
    names = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def make():
        c = coder(path, pattern)

        def f(texts):
            rows = [c.digest(t) for t in texts]
            return {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return f

    return per_text(docs, make, names, id_col, text_col)
