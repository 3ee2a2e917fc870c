"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's vector is the mean of the embeddings of its words' hashed letter n-grams; a linear
softmax over the learned languages follows.  Both are trained together by stochastic
gradient descent in numpy, on the driver, over a bounded sample: ``train_docs`` labelled
rows, those with the smallest hashes of their ids (hash order is a random order, the same
at every run).  A fifth of the sample is kept back: on it a temperature is fitted, and the
confidence below which ``reject_rate`` of its right answers would fall is the rejection
limit.  Confidence is 0.5 at most where two languages are level.

Since the softmax is linear, a text's logits are the mean of its words' logits: a worker
memoises them per word and never holds more than one batch of texts.

Defined cases: null text or text without a letter is ``und`` with score 0 and rejected;
without any labelled row every row is; rows with a null lang teach nothing; a text of any length
counts whole; languages of equal probability go to the first in their names' order; repeated rows
each get a row; columns other than id, text and lang are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holdout, per_text, ship, small, worker_memo

UNKNOWN = "und"
MEMO = 200_000


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash buckets, how many for each word) of the letters of every word, and of their 2-, 3- and
    4-grams with the word's ends marked, word by word."""
    letters = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in map(str.lower, words)]
    sizes = np.array([len(w) + 2 if w else 0 for w in letters], np.int64)
    code = np.frombuffer("".join(f"<{w}>" for w in letters if w).encode("utf-32-le", "surrogatepass"), np.uint32)
    after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters from here to the word's end
    word = np.repeat(np.arange(len(words)), sizes)
    found, owner, h = [], [], np.zeros(len(code), np.uint32)
    for n in range(1, 5):
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) ^ (code[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n))
        fits = after[: len(h)] >= n
        if n == 1:
            fits &= (code != ord("<")) & (code != ord(">"))
        found.append(h[fits])
        owner.append(word[: len(h)][fits])
    x = np.concatenate(found)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ((x ^ (x >> np.uint32(13))) % np.uint32(buckets)).astype(np.int64)[order], np.bincount(owner, minlength=len(words))


@dataclass
class LanguageModel:
    labels: list[str]
    logits: np.ndarray  # buckets x labels: embedding times weights
    temperature: float
    least: float  # confidence below which an answer is rejected

    def words(self, words: list[str]) -> np.ndarray:
        """Per word the sum of its subwords' logits, and their number."""
        ids, n = subwords(words, len(self.logits))
        out = np.zeros((len(words), len(self.labels) + 1))
        some = n > 0
        if len(ids):
            out[some, :-1] = np.add.reduceat(self.logits[ids], (np.cumsum(n) - n)[some], axis=0)
        out[:, -1] = n
        return out


def _features(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    count = Counter(text.split())
    found, n = subwords(list(count), buckets)
    ids, at = np.unique(found, return_inverse=True)
    w = np.bincount(at, np.repeat(np.fromiter(count.values(), np.float64, len(count)), n), len(ids))
    return ids, w / max(w.sum(), 1)


def train(rows: list[tuple[str, str]], buckets=1 << 15, dim=12, epochs=6, rate=2.0, reject_rate=0.002, seed=7) -> LanguageModel | None:
    """Fit the model to (text, lang) rows; None if they hold no letters."""
    data = [(*_features(t, buckets), lang) for t, lang in rows]
    data = [d for d in data if len(d[0])]
    if not data:
        return None
    labels = sorted({d[2] for d in data})
    at = {k: i for i, k in enumerate(labels)}
    rng = np.random.default_rng(seed)
    rng.shuffle(data)
    kept_back = data[: len(data) // 5] if len(data) >= 50 else data
    fit = data[len(data) // 5 :] if len(data) >= 50 else data
    E, W = rng.normal(0, 0.1, (buckets, dim)), np.zeros((dim, len(labels)))
    steps, k = epochs * len(fit), 0
    for _ in range(epochs):
        for j in rng.permutation(len(fit)):
            ids, w, lang = fit[j]
            step = rate * (1 - k / steps)
            k += 1
            v = w @ E[ids]
            z = v @ W
            p = np.exp(z - z.max())
            p /= p.sum()
            p[at[lang]] -= 1
            back = W @ p
            W -= step * np.outer(v, p)
            E[ids] -= (step * min(50, len(ids)) / 5) * np.outer(w, back)
    logits = E @ W
    Z = np.array([w @ logits[ids] for ids, w, _ in kept_back])
    y = np.array([at[d[2]] for d in kept_back])

    def soft(t):
        p = np.exp((Z - Z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    grid = np.geomspace(0.02, 50, 80)
    temperature = float(min(grid, key=lambda t: -np.log(np.maximum(soft(t)[np.arange(len(y)), y], 1e-12)).mean()))
    p = soft(temperature)
    right = p.max(1)[p.argmax(1) == y]
    least = min(0.5, float(np.quantile(right, reject_rate))) if len(right) else 0.5
    return LanguageModel(labels, logits, temperature, least)


def fit_sample(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", train_docs=3000, modulus=4, remainder=2) -> LanguageModel | None:
    """Train on at most ``train_docs`` labelled rows that aren't held out."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~holdout("doc_id", modulus, remainder))
    ids = labelled.select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("h")).orderBy("h", "doc_id").limit(train_docs)
    low = [r.h for r in ids.orderBy(F.desc("h")).limit(1).collect()]
    if not low:
        return None
    rows = labelled.where(F.xxhash64("doc_id", F.lit(3)) <= low[0]).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "text").limit(train_docs)
    return train([(r.text, r.lang) for r in rows.collect()])


class Predictor:
    """(lang, score, rejected) of whole texts; a memo holds the sums of words' logits."""

    def __init__(self, model: LanguageModel | None):
        self.model, self.place = model, {}
        self.sums = np.zeros((0, len(model.labels) + 1 if model else 0))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for i in range(0, len(texts), 500):
            out += self._few(texts[i : i + 500])
        return out

    def _few(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        m = self.model
        if m is None:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        words = [t.split() if t else [] for t in texts]
        if len(self.place) > MEMO:
            self.place, self.sums = {}, self.sums[:0]
        new = list(set().union(*words).difference(self.place))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.sums = np.concatenate([self.sums, m.words(new)])
        out = []
        for ws in words:
            total = self.sums[list(map(self.place.__getitem__, ws))].sum(0) if ws else [0.0]
            if not total[-1]:
                out.append((UNKNOWN, 0.0, True))
                continue
            z = total[:-1] / total[-1] / m.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            i = int(p.argmax())
            out.append((m.labels[i], min(1.0, float(p[i])), bool(p[i] < m.least)))
        return out


def predict(docs: DataFrame, model: LanguageModel | None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row.  lang_pred is a learned language wherever
    there is a letter; ``rejected`` tells those the model isn't sure of, and ``und``."""
    names = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    name = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x labels: bounded by its parameters

    def make():
        one = worker_memo(("langid", name), lambda: Predictor(sent.value))

        def f(texts):
            rows = one(texts)
            return {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return f

    return per_text(docs, make, names, id_col, text_col)


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", train_docs=3000, modulus=4, remainder=2) -> DataFrame:
    """Train on the labelled rows of ``docs``, then predict all of them; with held_out."""
    model = fit_sample(docs, id_col, text_col, lang_col, train_docs, modulus, remainder)
    return predict(docs, model, id_col, text_col).withColumn("held_out", holdout("doc_id", modulus, remainder))


def keep_sure(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", **options) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected, whole, filtered where they are."""
    ship(docs.sparkSession)
    name = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(fit_sample(docs, id_col, text_col, lang_col, **options))
    at = docs.columns.index(text_col)

    def run(batches):
        one = worker_memo(("langid", name), lambda: Predictor(sent.value))
        for b in small(batches):
            yield b.filter(pa.array([not r[2] for r in one(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
