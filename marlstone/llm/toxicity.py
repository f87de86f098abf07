"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and the L1 term keeps most weights at zero, so that the model is a short list
of indices and weights, at most 2**20 of them, which is what goes to the tasks. A word counts as itself and by its
beginnings, since languages that inflect put many endings on one stem.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, each_batch, held_out, sampled_texts

BITS, WORDS_KEPT = 20, 400_000
#: Pairs of words: next to each other, and with one or two words skipped between them.
GAPS = (1, 2, 3)
#: Lengths of the beginnings of words that count as words of their own.
STEMS = (4, 5, 6)
ALPHA, BETA, L2, EPOCHS = 1.0, 1.0, 0.0, 3
#: The L1 term for n rows is 0.13 * sqrt(n) within these bounds: what chance words gather grows that way.
L1_BOUNDS = (2.0, 10.0)
_A = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters (lower-cased), digits and all bytes beyond ASCII make words.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class WordHashes(dict):
    """Row numbers of distinct words in ``table``, which has the hash of each word and those of its beginnings."""

    def __init__(self) -> None:
        self.table = np.zeros((0, 1 + len(STEMS)), np.uint64)

    def learn(self, texts: list[list[bytes]]) -> None:
        """Afterwards all words of ``texts`` are known."""
        new = list(set().union(*texts) - self.keys())
        if len(self) + len(new) > WORDS_KEPT and self:
            self.clear()
            self.table, new = self.table[:0], list(set().union(*texts))
        if new:
            raw, lengths = np.frombuffer(b"".join(new), np.uint8).astype(np.uint64), np.array([len(w) for w in new])
            starts = np.cumsum(lengths) - lengths
            columns = [np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))]
            h = np.zeros(len(new), np.uint64)
            for i in range(max(STEMS)):  # a word that is shorter begins with all of itself
                h = np.where(lengths > i, h * np.uint64(257) + raw[starts + np.minimum(i, lengths - 1)] + np.uint64(1), h)
                if i + 1 in STEMS:
                    columns.append((h ^ np.uint64(1)) * _A)
            self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.stack(columns, 1)])


def features(texts: list[str | None], known: WordHashes) -> Iterator[np.ndarray]:
    """For each text the indices (not yet distinct) of its words, their beginnings, word pairs and skip-grams."""
    split = [(t or "").encode().translate(_WORDS).split() for t in texts]
    known.learn(split)
    shift = np.uint64(64 - BITS)
    for words in split:
        rows = known.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        h = rows[:, 0]
        out = [(rows * _A >> shift).astype(np.int64).ravel()]
        for gap in GAPS:
            if len(h) > gap:
                out.append(((h[:-gap] * _A + h[gap:] + np.uint64(gap)) * _A >> shift).astype(np.int64))
        yield np.concatenate(out)


#: Texts whose words are looked up together.
TEXTS_AT_ONCE = 200


@dataclass
class Model:
    """weights: dense over 2**BITS, mostly zero; bias is an unpenalised coordinate of its own."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], known: WordHashes) -> list[float]:
        """Probabilities of label 1; the presence of a feature counts, not how often it occurs."""
        out = []
        for at in features(texts, known):
            active = np.unique(at[self.weights[at] != 0])
            out.append(float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weights[active].sum()), -35, 35)))))
        return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, squared-gradient sums, bias) after ``epochs`` passes in shuffled order; rows hold distinct indices."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb, nb, bias = 0.0, 0.0, 0.0
    rng = np.random.default_rng(seed)
    l1 = float(np.clip(0.13 * len(rows) ** 0.5, *L1_BOUNDS))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = rows[r]
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            bias = -zb / ((BETA + nb**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[r]
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * bias
            nb += g * g
    return weights(z, n), n, -zb / ((BETA + nb**0.5) / ALPHA)


def _indices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(at, TEXTS_AT_ONCE)
            rows = [np.unique(x).astype(np.int32) for x in features(part.column(1).to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32())), part.column(2)], ["doc_id", "at", "label"])


def _train(sample: pa.Table) -> pa.Table:
    sample = sample.sort_by("doc_id")
    rows = [np.asarray(x.values) for x in sample.column("at")]
    w, _, bias = ftrl(rows, sample.column("label").to_numpy().astype(float))
    at = np.flatnonzero(w)
    return pa.table({"at": np.append(at, -1), "weight": np.append(w[at], bias)})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, longest: int = 20_000, label_column: str = "toxic") -> Model:
    """A model from at most ``max_rows`` labelled texts of at most ``longest`` characters outside the held-out fold
    (documented bounds; the same rows in every run).

    Tasks turn the texts into indices; one task then runs FTRL over this bounded sample, one row after the other, as the
    method has it. Only nonzero weights come to the driver. Of a repeated id the least text and the greatest label count.
    Null labels and ids don't count; without any row the model scores 0.5 for all.
    """
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col(label_column).isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label_column).cast("int").alias("label"))
    chosen = bounded_sample(labelled, "doc_id", max_rows).persist()
    try:
        short = docs.where(F.length("text") <= longest)
        rows = each_batch(sampled_texts(short, chosen, chosen.count()).withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text", "label"], "doc_id long, at array<int>, label int", _indices)
        got = rows.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(_train, "at long, weight double").toPandas()
    finally:
        chosen.unpersist()
    weights = np.zeros(1 << BITS)
    weights[got["at"][got["at"] >= 0]] = got["weight"][got["at"] >= 0]
    return Model(weights, float(got["weight"][got["at"] < 0].sum()))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    at = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), model.weights[at].astype(np.float32), model.bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = values
        model, known = Model(weights, bias), WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist(), known), pa.float64())], ["doc_id", "score"])

    out = each_batch(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), ["doc_id", "text"], "doc_id long, score double", run)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> DataFrame:
    """Trains on the labelled rows outside the held-out fold and scores every row of ``docs``.

    The text alone decides a score: labels, lang, source and doc_id are no inputs. A null or empty text gets the score of
    the bias. Repeated rows get one score. An empty table gives an empty result; other columns are not read.
    """
    return scored(docs, fit(docs, labels, max_rows))
