"""Language identification by a linear-chain conditional random field over words.

Each word has features (the word itself, its affixes and its letter n-grams, hashed) that score the languages; learned
transitions tie neighbouring words; forward-backward gives each word's probabilities, in code-switched text too. A
document's language is the one with the largest mean over its words; runs of words of one language are its spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import each_batch, held_out, sampled_texts

BITS, WORDS_KEPT = 17, 300_000
TRAIN_STEPS, CHUNK = 40, 400
_A = np.uint64(0x9E3779B97F4A7C15)
#: Letters after lower-casing A-Z, and all bytes beyond ASCII, make words; no digits, no ASCII signs.
_WORDS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all words end to end, number of features of each).

    The word itself (lexicon), prefixes and suffixes of one to four bytes, and byte n-grams of two and three with marks at
    both ends of the word.
    """
    raw = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    starts, number = np.cumsum(lengths) - lengths, np.arange(len(words))
    of = np.repeat(number, lengths)

    def index(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * _A
        return ((h ^ (h >> np.uint64(29))) * _A >> np.uint64(64 - BITS)).astype(np.int64)

    def run(at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for i in range(n):
            h = h * np.uint64(257) + raw[at + i]
        return h

    flat, owner = [index(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), 1)], [number]
    for n in (2, 3):
        at = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
        flat.append(index(run(at, n), 10 + n))
        owner.append(of[at])
    for n in (1, 2, 3, 4):
        long = number[lengths - 2 >= n]
        flat += [index(run(starts[long] + 1, n), 20 + n), index(run(starts[long] + lengths[long] - 1 - n, n), 30 + n)]
        owner += [long, long]
    owner = np.concatenate(owner)
    return np.concatenate(flat)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # 2**BITS rows, a column for each language
    transitions: np.ndarray  # from, to
    start: np.ndarray


def emissions(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    flat, sizes = word_features(words)
    flat = weights[flat]
    return np.add.reduceat(flat, np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward over padded sequences (batch, time, language); rows in descending order of length.

    Gives the probabilities of each word's language, the log partition of each sequence and, on request, the expected
    number of each transition. Probabilities are scaled at every step, so length does no harm.
    """
    batch, steps, k = scores.shape
    top = scores.max(2, keepdims=True)
    emit, move = np.exp(scores - top), np.exp(transitions)
    alive = (lengths[None, :] > np.arange(steps)[:, None]).sum(1)  # sequences that reach each step: the first ones
    forward, scale = np.zeros((steps, batch, k)), np.ones((steps, batch))
    a = np.exp(start)[None, :] * emit[:, 0]
    scale[0] = a.sum(1)
    forward[0] = a / scale[0][:, None]
    for t in range(1, steps):
        n = alive[t]
        a = (forward[t - 1, :n] @ move) * emit[:n, t]
        scale[t, :n] = a.sum(1)
        forward[t, :n] = a / scale[t, :n, None]
    backward = np.ones((batch, k))
    out, moved = np.zeros((batch, steps, k)), np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        out[:n, t] = forward[t, :n] * backward[:n]
        if t:
            b = emit[:n, t] * backward[:n] / scale[t, :n, None]
            if pairs:
                moved += forward[t - 1, :n].T @ b
            backward[:n] = b @ move.T
    real = lengths[:, None] > np.arange(steps)[None, :]
    log_z = np.log(scale.T).sum(1, where=real) + (top[:, :, 0] * real).sum(1)
    return out, log_z, moved * move


#: Cells (words times languages) that a training step holds at once, about 32 MB in each of a few arrays.
TRAIN_CELLS = 4_000_000


def _within(docs: list[tuple[list[bytes], int]], k: int, most_words: int, rng: np.random.Generator) -> list[tuple[list[bytes], int]]:
    """The texts, if they have at most ``most_words`` words; else of each language whole texts by chance, up to its share."""
    if sum(len(w) for w, _ in docs) <= most_words:
        return docs
    held, out = [0] * k, []
    for i in rng.permutation(len(docs)):
        words, y = docs[i]
        if not held[y] or held[y] + len(words) <= most_words // k:
            held[y] += len(words)
            out.append((int(i), docs[i]))
    return [d for _, d in sorted(out, key=lambda x: x[0])]


def train(texts: list[str], langs: list[str], steps: int = TRAIN_STEPS, seed: int = 11, most_words: int = 500_000) -> Crf:
    """A model from labelled whole texts and code-switched sequences made of runs of words of several of them.

    ``most_words`` bounds the labelled words (a documented bound; half as many texts again are code-switched): with it and
    TRAIN_CELLS, 100 languages are trained in less than 2 GB.
    """
    languages = sorted(set(langs))
    k, rng = len(languages), np.random.default_rng(seed)
    docs = [(w, languages.index(y)) for t, y in zip(texts, langs, strict=True) if (w := words_of(t))]
    model = Crf(languages, np.zeros((1 << BITS, max(k, 1))), np.zeros((k, k)), np.zeros(k))
    if not docs or k < 2:
        return model
    docs = _within(docs, k, most_words, np.random.default_rng(seed))
    sequences: list[tuple[list[bytes], list[int]]] = []
    for words, y in docs:
        sequences += [(words[i : i + CHUNK], [y] * len(words[i : i + CHUNK])) for i in range(0, len(words), CHUNK)]
    for _ in range(len(docs) // 2):
        words, labels = [], []
        for _ in range(int(rng.integers(2, 5))):
            w, y = docs[int(rng.integers(len(docs)))]
            i, n = int(rng.integers(len(w))), int(rng.integers(10, 80))
            words, labels = words + w[i : i + n], labels + [y] * len(w[i : i + n])
        sequences.append((words, labels))
    sequences.sort(key=lambda s: -len(s[0]))
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in s]) for s, _ in sequences]
    flat, sizes = word_features(list(number))
    of = np.repeat(np.arange(len(sizes)), sizes)
    used, flat = np.unique(flat, return_inverse=True)
    root = np.sqrt(sizes)[:, None]
    # blocks of sequences of like length, so that what a step holds for them is bounded whatever the languages
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    counted, at = np.zeros((k, k)), 0
    while at < len(rows):
        size = max(1, TRAIN_CELLS // (k * len(rows[at])))
        lengths = np.array([len(r) for r in rows[at : at + size]])
        padded, gold = np.zeros((len(lengths), lengths[0]), np.int64), np.full((len(lengths), lengths[0]), -1)
        for i, (r, (_, y)) in enumerate(zip(rows[at : at + size], sequences[at : at + size], strict=True)):
            padded[i, : len(r)], gold[i, : len(r)] = r, y
        both = gold[:, 1:] >= 0
        np.add.at(counted, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        blocks.append((padded, gold, gold >= 0, lengths))
        at += size
    total = sum(int(real.sum()) for _, _, real, _ in blocks)
    # words whose features are looked up at once
    ends = np.cumsum(sizes)
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(0, ends[-1], max(1, TRAIN_CELLS // k)), side="left"), len(sizes)])
    w, move, start = np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(x, 1e-8) for x in (w, move, start)]
    starts = ends - sizes
    for _ in range(steps):  # AdaGrad on the mean log likelihood, with a little L2
        e = np.concatenate([np.add.reduceat(w[flat[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], axis=0) for i, j in zip(cuts, cuts[1:], strict=False)]) / root
        d, moved, first = np.zeros((len(sizes), k)), np.zeros((k, k)), np.zeros(k)
        for padded, gold, real, lengths in blocks:
            p, _, m = marginals(e[padded], lengths, move, start, pairs=True)
            diff = -p[real]
            diff[np.arange(len(diff)), gold[real]] += 1
            for c in range(k):
                d[:, c] += np.bincount(padded[real], diff[:, c], len(sizes))
            moved += m
            first += np.bincount(gold[:, 0], minlength=k) - p[:, 0].sum(0)
        d /= root
        g = np.stack([np.bincount(flat, d[of, c], len(used)) for c in range(k)], 1) / total - 1e-7 * w
        steps_of = ((w, g, 0.5), (move, (counted - moved) / total - 1e-6 * move, 0.2), (start, first / total - 1e-6 * start, 0.2))
        for (x, gx, rate), s in zip(steps_of, sums, strict=True):
            s += gx * gx
            x += rate * gx / np.sqrt(s)
    model.weights[used], model.transitions, model.start = w, move, start
    return model


class Tagger:
    """Scores distinct words once and remembers them from document to document."""

    def __init__(self, model: Crf):
        self.model, self.numbers, self.rows = model, {}, np.zeros((0, len(model.languages)), np.float32)

    def _scores(self, words: list[bytes]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, probability, spans) of each text; a span is (first word, last word, language)."""
        model = self.model
        split = [words_of(t) for t in texts]
        if len(self.numbers) > WORDS_KEPT:
            self.numbers, self.rows = {}, self.rows[:0]
        new = list(set().union(*split) - self.numbers.keys())
        if new:
            self.numbers.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *(emissions(new[i : i + 20_000], model.weights).astype(np.float32) for i in range(0, len(new), 20_000))])
        out: list[tuple[str, float, list]] = [("und", 0.0, [])] * len(texts)
        order = sorted((i for i, w in enumerate(split) if w and has_letter(texts[i])), key=lambda i: -len(split[i]))
        while order and model.languages:
            # sequences of like length together, at most 400,000 cells of padding at a time
            size = max(1, min(512, 400_000 // len(split[order[0]])))
            group, order = order[:size], order[size:]
            lengths = np.array([len(split[i]) for i in group])
            scores = np.zeros((len(group), lengths[0], len(model.languages)))
            for r, i in enumerate(group):
                scores[r, : lengths[r]] = self._scores(split[i])
            p = marginals(scores, lengths, model.transitions, model.start)[0]
            mean, best = p.sum(1) / lengths[:, None], p.argmax(2)
            for r, i in enumerate(group):
                of = best[r, : lengths[r]]
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), lengths[r]]
                most = int(np.argmax(mean[r]))
                out[i] = (model.languages[most], float(min(1.0, mean[r, most])), [(a, int(b) - 1, model.languages[of[a]]) for a, b in zip(cuts, cuts[1:], strict=False)])
        return out


def fit(docs: DataFrame, per_language: int = 120, longest: int = 20_000, most_languages: int = 100) -> Crf:
    """A model from whole texts of at most ``longest`` characters, at most ``per_language`` of each of at most
    ``most_languages`` languages, those with most rows (documented bounds), outside the held-out fold: the texts with the
    least hash of their id. Of a repeated id the least language and the least text count."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id") & (F.length("text") <= longest))
    common = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages).select("lang")
    rows = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(common), "lang", "left_semi")
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= per_language)
    chosen = first.groupBy("doc_id").agg(F.min("lang").alias("lang")).persist()
    try:
        got = sampled_texts(docs.where(F.length("text") <= longest), chosen, per_language * most_languages).toPandas().sort_values("doc_id")
    finally:
        chosen.unpersist()
    return train(got["text"].tolist(), got["lang"].tolist())


def languages(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans for every row of ``docs``.

    spans has the runs of words that the chain gives to one language: first_word, last_word (from 0) and lang, so that
    code-switched text shows its parts; words are runs of letters as words_of() cuts them. A null text, or one without a
    letter, is 'und' with score 0 and no spans, and so is all text if no language was learned. Repeated rows get one
    answer. An empty table gives an empty result; other columns are not read.
    """
    model = model or fit(docs)
    used = np.flatnonzero(model.weights.any(1))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, used.astype(np.int32), model.weights[used].astype(np.float32), model.transitions, model.start))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, used, values, transitions, start = shared.value
        weights = np.zeros((1 << BITS, max(1, len(names))), np.float32)
        weights[used] = values
        tagger = Tagger(Crf(names, weights, transitions, start))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = tagger.label(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([[dict(zip(("first_word", "last_word", "lang"), x, strict=True)) for x in g[2]] for g in got], SPANS)], ["doc_id", "lang_pred", "score", "spans"])

    out = each_batch(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), ["doc_id", "text"], "doc_id long, lang_pred string, score double, spans array<struct<first_word: int, last_word: int, lang: string>>", run)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "spans")
