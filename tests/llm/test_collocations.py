"""op12: the whole report against brute force, summaries against true counts, words as the contract cuts them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from marlstone.llm import collocations as C


def pieces(text: str | None) -> list[list[str]]:
    lower = (text or "").translate(str.maketrans(C.ASCII_UPPER, C.ASCII_LOWER))
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least: int, top: int):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, C.LONGEST + 1):
                for i in range(len(p) - k + 1):
                    f[lang, tuple(p[i : i + k])] += 1
    out = []
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for (lang, w), a in candidates.items():
        if any(l2 == lang and len(w2) > len(w) and 100 * a2 >= C.INSIDE * a and any(w2[i : i + len(w)] == w for i in range(len(w2) - len(w) + 1)) for (l2, w2), a2 in candidates.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    report = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        report += [(lang, i, *o[1:]) for i, o in enumerate(own, 1)]
    return sorted(report)


def run(spark, rows, least=C.LEAST, top=C.TOP):
    df = spark.createDataFrame([(t, g, i % 3, "x") for i, (t, g) in enumerate(rows)], "text string, lang string, f int, phrase string").repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed: int, n: int):
    rng = random.Random(seed)
    words = ["New", "york", "city", "Émile", "émile", "a\x1cb", "x", "Ünder", "state", "of", "the", "art", "𝄞"]
    fixed = ["new york city", "state of the art", "the  art\tof", "x x x x"]

    def text():
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        return "".join(p + rng.choice([" ", " ", " ", "\t", ". ", "\n", "\r\n", "!", ":"]) for p in parts)

    return [(text(), rng.choice(["en", "en", "en", "fr", None, "und"])) for _ in range(n)]


def test_report_equals_brute_force(spark):
    rows = [*made(1, 150), (None, "en"), ("", "fr"), (None, None), ("x " * 20_000, "en"), *[("near copies of the whole text", "de")] * 40]
    assert run(spark, rows, least=5) == brute(rows, 5, C.TOP)
    assert run(spark, rows, least=30, top=3) == brute(rows, 30, 3)


def test_small_sums_blocks_and_many_owners(spark, monkeypatch):
    monkeypatch.setattr(C, "OWNER_MASS", 200)
    rows = made(2, 120)
    assert run(spark, rows, least=6) == brute(rows, 6, C.TOP)


def test_empty_table_and_texts_without_words(spark):
    assert run(spark, []) == [] == run(spark, [(" .,", "en"), (None, None)])


def test_words_and_pieces():
    texts = ["A b.C  d\te", None, "", "É f\x0bg", "last", "first"]
    words, piece = C.cut(pa.array([t for t in texts if t is not None]))
    want = [(w, (i, j)) for i, t in enumerate(t for t in texts if t is not None) for j, p in enumerate(pieces(t)) for w in p]
    assert words.to_pylist() == [w for w, _ in want]
    places = [p for _, p in want]
    assert all((piece[i] == piece[i + 1]) == (places[i] == places[i + 1]) for i in range(len(places) - 1))


def test_a_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(4)
    for capacity in (5, 20, 200):
        keys = np.concatenate([rng.zipf(1.3, 4000).clip(0, 10**6), rng.integers(0, 10**6, 2000)]).astype(np.uint64)
        summary, true = C.Summary(capacity), Counter(keys.tolist())
        for part in np.array_split(rng.permutation(keys), 17):
            k, c = np.unique(part, return_counts=True)
            summary.merge(k, c)
        assert len(summary.keys) <= capacity and summary.short <= len(keys) / (capacity + 1)
        kept = dict(zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
        assert all(true[k] - summary.short <= kept.get(k, 0) <= true[k] for k in true)
        least = len(keys) // capacity + 1
        assert {k for k, n in true.items() if n >= least} <= set(summary.maybe(least).tolist())
