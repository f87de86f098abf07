"""The pipeline's mix has documents as they are, the one at a source's boundary too."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import mixing

from .test_mixing_and_pipeline import frame, wanted_targets


@pytest.mark.parametrize("seed", range(2))
def test_every_reading_is_whole(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, "\n".join(f"w{i}  x" for _ in range(int(rng.integers(0, 60)))), ["a", "b", "c", None][int(rng.integers(4))]) for i in range(300)]
    rows += [(1000, "long\ntext " * 3000, "b")]
    sizes, of = defaultdict(int), {i: (t, s) for i, t, s in rows}
    for _, t, s in rows:
        sizes[s] += len(t.split())
    taken = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    got = mixing.mixed_documents(frame(spark, rows)).collect()
    assert all(r.text == of[r.doc_id][0] and r.n_chars == len(r.text) for r in got)
    times, words, nearest = Counter(r.doc_id for r in got), defaultdict(int), defaultdict(float)
    for i, k in times.items():
        words[of[i][1]] += k * taken[i].size
    for i, r in taken.items():
        if r.size and r.taken % r.size:
            assert times[i] in (r.taken // r.size, r.taken // r.size + 1)
            nearest[of[i][1]] += r.size / 2  # one document of a source at most
        else:
            assert times[i] == (r.taken // r.size if r.size else 0)
    assert nearest and max(times.values()) <= 3
    for s, want in wanted_targets(sizes).items():
        assert abs(words[s] - want) <= nearest[s] + 0.5 + 1e-6


def test_language_training_in_blocks_and_within_its_bound(monkeypatch):
    """Blocks change nothing but the order of sums; what is over the bound goes by whole texts, of each language alike."""
    from marlstone.llm import language_id as L

    r = np.random.default_rng(0)
    vocabulary = {x: ["".join(r.choice(list("abcdef" + x), 5)) for _ in range(60)] for x in "xyz"}
    langs = ["xyz"[i % 3] for i in range(45)]
    texts = [" ".join(r.choice(vocabulary[x], int(r.integers(1, 90)))) for x in langs]
    whole = L.train(texts, langs, steps=20)
    monkeypatch.setattr(L, "TRAIN_CELLS", 700)
    parts = L.train(texts, langs, steps=20)
    assert np.allclose(whole.weights, parts.weights, atol=1e-9) and np.allclose(whole.transitions, parts.transitions, atol=1e-9) and np.allclose(whole.start, parts.start, atol=1e-9)
    docs = [([b"w"] * n, y) for n, y in ((5, 0), (50, 0), (5, 1), (5, 0), (400, 2), (6, 1))]
    assert L._within(docs, 3, 1000, np.random.default_rng(1)) == docs
    kept = L._within(docs, 3, 90, np.random.default_rng(1))
    assert {y for _, y in kept} == {0, 1, 2} and all(d in docs for d in kept) and [d for d in docs if d in kept] == kept


def test_messages_stay_in_proportion_to_rows():
    from marlstone.llm import exact_dedup as E

    for rows in (10**6, 10**9, 25 * 10**9, 60 * 10**9):
        owners = max(8, -(-rows // E.OWNER_ROWS))
        senders = max(8, -(-rows // E.chunk_rows(owners)))
        assert senders * owners <= rows // E.A_MESSAGE * 1.1 + 8 * 8
