import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, source string, keep_id string, band int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], SCHEMA).repartition(3)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 48) - 1), min_size=1, max_size=300))
def test_rice_round_trip(values):
    x = np.array(sorted(values), np.uint64)
    k, unary, low = exact_dedup.rice_encode(x, 1 << 48)
    assert (exact_dedup.rice_decode(len(x), k, unary, low) == x).all()


def test_exact_groups_against_brute_force(spark):
    texts = ["a b", "A B", "a b ", "", None, "É", "é", "x" * 200_000, "X" * 200_000, "tie", "tie"]
    rows = list(enumerate(texts)) + [(11, "tie"), (11, "tie"), (None, "lone"), (12, "lone"), (None, "only")]
    got = {}
    for r in exact_dedup.exact_groups(frame(spark, rows)).collect():
        got.setdefault((r.doc_id, r.text_sha256), []).append((r.keep_id, r.group_size, r.kept))
    import hashlib

    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = {}
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want.setdefault((i, hashlib.sha256(t.encode()).hexdigest()), []).append((keep, len(ids), i == keep))
    assert got == want


def test_empty_tables(spark):
    empty = frame(spark, [(1, "x")]).where("false")
    assert exact_dedup.exact_groups(empty).count() == 0
    assert near_dedup.near_components(empty).count() == 0


def shingles(t):
    w = lower(t).encode().split()
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i, _ in rows]
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_components_against_brute_force(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for size in (1, 2, 3, 4, 5, 8, 20, 60, 150, 400):
        for _ in range(3):
            base = [r.choice(words) for _ in range(size)]
            rows.append((n, " ".join(base)))
            n += 1
            for share in (0.01, 0.03, 0.05, 0.06, 0.1):
                rows.append((n, " ".join(r.choice(words) if r.random() < share else w.upper() for w in base)))
                n += 1
    middle = [r.choice(words) for _ in range(120)]  # near copies that link with the middle more than with each other
    for _ in range(60):
        copy = list(middle)
        for _ in range(3):
            copy[r.randrange(120)] = "z" + str(r.randrange(10**6))
        rows.append((n, " ".join(copy)))
        n += 1
    rows += [(n, " ".join(middle)), (n + 1, ""), (n + 2, None), (n + 3, " \t\n")]
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_components(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_near_components_repeats_and_missing_ids(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "A B C D E"), (None, "a b c d e"), (9, "q")]
    got = sorted(tuple(x) for x in near_dedup.near_components(frame(spark, rows)).na.fill(-1).collect())
    assert got == [(-1, 2, -1, True), (3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (9, 1, 9, True)]


def test_small_documents_sketch_alike():
    h = near_dedup.shingle_hashes("one two three four five")
    assert len(h) == 2
    keys = near_dedup.band_keys(np.stack([near_dedup.registers(h)] * 2))
    assert (keys[0] == keys[1]).all() and len(set(keys[0])) == near_dedup.BANDS


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    both, a, b = rng.integers(0, 1 << 63, 800), rng.integers(0, 1 << 63, 100), rng.integers(0, 1 << 63, 100)
    x, y = (near_dedup.registers(np.unique(np.concatenate([both, v]).astype(np.uint64) * np.uint64(2))) for v in (a, b))
    got = near_dedup.estimate(x[None], y[None], np.array([900.0]), np.array([900.0]))[0]
    assert abs(got - 0.8) < 0.12


def test_components_in_one_task_and_in_many(spark, monkeypatch):
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 300)]
    links = chain + [(1000 + r.randrange(400), 1000 + r.randrange(400)) for _ in range(150)] + [(5000, 5000 + i) for i in range(1, 200)]
    links = [(a, b) for a, b in links if a != b]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in list(parent)}
    df = spark.createDataFrame([(min(x), max(x)) for x in links], "a long, b long")
    for limit in (10**6, 100):
        monkeypatch.setattr(near_dedup, "LINKS_A_TASK", limit)
        got = near_dedup.components(df).collect()
        assert len(got) == len(want) and {x.id: x.component for x in got} == want


def test_rare_shingles_meet_all_links(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(6):
        base = [r.choice(words) for _ in range(40 + 30 * g)]
        for _ in range(12):
            share = r.choice((0.0, 0.01, 0.02, 0.04, 0.08))
            rows.append((len(rows), " ".join(r.choice(words) if r.random() < share else w for w in base)))
    apart = spark.createDataFrame([(0, i, i) for i, _ in rows], "band long, id long, component long")
    got = {(x.a, x.b) for x in near_dedup._by_rare_shingles(frame(spark, rows).select("doc_id", "text"), apart).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want and want <= got and all(a < b for a, b in got)
