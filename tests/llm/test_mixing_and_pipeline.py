import hashlib

import numpy as np
import pytest

from marlstone.llm import mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def wanted_targets(sizes):
    """By the rule itself: share, cap, share the excess again, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, total = {}, set(order), float(sum(sizes.values()))
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join("w" for _ in range(int(rng.integers(0, 60)))), ["a", "b", "Z", None, "hot", "hot", "hot", "tiny"][int(rng.integers(8 if i % 40 == 0 else 7))]) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "nothing"), (1002, "one\x0btwo three", "lone"), (7, "w w w", rows[7][2])]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    source = {i: s for i, _, s in rows}
    want, taken = wanted_targets(sizes), {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions) and all(r.position is None for r in got[len(positions) :])
    again = mixing.mix(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    if seed == 0:
        import duckdb

        con = duckdb.connect()
        con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
        con.executemany("insert into documents values (?, ?, ?)", rows)
        want = con.execute(mixing.ORACLE)
        names = [d[0] for d in want.description]
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(round(r[n], 9) if n == "position" and r[n] is not None else r[n] for n in names)) for r in got)


def test_mixed_documents(spark):
    rows = [(i, f"a{i} b  c\nd", "x") for i in range(30)] + [(100 + i, "p q r", "y") for i in range(4)]
    docs = frame(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words, texts = {}, dict((i, t) for i, t, _ in rows)
    for r in out.collect():
        n = len(r.text.split())
        words[r.doc_id] = words.get(r.doc_id, 0) + n
        assert r.n_chars == len(r.text) and (r.text == texts[r.doc_id] or r.text == " ".join(texts[r.doc_id].split()[:n]))
    assert words == {i: n for i, n in taken.items() if n}
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mixed_documents(docs.where("false")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from marlstone.llm.common import stash

    assert [f.__name__ for _, f in P.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = stash(stage(spark, docs, sf), "t")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "near dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
            texts = [r.text.lower() for r in docs.collect()]
            assert len(set(texts)) == len(texts)
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0.5 * sizes[0] and sizes[4] > 0
    library = Tokenizer.from_file(queries.vocabulary())
    want = sorted((r.doc_id, hashlib.sha256(np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in P.STAGES[-1][1](spark, docs, sf).collect()) == want
    assert P.run(spark, sf).count() == len(want)
