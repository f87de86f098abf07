"""run() against a version of the whole pipeline in plain Python, on a small table with every kind of row."""

import hashlib
import random
from collections import Counter

import numpy as np

from marlstone.llm import queries
from marlstone.llm import quality_rules as Q

from .test_dedup import brute, lower
from .test_mixing_and_pipeline import wanted_targets
from .test_text_operators import plain_statistics


def table():
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(120):
        rows.append((len(rows), " ".join(r.choice(words) for _ in range(r.randrange(55, 140))), f"s{r.randrange(5)}"))
    for i in range(0, 40, 2):
        rows.append((len(rows), rows[i][1].upper() if i % 4 else rows[i][1], "s1"))  # exact copies
        near = rows[i + 1][1].split()
        near[r.randrange(len(near))] = "changed"
        rows.append((len(rows), " ".join(near), None))
    rows += [(len(rows) + i, " ".join(r.choice(words) + "$$$" for _ in range(80)), "s2") for i in range(40)]  # junk
    rows += [(900, None, "s1"), (901, "", "s1"), (902, "short", "s1"), (903, "same line again\n" * 40, "s1")]
    return rows


def by_hand(rows, labels, rules):
    from tokenizers import Tokenizer

    def good(t):
        n, _, _, _, rep = plain_statistics(t)
        values = dict(zip(Q.COUNTS, map(float, Q.statistics(t)), strict=True))
        shares = {f: np.array([eval(x.replace("greatest", "max").replace("cast(n_words as double)", "n_words"), {"max": max}, values)]) for f, x in Q.FEATURES.items()}
        return not (n < 50 or 100 * rep > 50 * n) and not any(rule.mask(shares)[0] for rule in rules)

    rows = [x for x in rows if good(x[1])]
    most = {}
    for i, t, _ in rows:
        most[lower(t)] = max(i, most.get(lower(t), i))
    rows = [x for x in rows if most[lower(x[1])] == x[0]]
    least = brute([(i, t) for i, t, _ in rows])
    rows = [x for x in rows if least[x[0]][2]]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    readings = Counter()
    for s, target in wanted_targets(sizes).items():
        order = lambda x: int(hashlib.md5(f"{x[0]}:0:{hashlib.md5(x[1].encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        begins, goal = 0, round(target)
        for x in sorted((x for x in rows if x[2] == s), key=order):
            n = len(x[1].split())
            taken = goal // sizes[s] * n + min(n, max(0, goal - goal // sizes[s] * sizes[s] - begins))
            readings[x[0]], begins = (2 * taken + n) // (2 * n), begins + n
    library, out = Tokenizer.from_file(queries.vocabulary()), []
    for i, t, _ in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        out += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * readings[i]
    return sorted(out)


def test_the_pipeline_equals_a_plain_version(spark, tmp_path):
    import corpus_pipeline as P

    rows = table()
    labels = [(i, int("$" not in (t or "")), 0) for i, t, _ in rows if i < 900]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rules = Q.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert rules
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, str(tmp_path)).collect())
    assert got and got == by_hand(rows, labels, rules)
