"""op11: base spans against plain regular expressions, the folds against plain loops, wider spans on planted texts."""

import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from marlstone.llm import personal_data as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
    return total % 10 == 0


def base(text: str | None) -> list[tuple[int, int, int]]:
    out = []
    for i, (kind, form) in enumerate(PLAIN.items()):
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), i, m.end()))
    return sorted(out)


def said(spans) -> str:
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in P.personal_data(df).collect()), key=str)
    want = []
    for i, t in rows:
        b = base(t)
        want.append((i, *(sum(x[1] == k for x in b) for k in range(4)), hashlib.sha256(said(b).encode()).hexdigest()))
    assert [g[:6] for g in got] == sorted(want, key=str)
    spans = {}
    for g in got:
        spans.setdefault(g[0], set()).add(g[6])
    for i, t in rows:
        assert any(set(said(base(t)).split(",")) <= set(s.split(",")) | {""} for s in spans[i])
    return got


def test_base_spans_of_given_texts(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(7)
    pieces = ["a@b.c", "a@b.c_d@e.f", ".@d.e", "x@y", "1.2.3.4.5.6.7.8", "999.1.1.1", "000255.1.1.01", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1 2", "+123456789012345678", "é𝄞", "\n", " ", "-", ".", "@", "+", "7", "_", "%", "ß@x.de", "٣.٤.٥.٦"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    check(spark, [(None, None), (1, ""), (1, "a@b.c"), (1, "a@b.c"), *enumerate(texts, 2)])


def test_very_many_matches_and_long_runs(spark):
    many = "a@b.c 10.1.2.3 " * 1000
    slow = ["1" * 4_000, "a" * 4_000 + "@", "1." * 2_000, "+1" + " " * 4_000, "a.b-c" * 800, "A1" * 2_000]
    began = time.time()
    check(spark, [(1, many), *((i, t) for i, t in enumerate(slow, 2) if i != 4)])
    assert time.time() - began < 120


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.personal_data(df).count() == 0
    df = spark.createDataFrame([(1, "x@y.org", "a", "b", 3)], "doc_id long, text string, _text string, spans string, kind int")
    assert [(r.doc_id, r.n_email, r.spans) for r in P.personal_data(df).collect()] == [(1, 1, "email:0:7")]


def plain_em(patterns):
    """The same estimate with plain loops: patterns of (votes, anchor, n)."""
    n = P.N_LABELERS
    table = lambda: [[0.0] * 3 for _ in range(n)]

    def odds(yes, no, ty, tn):
        out = []
        for j, (a, b, c, d) in enumerate(P.TRUST.values()):
            share = lambda of, v, up, down: (of[v] + (up if v == 2 else down)) / (of[0] + of[2] + up + down)
            out += [0.0 if v == 1 else math.log(share(yes[j], v, a, b)) - math.log(share(no[j], v, c, d)) for v in range(3)]
        return [*out, math.log((ty + 2) / (tn + 2))]

    w = odds(table(), table(), 0, 0)
    for _ in range(P.ROUNDS):
        yes, no, ty, tn = table(), table(), 0.0, 0.0
        for votes, anchor, count in patterns:
            q = float(anchor) if anchor is not None else 1 / (1 + math.exp(-(w[-1] + sum(w[3 * j + v + 1] for j, v in enumerate(votes)))))
            for j, v in enumerate(votes):
                yes[j][v + 1] += count * q
                no[j][v + 1] += count * (1 - q)
            ty, tn = ty + count * q, tn + count * (1 - q)
        w = odds(yes, no, ty, tn)
    return w


def plain_fit(patterns, odds):
    w = [0.0] * P.SIZE
    rows = []
    for votes, shape, anchor, n in patterns:
        x = [0] + [1 + 3 * j + v + 1 for j, v in enumerate(votes)] + [1 + 3 * P.N_LABELERS + 3 * j + v for j, v in enumerate(shape)]
        q = float(anchor) if anchor is not None else 1 / (1 + math.exp(-(odds[-1] + sum(odds[3 * j + v + 1] for j, v in enumerate(votes)))))
        rows.append((x, n, q))
    mass = [sum(n for x, n, _ in rows if i in x) for i in range(P.SIZE)]
    for _ in range(P.STEPS):
        slope = [0.0] * P.SIZE
        for x, n, q in rows:
            e = n * (q - 1 / (1 + math.exp(-sum(w[i] for i in x))))
            for i in x:
                slope[i] += e
        w = [a + (g - P.RIDGE * a) / (m * (P.N_LABELERS + 3) / 4 + P.RIDGE) for a, g, m in zip(w, slope, mass, strict=True)]
    return w


def test_folds_equal_plain_loops(spark):
    rng = random.Random(3)
    patterns = sorted({(tuple(rng.choice([-1, 0, 1]) for _ in range(P.N_LABELERS)), (rng.randint(0, 2), rng.randint(0, 2)), rng.choice([None, None, 0, 1])) for _ in range(40)}, key=str)
    patterns = [(*p, rng.randint(1, 50)) for p in patterns]
    spans = [(0, a, list(v), list(s)) for v, s, a, n in patterns for _ in range(n)]
    got = P.model(spark.createDataFrame(spans, "kind int, anchor int, votes array<int>, shape array<int>"))[0]
    odds = plain_em([(v, a, n) for v, _, a, n in patterns])
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, plain_fit(patterns, odds), strict=True))


def test_running_sums_and_maxima(spark):
    rng = random.Random(5)
    for n in (0, 1, P.PART, P.PART + 1, 3 * P.PART + 7):
        values = [rng.randint(-9, 9) for _ in range(n)]
        row = spark.createDataFrame([(values,)], "v array<long>").select(P.running(F.col("v"), lambda a, b: a + b, 0).alias("s"), P.running(F.col("v"), F.greatest, -100).alias("m")).first()
        assert row.s == [sum(values[: i + 1]) for i in range(n)]
        assert row.m == [max(values[: i + 1]) for i in range(n)]


def test_wider_spans_of_planted_texts(spark):
    plain = "the report covers chapter 12 of the plan and nothing else. "
    planted = {
        "email": ["mail jane.doe [at] example [dot] org now", "contact: bob(at)example.com please"], "phone": ["call (743) 555-3824 now", "phone 212-555-0187 today", "tel 030 1234 5678 or"], "ssn": ["SSN 123-45-6789 on file"],
        "iban": ["IBAN DE89 3704 0044 0532 0130 00 for", "account GB29NWBK60161331926819 is"], "name": ["signed Mr. John Harper here", "dear Maria Lopez, we"], "ip": ["server 2001:db8:0:0:0:ff00:42:8329 is"], "card": ["card 4111.1111.1111.1111 was"],
    }
    clean = ["version 1.22.333-4444 build", "order 1234-5678-90", "at 12:30:45:10 we", "mac aa:bb:cc:dd:ee:ff is", "IBAN DE89 3704 0044 0532 0130 01 for", "SSN 000-45-6789 on", "sum 4111.1111.1111.1112 was", "invoice 2024 0001 0002", "Mr and Mrs", "commit 12345678-1234", "isbn 978-3-16-148410-0"]
    rows, want = [], {}
    for kind, texts in planted.items():
        for t in texts:
            for k in range(3):
                want[len(rows)] = kind
                rows.append((len(rows), plain * k + t + " " + plain))
    for t in clean:
        for k in range(3):
            rows.append((len(rows), plain * k + t + " " + plain))
    got = {r.doc_id: r.spans for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [rows[i][1] for i, k in want.items() if not got[i].startswith(k + ":")]
    wrong = [rows[i][1] + got[i] for i in got if i not in want and got[i]]
    assert not missed and not wrong, (missed, wrong)
