"""op13: edits against all strings of edits, the parser's language against the grammar's expression, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

from marlstone.llm import conversations as C

LANGUAGE = re.compile(r"(s?(ua)+)?")


def test_parser_accepts_the_language():
    stacks = C.Stacks()
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            tops = [stacks.start]
            for x in word:
                tops = [to for t in tops for to in stacks.after(t, x)]
            assert any(stacks.accepts(t) for t in tops) == bool(LANGUAGE.fullmatch("".join(word)))
    assert len(stacks.known) < 40  # left recursion keeps stacks short


def all_repairs(rows):
    """The best (cost, audit) and its text by trying every string of edits with at most two insertions at a place."""
    best = None

    def go(i, inserted, cost, audit, roles, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if inserted < 2:
            for r in ("user", "assistant"):
                go(i, inserted + 1, cost + C.INSERT, audit + "I", roles + r[0], [*lines, f"{r}:"])
        if i == len(rows):
            if LANGUAGE.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
            return
        role, text, fault = rows[i]
        go(i + 1, 0, cost + C.DELETE, audit + "D", roles, lines)
        if fault in (C.SOUND, C.CUT):
            extra = fault == C.CUT
            if role:
                go(i + 1, 0, cost + extra, audit + "K", roles + role[0], [*lines, f"{role}:{text}"])
            for r in ("user", "assistant"):
                go(i + 1, 0, cost + C.REROLE + extra, audit + "R", roles + r[0], [*lines, f"{r}:{text}"])

    go(0, 0, 0, "", "", [])
    return best


def test_edits_are_the_cheapest_of_all():
    rng, stacks = random.Random(11), C.Stacks()
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool", " ", "", "umpire"]), f"t{i}.", rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randint(0, 4))]
        repair = C.Repair(stacks)
        for r in rows:
            repair.row(*r)
        cost, audit, digest = repair.end()
        want = all_repairs(rows)
        assert (cost, audit, digest) == (*want[:2], hashlib.sha256(want[2].encode()).hexdigest()), rows


def plain(conv, rows):
    """Damage, order and faults of one conversation by the letter."""
    text_of = lambda x: " " if x is None else x
    out = []
    for turn, role, text in rows:
        role, text = text_of(role), text_of(text)
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in out:
        end = text.rstrip(" \t\n\x0b\f\r")
        faults.append(C.BLANK if not end else C.DUPLICATE if (role, text) in seen else C.CUT if end[-1] not in ".!?" else C.SOUND)
        seen.add((role, text))
    turns = [t for t, _, _ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    repair = C.Repair(C.Stacks())
    for (_, role, text), fault in zip(out, faults, strict=True):
        repair.row(role, text, fault)
    return (conv, gaps, *(faults.count(f) for f in (C.BLANK, C.DUPLICATE, C.CUT)), illegal, *repair.end())


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, fault int, audit string").repartition(3)
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r) for r in C.repair_conversations(df).select(*columns).collect()), key=str)


def test_rows_of_all_kinds(spark):
    rng, rows = random.Random(2), []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            at = rng.choice([turn, turn, turn, turn * 2, None, 3])
            rows.append((conv, at, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "Tool"]), rng.choice(["One.", "Two!", "Same.", "Same.", "cut", " \t\n", None, "", "ends. \r\n", "é?"])))
    want = sorted((plain(c, [r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}), key=str)
    assert run(spark, rows) == want


def test_dropped_conversations_and_empty_table(spark):
    gone = next((c, 0) for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(*gone, "user", "Hi.")]) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run(spark, []) == []


def test_one_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t % 700}.") for t in range(20_000)]
    (got,) = run(spark, rows)
    assert got == plain(1, [r[1:] for r in rows])
