"""Conversation structure repair: the cheapest edits that make a conversation's roles a sentence of the role grammar.

A generalised LR parser reads each conversation's rows in order and keeps every stack that any choice of edits leads to. Stacks
share what is below their tops; equal stacks meet, and the one with the least (cost, audit) stays. Each stack carries the
digest of its own repaired text, so that one pass in order is enough and no text is held.

Spark damages and marks the rows, deals them by conversation and sorts them; a task reads its rows as a stream. What it holds
for the conversation at hand is a few stacks, with the edits since the last one on which all stacks agree. A conversation
that makes up a third of all rows is therefore one stream of one task: its digest and its edits are one sequence each, which
the result asks for, but memory doesn't grow with its texts. Earlier equal rows are found by a shuffle of their own, by
conversation and digest, not in that stream.

Odd rows: a null role or text is one space, as is a null id or turn in the checksum; rows of a null conversation make a
conversation; null turns come first. Rows of one turn are ordered by role and text; repeated rows are duplicates. A
role goes by its first character; an empty one has none and can't be kept. Other columns don't matter, an empty table gives no
rows. Very long texts are read row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The role grammar: capitals are its symbols, small letters the initials of roles. It is left recursive, so stacks stay short.
GRAMMAR = (("C", ""), ("C", "P"), ("P", "sB"), ("P", "B"), ("B", "ua"), ("B", "Bua"))
ROLES = {"u": "user", "a": "assistant"}  # what Rerole and Insert may give
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
END = "$"
#: First fault of a row.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3


def tables(grammar: tuple[tuple[str, str], ...] = GRAMMAR) -> tuple[list[dict[str, int]], list[dict[str, list[int]]]]:
    """(moves, reductions) of each LR state: the state that a symbol leads to, and the rules to reduce by before a letter."""
    heads = {h for h, _ in grammar}
    rules = (*grammar, ("", grammar[0][0]))  # the last one is the whole
    empty = {h for h, body in grammar if not body}
    first = {h: set() for h in heads}
    follow = {h: set() for h in heads} | {"": {END}}
    for _ in range(len(grammar) ** 2):
        for h, body in rules:
            if h and body:
                first[h] |= first.get(body[0], {body[0]})
            for i, x in enumerate(body):
                if x in heads:
                    follow[x] |= first.get(body[i + 1], {body[i + 1]}) if i + 1 < len(body) else follow[h]
                    if i + 1 < len(body) and body[i + 1] in empty:
                        follow[x] |= follow[h]

    def closed(items: frozenset[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        while True:
            wanted = {rules[r][1][at] for r, at in items if at < len(rules[r][1])}
            more = items | {(r, 0) for r, (h, _) in enumerate(grammar) if h in wanted}
            if more == items:
                return items
            items = more

    states = [closed(frozenset({(len(grammar), 0)}))]
    moves, reductions = [], []
    for state in states:  # grows as it is read
        go: dict[str, int] = {}
        for x in sorted({rules[r][1][at] for r, at in state if at < len(rules[r][1])}):
            to = closed(frozenset((r, at + 1) for r, at in state if at < len(rules[r][1]) and rules[r][1][at] == x))
            if to not in states:
                states.append(to)
            go[x] = states.index(to)
        back: dict[str, list[int]] = {}
        for r, at in sorted(state):
            if at == len(rules[r][1]):
                for x in sorted(follow[rules[r][0]]):
                    back.setdefault(x, []).append(r)
        moves.append(go)
        reductions.append(back)
    return moves, reductions


class Stacks:
    """The stacks of the grammar and where a letter takes each. A stack is (state, stack below it), and equal ones are one object."""

    def __init__(self) -> None:
        self.moves, self.reductions = tables()
        self.known: dict[tuple, tuple] = {}
        self.start = self._on(0, None)
        self.found: dict[tuple[int, str], tuple] = {}

    def _on(self, state: int, below: tuple | None) -> tuple:
        return self.known.setdefault((state, id(below)), (state, below))

    def _ready(self, stack: tuple, letter: str) -> list[tuple]:
        """The stack and what reductions before the letter make of it."""
        out = [stack]
        for s in out:  # grows as it is read
            for r in self.reductions[s[0]].get(letter, ()):
                if r == len(GRAMMAR):
                    continue
                head, body = GRAMMAR[r]
                below = s
                for _ in body:
                    below = below[1]
                made = self._on(self.moves[below[0]][head], below)
                if not any(made is o for o in out):
                    out.append(made)
        return out

    def after(self, stack: tuple, letter: str) -> tuple:
        """All stacks that the letter leads to."""
        key = (id(stack), letter)
        if key not in self.found:
            self.found[key] = tuple(self._on(self.moves[s[0]][letter], s) for s in self._ready(stack, letter) if letter in self.moves[s[0]])
        return self.found[key]

    def accepts(self, stack: tuple) -> bool:
        return any(len(GRAMMAR) in self.reductions[s[0]].get(END, ()) for s in self._ready(stack, END))


class Repair:
    """One conversation: rows go in one by one, ``end`` gives (cost, audit, digest)."""

    FLUSH = 256

    def __init__(self, stacks: Stacks):
        self.stacks = stacks
        #: For each top: the stack, its cost, the edits since the common ones, and the digest of its text (None: nothing yet).
        self.tops: dict[int, tuple[tuple, int, str, object | None]] = {id(stacks.start): (stacks.start, 0, "", None)}
        self.done: list[str] = []
        self.rows = 0

    @staticmethod
    def _said(digest, role: str, text: str):
        made = hashlib.sha256() if digest is None else digest.copy()
        if digest is not None:
            made.update(b"\n")
        made.update(role.encode())
        made.update(b":")
        made.update(text.encode())
        return made

    def _inserted(self) -> None:
        """Adds the tops that inserted turns lead to. Each turn costs, so this comes to an end."""
        queue = list(self.tops.values())
        while queue:
            stack, cost, audit, digest = queue.pop()
            if self.tops[id(stack)][1:3] != (cost, audit):
                continue  # a better one took its place
            for letter, role in ROLES.items():
                for to in self.stacks.after(stack, letter):
                    old = self.tops.get(id(to))
                    if old is None or (cost + INSERT, audit + "I") < old[1:3]:
                        self.tops[id(to)] = (to, cost + INSERT, audit + "I", self._said(digest, role, ""))
                        queue.append(self.tops[id(to)])

    def row(self, role: str, text: str, fault: int) -> None:
        self._inserted()
        found: dict[int, tuple] = {}

        def offer(to: tuple, cost: int, audit: str, digest, said: str | None) -> None:
            old = found.get(id(to))
            if old is None or (cost, audit) < old[1:3]:
                found[id(to)] = (to, cost, audit, digest, said)

        extra = TRUNCATED if fault == CUT else 0
        for stack, cost, audit, digest in self.tops.values():
            offer(stack, cost + DELETE, audit + "D", digest, None)
            if fault in (SOUND, CUT):
                for to in self.stacks.after(stack, role[:1]) if role else ():
                    offer(to, cost + extra, audit + "K", digest, role)
                for letter, name in ROLES.items():
                    for to in self.stacks.after(stack, letter):
                        offer(to, cost + REROLE + extra, audit + "R", digest, name)
        self.tops = {k: (to, cost, audit, digest if said is None else self._said(digest, said, text)) for k, (to, cost, audit, digest, said) in found.items()}
        self.rows += 1
        if self.rows % self.FLUSH == 0:
            same = len(commonprefix([t[2] for t in self.tops.values()]))
            self.done.append(next(iter(self.tops.values()))[2][:same])
            self.tops = {k: (s, c, a[same:], d) for k, (s, c, a, d) in self.tops.items()}

    def end(self) -> tuple[int, str, str]:
        self._inserted()
        cost, audit, digest = min((t[1:] for t in self.tops.values() if self.stacks.accepts(t[0])), key=lambda t: t[:2])
        return cost, "".join(self.done) + audit, (hashlib.sha256() if digest is None else digest).hexdigest()


_OUT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = frozenset(("su", "ua", "au"))


def repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, counts, cost, audit, repaired_sha256 of rows that come sorted by conversation and turn."""
    stacks, none = Stacks(), object()
    now, here = none, None
    out: list[tuple] = []
    kind = None

    def ready() -> pa.RecordBatch:
        schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in _OUT), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        batch = pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema)
        out.clear()
        return batch

    def close() -> None:
        if now is not none:
            repair, counts, low, high, turns, illegal, _, _ = here
            out.append((now, high - low + 1 - turns if turns else 0, counts[BLANK], counts[DUPLICATE], counts[CUT], illegal, *repair.end()))

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
            if now is none or conv != now:
                close()
                if len(out) >= 5000:
                    yield ready()
                now, here = conv, [Repair(stacks), [0, 0, 0, 0], None, None, 0, 0, None, none]
            if fault is None:  # the row was dropped
                continue
            repair = here[0]
            repair.row(role, text, fault)
            here[1][fault] += 1
            if turn is not None and turn != here[3]:
                here[2] = turn if here[2] is None else here[2]
                here[3] = turn
                here[4] += 1
            if here[7] is not none and here[7][:1] + role[:1] not in _LEGAL:
                here[5] += 1
            here[7] = role
    close()
    if out:
        yield ready()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of the rows, damaged by rule; a dropped row stays with copy null, so that its
    conversation is known."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("_h"))
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).when(F.col("_h") == 0, F.lit(None)).otherwise(F.col("text"))
    copies = F.when(F.col("_h") == 0, F.expr("array(cast(null as int))")).when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, again of damaged rows: the first fault of each, null for dropped rows."""
    digest = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))
    nth = F.row_number().over(W.partitionBy("conv_id", "_digest").orderBy(F.asc_nulls_first("turn"), "copy"))
    seen = rows.withColumn("_digest", F.coalesce(digest, F.concat(F.lit("-"), F.coalesce(F.col("turn").cast("string"), F.lit(""))))).withColumn("_nth", nth)
    end = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    fault = F.when(F.col("copy").isNull(), F.lit(None)).when(end == "", BLANK).when(F.col("_nth") > 1, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)
    return seen.select("conv_id", "turn", "role", "text", fault.cast("int").alias("fault"), (F.col("_nth") > 1).alias("again"))


def repair_faults(rows: DataFrame) -> DataFrame:
    """The result for rows (conv_id, turn, role, text, fault, again)."""
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return dealt.select("conv_id", "turn", "role", "text", "fault").mapInArrow(repaired, f"conv_id {kind}, {', '.join(c + ' long' for c in _OUT)}, audit string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Each conversation of (conv_id, turn, role, text) after damage by rule: gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256."""
    return repair_faults(with_faults(damaged(conversations)))


def _oracle() -> str:
    """The four places in the grammar (start, after s, u, a) as columns v0 to v3, each the least {cost, audit, text} that leads there."""
    add = lambda v, cost, edit, said=None: f"case when {v} is not null then {{'c': {v}.c + {cost}, 'a': {v}.a || '{edit}', 't': " + (f"{v}.t" if said is None else f"coalesce({v}.t || chr(10), '') || {said}") + "} end"
    least = lambda *vs: f"list_min([{', '.join(vs)}])"
    opened = lambda v: f"case when {v} is not null and fault in (0, 3) then 1 end is not null"
    ins2 = least("v2", *(add(v, INSERT, "I", "'user:'") for v in ("v0", "v1", "v3")))
    ins3 = least("v3", add("v2", INSERT, "I", "'assistant:'"))
    kept = lambda v, g: f"case when {opened(v)} and g = '{g}' then " + add(v, "x", "K", "role || ':' || text") + " end"
    rerole = lambda v, name: f"case when {opened(v)} then " + add(v, f"{REROLE} + x", "R", f"'{name}:' || text") + " end"
    to2 = least(add("v2", DELETE, "D"), *(f(v, n) for v in ("v0", "v1", "v3") for f, n in ((kept, "u"), (rerole, "user"))))
    to3 = least(add("v3", DELETE, "D"), kept("v2", "a"), rerole("v2", "assistant"))
    return f"""
with recursive crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as tab),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ord(c)::bigint) as bytes from conversations),
hashed as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 20 as h from keyed, crc),
bad as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case h when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when h = 3 then [0, 1] else [0] end) as copy from hashed where h <> 0),
marked as (select *, regexp_replace(text, '[ \\t-\\r]+$', '') as e, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from bad),
rws as (select conv_id, i, turn, role, text, substr(role, 1, 1) as g, case when e = '' then 1 when nth > 1 then 2 when substr(e, length(e), 1) not in ('.', '!', '?') then 3 else 0 end as fault from (select *, row_number() over (partition by conv_id, role, text order by i) as nth from marked)),
runs as (select *, case when fault = 3 then 1 else 0 end as x from rws),
base as (select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': ''::varchar, 't': null::varchar}} as v0, null::struct(c bigint, a varchar, t varchar) as v1, null::struct(c bigint, a varchar, t varchar) as v2, null::struct(c bigint, a varchar, t varchar) as v3 from (select distinct conv_id from conversations)),
p as (select * from base union all
  select conv_id, i, {add('v0', DELETE, 'D')}, {least(add('v1', DELETE, 'D'), kept('v0', 's'))}, {to2}, {to3}
  from (select conv_id, i, v0, v1, v2, {ins3} as v3, g, role, text, fault, x from
    (select p.conv_id, r.i, v0, v1, {ins2} as v2, v3, g, role, text, fault, x from p join runs r on r.conv_id is not distinct from p.conv_id and r.i = p.i + 1))),
last as (select p.* from p join (select b.conv_id, coalesce(max(r.i), 0) as i from base b left join runs r on r.conv_id is not distinct from b.conv_id group by all) m on m.conv_id is not distinct from p.conv_id and m.i = p.i),
ends as (select conv_id, {least('v0', 'v3')} as v from (select conv_id, v0, {ins3} as v3 from (select conv_id, v0, {ins2} as v2, v3 from last))),
sums as (select conv_id, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (before is not null and before || g not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps
  from (select *, lag(g) over (partition by conv_id order by i) as before from rws) group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, v.c as cost, v.a as audit, sha256(coalesce(v.t, '')) as repaired_sha256
from ends e left join sums s on s.conv_id is not distinct from e.conv_id
"""


ORACLE = _oracle()
