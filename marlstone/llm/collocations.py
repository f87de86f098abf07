"""Phrase collocation mining: every phrase of two to four words that a language has often enough, scored by its weakest cut.

Three passes over the texts, each in Arrow batches:

1. Words are counted exactly. Those below the least count can be in no candidate; the others go into a bit table.
2. Phrases of frequent words are hashed and summed within a task, and the sums go to owners, one for each hash partition. An
   owner merges what it gets into one Misra-Gries summary whose capacity exceeds the partition's mass divided by the least
   count: the count of a phrase falls short by less than the least count, so no frequent phrase is lost. The number of hash
   partitions follows the mass, so an owner's memory doesn't grow with the corpus.
3. Only phrases that survive (a bit table says so, with a bounded size and some false hits) are counted, by their text.

What is exact doesn't rest on a hash: a false hit costs time and is dropped by its exact count. A word or phrase that makes up
a third of all rows is one entry for each task's sums. Bit tables have at most BITS bits, whatever the corpus; a full one
filters less and changes no result.

Odd rows: a null text is empty; a null language is ``und``, as is the language of that name; ids, repeated rows and other
columns don't matter (a repeated row counts again); an empty table gives no rows. Ties are broken by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, discard, each_batch, stash

LEAST, TOP, LONGEST, INSIDE = 30, 2000, 4, 80
#: Text that is cut into words at once; sums that a task holds before it sends them; phrases for one owner, on average.
BLOCK_BYTES, SUMS, OWNER_MASS = 1 << 22, 1 << 20, 1 << 22
#: Bits of the largest bit table (32 MB), and of one of its parts.
BITS, PART_BITS = 1 << 28, 1 << 22

#: Byte classes: 0 of a word, 1 blank, 2 end of a piece.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(ASCII_UPPER.encode())] = list(ASCII_LOWER.encode())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.StringArray, np.ndarray]]:
    """(language, words in order, number of the piece each stands in) of texts of one language, about BLOCK_BYTES at once."""
    for batch in batches:
        lang = batch.column("lang").fill_null("und").dictionary_encode()
        codes = lang.indices.to_numpy()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            texts = batch.column("text").filter(pa.array(codes == code)).drop_null()
            ends = np.cumsum(np.fromiter((0 if t is None else t for t in pa.compute.binary_length(texts).to_pylist()), np.int64, len(texts)))
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")))
                yield name, *cut(texts.slice(at, upto - at))
                at = upto


def cut(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts, and the number of the piece that each stands in."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    kind = _CLASS[raw]
    word = kind == 0
    edge = np.zeros(len(raw) + 1, bool)  # where a text begins
    begins = offsets[:-1] - offsets[0]
    edge[begins] = True
    edge[-1] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = np.cumsum((kind == 2).astype(np.int32))[starts] + np.searchsorted(begins, starts, "right")
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(_LOWER[raw[word]])), piece


class Bits:
    """A set of 64-bit hashes with false hits: two bits for each, in a table whose size is a power of two."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) * 8 - 1)

    @staticmethod
    def places(h: np.ndarray, size: int) -> np.ndarray:
        mask = np.uint64(size - 1)
        return np.concatenate([h & mask, _mix(h) & mask])

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in (h & self.mask, _mix(h) & self.mask):
            out &= (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bit_table(df: DataFrame, column: str, n: int, hashes) -> Bits:
    """A bit table of what ``hashes`` gives for batches of df's columns (n hashes in all). Parts are made by tasks of their own;
    the driver gets the table, of at most BITS bits."""
    size = PART_BITS
    while size < min(32 * n, BITS):
        size *= 2
    schema = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(Bits.places(hashes(batch), size))
            part = (at // np.uint64(PART_BITS)).astype(np.int32)
            for p in np.unique(part):
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([(at[part == p] % np.uint64(PART_BITS)).astype(np.uint32).tobytes()], pa.binary())], schema)

    def joined(table: pa.Table) -> pa.Table:
        out = np.zeros(PART_BITS // 8, np.uint8)
        for b in table.column("bits"):
            at = np.frombuffer(b.as_buffer(), np.uint32)
            np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return pa.table([table.column("part").slice(0, 1), pa.array([out.tobytes()], pa.binary())], schema)

    table = np.zeros(size // 8, np.uint8)
    for r in df.select(*column.split()).mapInArrow(places, "part int, bits binary").groupBy("part").applyInArrow(joined, "part int, bits binary").collect():
        table[r.part * PART_BITS // 8 : (r.part + 1) * PART_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return Bits(table)


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def word_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), _seed(n)) for n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), np.uint64, batch.num_rows)


def phrases(lang: str, words: pa.StringArray, piece: np.ndarray, frequent: Bits) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, list[str]]:
    """For each length, the places and hashes of the phrases of frequent words; with them each word's number and the words by number."""
    coded = words.dictionary_encode()
    known = coded.dictionary.to_pylist()
    seed = _seed(lang)
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seed) for w in known), np.uint64, len(known))
    ids = coded.indices.to_numpy()
    good, h = frequent.has(of_word)[ids], of_word[ids]
    out = []
    at, mixed = np.flatnonzero(good), h[good]
    for k in range(2, LONGEST + 1):
        on = at + k - 1 < len(ids)
        at, mixed = at[on], mixed[on]
        on = good[at + k - 1] & (piece[at] == piece[at + k - 1])
        at, mixed = at[on], mixed[on]
        mixed = _mix(mixed * np.uint64(3) + h[at + k - 1])
        out.append((k, at, mixed))
    return out, ids, known


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters. A count falls short of the true one by at most ``short``, which is
    below the mass seen divided by the capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.short = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(self.keys) > self.capacity:
            less = np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1]  # the greatest that finds no room
            self.short += int(less)
            on = self.counts > less
            self.keys, self.counts = self.keys[on], self.counts[on] - less

    def maybe(self, least: int) -> np.ndarray:
        """Keys whose true count may be ``least`` or more: every such key, and some below."""
        return self.keys[self.counts + self.short >= least]


COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def in_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, summed before they leave it as far as SUMS rows hold them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > SUMS:
            held = _added(held)
            size = sum(b.num_rows for b in held)
            if 2 * size > SUMS:
                yield from held
                held, size = [], 0
    yield from _added(held)


def _added(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches, COUNTS).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(COUNTS.names).cast(COUNTS).combine_chunks().to_batches()


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    spark = docs.sparkSession
    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, _ in blocks(batches):
            found = words.value_counts()
            yield pa.record_batch([pa.array([lang] * len(found), pa.string()), found.field(0), found.field(1)], COUNTS)

    kind = "lang string, phrase string, f long"
    words = stash(each_batch(docs, ["text", "lang"], kind, lambda b: in_task(count_words(b))).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    frequent_words = words.where(F.col("f") >= least)
    size = words.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n"), F.count_if(F.col("f") >= least).alias("frequent")).first()
    frequent = spark.sparkContext.broadcast(bit_table(frequent_words, "lang phrase", size.frequent, word_hashes))
    owners = max(1, -(-size.n * (LONGEST - 1) // OWNER_MASS))
    sent = pa.schema([("owner", pa.int64()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def send(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sums, dealt to owners by range of the hash: each gets sorted keys, and counts of one byte where that holds them."""
        for on, width in ((counts < 256, np.uint8), (counts >= 256, np.int64)):
            some = keys[on]
            bounds = np.searchsorted(some, np.array([(1 << 64) * i // owners for i in range(1, owners)], np.uint64))
            for i, (k, c) in enumerate(zip(np.split(some, bounds), np.split(counts[on], bounds), strict=True)):
                if len(k):
                    yield pa.record_batch([pa.array([i]), pa.array([int(c.sum())]), pa.array([k.tobytes()], pa.binary()), pa.array([c.astype(width).tobytes()], pa.binary())], sent)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, fresh, held = np.zeros(0, np.uint64), np.zeros(0, np.int32), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.unique(np.concatenate([keys[:0], *fresh]), return_counts=True)
            fresh.clear()
            return _summed(np.concatenate([keys, k]), np.concatenate([counts, c.astype(np.int32)]))

        for lang, words, piece in blocks(batches):
            for _, _, h in phrases(lang, words, piece, frequent.value)[0]:
                fresh.append(h)
                held += len(h)
            if held >= SUMS:
                (keys, counts), held = merged(), 0
                if len(keys) > SUMS:
                    yield from send(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from send(*merged())

    def merge(table: pa.Table) -> pa.Table:
        summary = Summary(sum(table.column("mass").to_pylist()) // least + 1)
        for k, c in zip(table.column("keys"), table.column("counts"), strict=True):
            keys = np.frombuffer(k.as_buffer(), np.uint64)
            raw = c.as_buffer()
            summary.merge(keys, np.frombuffer(raw, np.uint8 if raw.size == len(keys) else np.int64).astype(np.int64))
        left = summary.maybe(least)
        return pa.table([pa.array([len(left)]), pa.array([left.tobytes()], pa.binary())], pa.schema([("n", pa.int64()), ("keys", pa.binary())]))

    survivors = stash(each_batch(docs, ["text", "lang"], "owner long, mass long, keys binary, counts binary", sums).groupBy("owner").applyInArrow(merge, "n long, keys binary"), "phrases")
    n = survivors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    maybe = spark.sparkContext.broadcast(bit_table(survivors, "keys", n, lambda b: np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(k.as_buffer(), np.uint64) for k in b.column(0))])))

    def count_phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, piece in blocks(batches):
            found, ids, known = phrases(lang, words, piece, frequent.value)
            for k, at, h in found:
                on = maybe.value.has(h)
                at, h = at[on], h[on]
                _, first, group, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                odd = np.zeros(len(at), bool)  # of the same hash as others of this block, but other words
                for j in range(k):
                    odd |= ids[at + j] != ids[at[first[group]] + j]
                times = times - np.bincount(group[odd], minlength=len(times))
                places, counts = np.concatenate([at[first], at[odd]]), np.concatenate([times, np.ones(int(odd.sum()), np.int64)])
                texts = [" ".join([known[i] for i in ids[p : p + k]]) for p in places.tolist()]
                yield pa.record_batch([pa.array([lang] * len(texts), pa.string()), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], COUNTS)

    exact = each_batch(docs, ["text", "lang"], kind, lambda b: in_task(count_phrases(b))).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    found = stash(exact, "candidates")
    discard(survivors)
    frequent.destroy()
    maybe.destroy()
    return ranked(found, words, least, top)


def ranked(found: DataFrame, words: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The report of candidates (lang, phrase, f) and words (lang, phrase, f). A part of a candidate is a candidate or a frequent
    word, so every cut finds both its counts."""
    known = words.where(F.col("f") >= least).unionByName(found)
    parts = F.split("phrase", " ")
    join = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cut_at = F.explode(F.sequence(F.lit(1), F.size("w") - 1))
    cuts = found.withColumn("w", parts).withColumn("k", cut_at).select("lang", "phrase", F.col("f").alias("a"), "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    inner = F.explode(F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: join(i, n)))), lambda x: x.isNotNull()))
    inside = found.withColumn("w", parts).where(F.size("w") > 2).select("lang", "f", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    alone = best.join(inside, ["lang", "phrase"], "left").where(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {INSIDE}")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = alone.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
with t as (select coalesce(lang, 'und') as lang, row_number() over () as doc, translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') as text from documents),
p as (select lang, row_number() over () as piece, w from (select lang, list_filter(string_split_regex(x, '[ \\t]+'), lambda y: y <> '') as w from (select lang, unnest(string_split_regex(text, '[.,;:!?\\n\\x0B\\f\\r]')) as x from t)) where len(w) > 0),
g as (select lang, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as phrase, k, count(*) as f from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from p, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k) group by all),
c as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from g where k > 1 and f >= {LEAST}),
cuts as (select lang, phrase, a, w, unnest(generate_series(1, k - 1)) as k from c),
s as (select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r, cast(2000000::hugeint * c.a // (l.f + r.f) as bigint) as score from cuts c
  join g l on l.lang = c.lang and l.phrase = list_aggregate(c.w[1:c.k], 'string_agg', ' ') join g r on r.lang = c.lang and r.phrase = list_aggregate(c.w[c.k + 1:], 'string_agg', ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, phrase, max(a) as longer from (select lang, a, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') as phrase from (select lang, a, w, n, unnest(generate_series(1, k - n + 1)) as i from c, (select unnest([2, 3]) as n) where n < k)) group by all),
u as (select b.* from b left join i using (lang, phrase) where i.longer is null or 100::hugeint * i.longer < {INSIDE}::hugeint * b.a),
z as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from u),
m as (select lang, sum(f)::bigint as n from g where k = 1 group by lang)
select lang, rank, phrase, a, l, r, n, score from z join m using (lang) where rank <= {TOP}
"""
