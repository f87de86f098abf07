"""MinHash near-deduplication with HyperMinHash registers.

A document's sketch has one register for each of 256 buckets of shingle hashes: the leading-zero count of the least
hash in the bucket and the mantissa bits after it, 16 bits in all. Bands over the registers propose candidates, the
collision-corrected estimate of the Jaccard similarity rejects the clearly dissimilar ones, and the full shingle sets
decide about the rest.

Documents with equal sets form a class and go on as one representative. A bucket of a band isn't expanded into pairs:
its members are first compared with one leader, then, in rounds, those that are still apart with members of the largest component,
and at the end those that are apart even then meet by the rare shingles they share, so that a group of near copies costs
about as many comparisons as it has members, while no link between components is missed. Documents that share one pool of
sentences below the threshold have no rare shingle: nearly all of their pairs meet, and only the comparisons reject them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators.skew import hot_keys, salted_join

from .common import BROADCAST_ROWS, before_ranges, discard, each_batch, fresh, narrow_to, ranged, stash

REGISTERS, MANTISSA = 256, 10
#: With 64 bands of 6 registers, a pair at similarity 0.8 is missed with probability (1 - 0.8**6)**64 < 4e-9.
BANDS, ROWS = 64, 6
SHINGLE, NUMERATOR, DENOMINATOR = 4, 80, 100
#: Six standard deviations of the estimate below the threshold.
SLACK = 6 * (0.8 * 0.2 / REGISTERS) ** 0.5
WORDS_KEPT = 400_000
#: Rounds in which members that are still apart meet heads of their band's largest component, and heads at a time.
ROUNDS, HEADS = 2, 8
#: Links that one task contracts in memory: about 100 MB.
LINKS_A_TASK = 400_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, known: dict | None = None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width``: one shingle; no word: none."""
    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    known = _WordHashes() if known is None else known
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    x = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        x = x * _A + h[i : len(h) - width + 1 + i]
    return np.unique(_mix(x))


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16 registers of a sorted array of hashes; 0 where a bucket is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the first of a bucket is its least
        rest = hashes[first] & np.uint64((1 << 56) - 1)
        # the exponent of the float is where the leading one stands; 56 bits lose nothing that 10 mantissa bits need
        exponent = np.frexp(rest.astype(np.float64))[1]
        zeros = np.minimum(56 - exponent, 46)
        mantissa = (rest << (zeros.astype(np.uint64) + np.uint64(9))) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return out


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of buckets in which unequal hashes of sets of n and m elements give equal registers."""
    total = np.zeros(np.broadcast(n, m).shape)
    n, m = n / REGISTERS, m / REGISTERS
    cells = 1 << MANTISSA
    for zeros in range(24):  # both least hashes fall into the same of the 2**mantissa cells below 2**-zeros
        low, step = 2.0 ** -(zeros + 1), 2.0 ** -(zeros + 1) / cells
        at = low + (np.arange(0, cells, 64) + 32) * step
        for y in at:
            total += 64 * (np.exp(-n * y) - np.exp(-n * (y + step))) * (np.exp(-m * y) - np.exp(-m * (y + step)))
    return total


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of pairs of register rows."""
    used = (a > 0) | (b > 0)
    equal = ((a == b) & used).sum(1)
    used = np.maximum(used.sum(1), 1)
    false = collisions(n, m) * REGISTERS
    return (equal - np.minimum(false, equal)) / used


def _plan() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    bands = np.concatenate([rng.permutation(REGISTERS) for _ in range(-(-BANDS * ROWS // REGISTERS))])[: BANDS * ROWS].reshape(BANDS, ROWS)
    borrow = np.stack([rng.permutation(REGISTERS) for _ in range(64)])
    return bands, borrow


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row. Empty registers borrow from others by fixed permutations, so that small sets fill all."""
    bands, borrow = _plan()
    full, turn = regs.astype(np.uint64), 0
    row, column = np.nonzero(regs == 0)
    held = (regs > 0).any(1)[row]
    row, column = row[held], column[held]
    while len(row) and turn < 4096:
        taken = regs[row, (borrow[turn % len(borrow)][column] + turn // len(borrow) * 37) % REGISTERS]
        found = taken > 0
        full[row[found], column[found]] = taken[found] | np.uint64((turn + 1) << 16)
        row, column, turn = row[~found], column[~found], turn + 1
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1), len(regs), 0)
    for i in range(ROWS):
        keys = _mix(keys * _A + full[:, bands[:, i]])
    return keys.view(np.int64)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for batch in batches:
        n, digest, regs = [], [], []
        for text in batch.column(1):
            h = shingle_hashes(text.as_py(), known)
            n.append(len(h))
            digest.append(xxhash.xxh3_128_digest(h.tobytes()))
            regs.append(registers(h).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "digest", "regs"])


def _explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(regs)
            ids = np.repeat(part.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["band", "id"])


def _likely(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
                n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                keep = estimate(a, b, n, m) >= threshold
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_hashes(t.as_py(), known).tobytes() for t in part.column(1)], pa.large_binary())], ["id", "hashes"])


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])


def _by_rare_shingles(docs: DataFrame, apart: DataFrame) -> DataFrame:
    """(a, b) of different components that may link: exact for what the rounds leave.

    Sets of n and m elements at the threshold share so many that, with all elements in one order, the first
    ``n - ceil(0.8 n) + 1`` of one and as many of the other have an element in common. Rare shingles come first, so a
    member that differs from the rest of its group by more than the threshold meets nobody.
    """
    members = stash(apart.select("id", "component").distinct(), "members")
    sets = stash(narrow_to(docs, members.select(F.col("id").alias("doc_id")), members.count()).mapInArrow(_hash_lists, "id long, h array<long>").dropDuplicates(["id"]), "lists")
    each = sets.select("id", F.size("h").alias("n"), F.explode("h").alias("h"))
    total = sets.agg(F.sum(F.size("h"))).first()[0] or 0
    counts = stash(each.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shingles")
    ranked = salted_join(each, counts, "h", hot_keys(counts, "h", "k", total), ["id"]).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("o"))
    # shingles that only one member has stand first and meet nobody: they use up the front of the order
    alone = F.col("n") - F.size("o")
    front = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR).cast("int") + 1 - alone
    ranked = ranked.withColumn("front", front).withColumn("alone", alone).where("front > 0")
    ranked = ranked.select("id", "n", "alone", F.posexplode(F.slice("o", 1, F.col("front"))).alias("at", "o"))
    # after: how many elements can be common if this is the first common one
    ranked = ranked.select("id", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("after"), F.col("o.h").alias("h")).join(members, "id")
    ranked = stash(ranked, "fronts")
    # of two components at most one is a shingle's largest: its members need not meet each other
    parts = stash(ranked.groupBy("h", "component").agg(F.count(F.lit(1)).alias("k")), "parts")
    largest = parts.groupBy("h").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("k"))
    hot = hot_keys(largest, "h", "k", total)
    x, y = (ranked.select("h", F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("after").alias(f"after_{i}"), F.col("component").alias(f"c_{i}")) for i in "xy")
    # a pair's first common element leaves room for the elements that the threshold asks for; later ones may not, and needn't
    room = f"{NUMERATOR + DENOMINATOR} * least(after_x, after_y) >= {NUMERATOR} * (n_x + n_y)"
    x = salted_join(x, largest.drop("k"), "h", hot, ["x"]).where("c_x <> main").drop("main")
    met = salted_join(y, x, "h", hot, ["y"]).where(f"c_x <> c_y and {DENOMINATOR} * least(n_x, n_y) >= {NUMERATOR} * greatest(n_x, n_y) and {room}")
    out = stash(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "met")
    discard(members, sets, counts, ranked, parts)
    return out


def _hash_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_hashes(t.as_py(), known).view(np.int64) for t in part.column(1)], pa.list_(pa.int64()))], ["id", "h"])


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each id with the least one it reaches there."""
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        root = i
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[i] != root:
            parent[i], i = root, parent[i]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ids = [i for i in parent if find(i) != i]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the least id reachable.

    Tasks of at most LINKS_A_TASK links each contract what they hold to stars; if there are several, large-star and
    small-star steps, each a minimum and a join, follow until every id points at its least. Partial minima keep hot ids
    from one task.
    """
    tasks = -(-max(1, links.count()) // LINKS_A_TASK)
    edges = stash(links.select("a", "b").repartition(tasks).mapInArrow(_contract, "u long, v long"), "edges")
    while tasks > 1:
        # done when each id has one smaller neighbour, and no smaller neighbour has one itself
        many = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not many and not edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u", "left_semi").limit(1).count():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = stash(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("m", "u").alias("m"), "n"), "stars")
        large = salted_join(both.where("v > u"), stars.select("u", "m"), "u", hot_keys(stars, "u", "n", 2 * tasks * LINKS_A_TASK), ["v"])
        larger = stash(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        discard(edges, stars)
        stars = stash(larger.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        small = salted_join(larger, stars.select("u", "m"), "u", hot_keys(stars, "u", "n", 2 * tasks * LINKS_A_TASK), ["v"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stash(small.unionByName(stars.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(larger, stars)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def near_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Links: 100 * intersection >= 80 * union of the sets of 4-word shingles after lower-casing A-Z. A text without words
    (null, empty or blank) links with nothing. Rows that repeat an id with one text count as one document; if texts
    differ, the id links what any of them links. A row without an id keeps a null component and is kept. An empty table
    gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    sketches = stash(each_batch(docs, ["doc_id", "text"], "doc_id long, n_shingles long, digest binary, regs binary", _sketch), "sketches")
    named = sketches.where("n_shingles > 0 and doc_id is not null")
    # registers and size follow from the set, so as keys they ride along and partial minima collapse hot classes
    classes = stash(named.groupBy("digest", "n_shingles", "regs").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    bands = stash(classes.select("id", "regs").mapInArrow(_explode, "band long, id long"), "bands")
    counts = stash(bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "counts")
    total = counts.agg(F.sum("members")).first()[0] or 0
    hot = hot_keys(counts, "band", "members", total)

    def by_band(many: DataFrame, one: DataFrame) -> DataFrame:
        return salted_join(many, one, "band", hot, ["id"])

    in_shared = stash(by_band(bands, counts), "shared")
    discard(bands)
    # the member whose bands are fullest leads: the middle of a group of near copies, which links with most of them
    weight = in_shared.groupBy("id").agg(F.sum("members").alias("weight"))
    shared = stash(in_shared.select("band", "id").join(weight, "id"), "weighed")
    discard(in_shared)
    leaders = shared.groupBy("band").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("leader"))

    sizes = classes.select("id", "n_shingles", "regs")
    close = F.expr(f"{DENOMINATOR} * least(n_a, n_b) >= {NUMERATOR} * greatest(n_a, n_b)")

    def with_both(pairs: DataFrame, of: DataFrame, columns: dict[str, str]) -> DataFrame:
        """``pairs`` (a, b) with the columns of both from ``of``, one row for each id. A leader is in as many pairs as it leads."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("pairs"))
        most = stash(hot_keys(ids, "id", "pairs", 2 * pairs.count()), "leaders")
        for side, other in ("ba", "ab"):
            own = of.select(F.col("id").alias(side), *(F.col(c).alias(f"{n}_{side}") for c, n in columns.items()))
            pairs = salted_join(pairs, own, side, most.withColumnRenamed("id", side), [other])
        return pairs

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = stash(pairs, "pairs")
        likely = with_both(pairs, sizes, {"n_shingles": "n", "regs": "regs"}).where(close)
        likely = stash(likely.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_likely(NUMERATOR / DENOMINATOR - SLACK), "a long, b long"), "likely")
        wanted = stash(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
        sets = stash(narrow_to(docs, wanted, wanted.count()).mapInArrow(_sets, "id long, hashes binary"), "sets")
        joined = with_both(likely, sets, {"hashes": "hashes"})
        out = stash(joined.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_verify, "a long, b long").distinct(), "links")
        discard(pairs, likely, wanted, sets)
        return out

    met = by_band(shared, leaders).where("id <> leader")
    links = links_of(met.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
    parts = stash(components(links), "components")
    for turn in range(ROUNDS + 1):
        # members of one band that are still apart: only they remain to be compared
        now = shared.join(parts, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
        mixed = now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
        apart = stash(by_band(now, mixed), "apart")
        if not apart.limit(1).count():
            break
        if turn == ROUNDS:
            links = links.unionByName(links_of(_by_rare_shingles(docs, apart)))
            parts = stash(components(links), "components")
            break
        # each member outside its band's largest component meets one of a few heads inside it, others in each round
        largest = apart.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"))
        placed = stash(by_band(apart, largest), "placed")
        inside = placed.where("component = main").withColumn("slot", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(HEADS)))
        heads = inside.groupBy("band", "slot").agg(F.max_by("id", F.xxhash64("id", "band", F.lit(turn))).alias("head")).groupBy("band").agg(F.collect_list("head").alias("heads"))  # at most HEADS
        outside = by_band(placed.where("component <> main"), heads)
        head = F.element_at("heads", (F.pmod(F.xxhash64("id", "band", F.lit(turn)), F.size("heads")) + 1).cast("int"))
        links = links.unionByName(links_of(outside.select(F.least("id", head).alias("a"), F.greatest("id", head).alias("b")).distinct()))
        discard(apart, placed, parts)
        parts = stash(components(links), "components")
    discard(shared, counts)
    # classes with copies of their own, then the ids themselves
    classed = classes.join(parts, "id", "left").select("digest", F.col("id").alias("rep"), F.coalesce("component", "id").alias("component"), "copies")
    total = max(1000, sketches.count() // 1000)
    alike = sketches.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "digest")
    many = classed.where(F.col("copies") > total).select("digest", "component")  # at most a thousand
    few = classed.where(F.col("copies") <= total).select("digest", "component")
    by_many = alike.join(F.broadcast(many), "digest", "left")
    found = by_many.where("component is not null").select("doc_id", "n_shingles", "component").unionByName(by_many.where("component is null").select("doc_id", "n_shingles", "digest").join(few, "digest").select("doc_id", "n_shingles", "component"))
    alone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return found.unionByName(alone).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: of each component the row with the least id.

    A row goes by its own text. Where ids repeat, rows are told apart by numbers that follow their ids, so of rows that
    share id and text one stays, and a row isn't lost to another text of its id. A text without words links with nothing
    and stays; so does a row without an id. An empty table gives an empty result.
    """
    (name,) = fresh(docs, "gone_id")
    known = docs.where(F.col(id_column).isNotNull())
    if not known.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return _without(docs, near_components(docs, id_column, text_column), F.col(id_column), name)
    # numbers in the order of ids: by range, then from the first of its range on
    row, number, place = fresh(docs, "row_number", "row_place", "range_place")
    docs = stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keys = docs.where(F.col(id_column).isNotNull()).select(F.col(row).alias("row"), F.col(id_column).alias("id"))
    keys = ranged(keys, [F.col("id"), F.col("row")], docs.count(), "ids")
    keys = keys.withColumn("at", F.row_number().over(W.partitionBy("_range").orderBy("id", "row"))).join(before_ranges(keys, before=F.count(F.lit(1))), "_range")
    keys = stash(keys.select(F.col("row").alias(place), (F.col("at") + F.col("before")).alias(number)), "places")
    docs = stash(docs.join(keys, F.col(row) == F.col(place), "left").drop(place), "placed")
    return _without(docs, near_components(docs, number, text_column), F.col(number), name).drop(row, number)


def _without(docs: DataFrame, found: DataFrame, key: Column, name: str) -> DataFrame:
    gone = stash(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "dropped")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key.eqNullSafe(F.col(name)), "left_anti")


ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
e as (select x, y from l union all select y, x from l),
reach as (select x as id, x as m from e union select e.y, r.m from reach r join e on e.x = r.id),
c as (select id, min(m) as m from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.m, d.doc_id) as component_id, coalesce(c.m, d.doc_id) = d.doc_id as kept from documents d left join n on n.doc_id = d.doc_id left join c on c.id = d.doc_id
"""
