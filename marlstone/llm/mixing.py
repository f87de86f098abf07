"""Mixing sources to target weights with a time-varying curriculum.

Training time runs from 0 to 1. A source's weight over time is its target times a piecewise linear schedule whose integral
is 1; the integral up to t is the cumulative token demand, and reaches the target at 1. A source's documents stand in a
fixed hash order, repeated from the start when they run out; the word at which a document's reading begins is inverted
through the demand to the time at which it is due, and documents are range-sorted by that position. All of it is native
Spark; running sums take two levels, so neither a source that holds most rows nor a table of very many sources is one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators.skew import hot_keys, salted_join

from .common import BROADCAST_ROWS, before_ranges, discard, fresh, narrow_to, ranged, stash

MOST_TIMES = 3
#: Rows of a bucket that one running sum covers, on average.
BUCKET_ROWS = 4_000
#: Weights of sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Schedules, repeating likewise: points (time, weight) joined by lines. By default from early to late sources.
SCHEDULES = tuple(((0.0, 1 - slope), (1.0, 1 + slope)) for slope in (-0.5, -0.25, 0.0, 0.25, 0.5))
_UPTO, _BEFORE = (W.unboundedPreceding, W.currentRow), (W.unboundedPreceding, -1)
Schedule = Sequence[tuple[float, float]]


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: int = len(SCHEDULES)) -> DataFrame:
    """source, source_size, target, schedule (a number below ``schedules``) from (source, source_size), a row for each source.

    Weights repeat over sources by code point, null last. Sharing the excess of capped sources by weight until none is
    above its cap ends where every target is min(cap, level * weight) for one level; sources sorted by cap / weight give
    the level from running sums. Both orders are cut into ranges, summed inside each and from range to range.
    """
    n = sizes.count()
    named = ranged(sizes, [F.col("source").asc_nulls_last()], n, "sources")
    inside = W.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    ranked = named.withColumn("at", F.row_number().over(inside) - 1).join(before_ranges(named, before=F.count(F.lit(1))), "_range")
    rank = F.col("at") + F.col("before")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights)).cast("int") + 1)
    ranked = ranked.select("source", "source_size", rank.alias("rank"), weight.alias("weight"), (rank % schedules).cast("int").alias("schedule"), (F.col("source_size").cast("double") * MOST_TIMES).alias("cap"))
    ranked = ranged(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), [F.col("ratio"), F.col("rank")], n, "ratios")
    discard(named)
    by_ratio = W.partitionBy("_range").orderBy("ratio", "rank")
    rows = ranked.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(*_BEFORE)), F.lit(0.0))).withColumn("passed", F.coalesce(F.sum("weight").over(by_ratio.rowsBetween(*_BEFORE)), F.lit(0.0)))
    rows = rows.join(before_ranges(ranked, caps=F.sum("cap"), weights=F.sum("weight")), "_range")
    whole = F.broadcast(ranked.agg(F.sum("source_size").cast("double").alias("total"), F.sum("weight").alias("all_weights")))  # one row
    # while sources are above their caps the level rises with each that is capped, then it falls: the largest is the one
    level = (F.col("total") - F.col("caps") - F.col("capped")) / (F.col("all_weights") - F.col("weights") - F.col("passed"))
    highest = F.broadcast(rows.crossJoin(whole).agg(F.max(level).alias("level")))  # one row
    return ranked.crossJoin(highest).select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"), "schedule")


def _pieces(schedule: Schedule) -> list[tuple[float, ...]]:
    """(begin, length, weight at the begin, slope, demand before, demand with it) of each piece, scaled to a demand of 1."""
    times, weights = [t for t, _ in schedule], [w for _, w in schedule]
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pairwise(schedule))
    if times != sorted(set(times)) or (times[0], times[-1]) != (0, 1) or min(weights) < 0 or area <= 0:
        raise ValueError("a schedule's times must ascend from 0 to 1, its weights be 0 at least and not all 0")
    out, demand = [], 0.0
    for (t0, w0), (t1, w1) in pairwise(schedule):
        before, demand = demand, demand + (t1 - t0) * (w0 + w1) / 2 / area
        out.append((float(t0), float(t1 - t0), w0 / area, (w1 - w0) / area / (t1 - t0), before, demand))
    return out


def with_due(rows: DataFrame, turn: Column, name: str, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """``rows`` of _placed() with the time at which reading number ``turn`` (from 0) begins: the inverse of the cumulative demand."""
    fields = ("begin", "length", "weight", "slope", "before", "upto")
    known = F.array(*(F.array(*(F.struct(*(F.lit(x).alias(f) for f, x in zip(fields, p, strict=True))) for p in _pieces(s))) for s in schedules))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("begins") + turn * F.col("source_size"), F.col("target"))))
    rows = rows.withColumn("_share", share).withColumn("_pieces", F.element_at(known, F.col("schedule") + 1))
    piece = F.coalesce(F.get(F.filter("_pieces", lambda p: F.col("_share") < p["upto"]), F.lit(0)), F.element_at("_pieces", -1))
    rows = rows.withColumn("_piece", piece).withColumn("_left", F.greatest(F.col("_share") - F.col("_piece.before"), F.lit(0.0)))
    # weight x + slope x^2 / 2 = left, by the form that no slope of 0 breaks
    root = F.sqrt(F.greatest(F.col("_piece.weight") * F.col("_piece.weight") + 2 * F.col("_piece.slope") * F.col("_left"), F.lit(0.0)))
    step = F.coalesce(F.try_divide(2 * F.col("_left"), F.col("_piece.weight") + root), F.lit(0.0))
    return rows.withColumn(name, F.col("_piece.begin") + F.least(F.col("_piece.length"), step)).drop("_share", "_pieces", "_piece", "_left")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 0, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """doc_id, size, source_size, target, taken, position for every row of ``docs``, in training order.

    size counts words (null text: 0). A source takes whole readings of its documents in hash order until its target is
    reached; the last document is read in part, so a source's taken words are its target rounded. position is the time
    of the first reading, null if nothing is taken. ``weights`` and ``schedules`` repeat over the sources by name. Null is
    a source of its own. Repeated rows are documents of their own, and so are rows without an id; rows alike in id,
    source and text are interchangeable. An empty table gives an empty result. Other columns are not read.
    """
    rows = with_due(_placed(_sized(docs, id_column, text_column, source_column, seed), weights, len(schedules)), F.lit(0), "position", schedules)
    return rows.withColumn("position", F.when(F.col("taken") > 0, F.col("position"))).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: int, row: Column | None = None) -> DataFrame:
    """doc_id, source, size, order and row of every row: its place in its source's order, and a number that no other row has."""
    text, name = F.coalesce(F.col(text_column), F.lit("")), F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), words.alias("size"), _order(F.concat_ws(":", name, F.lit(str(seed)), F.md5(text.cast("binary")))).alias("order"), (F.monotonically_increasing_id() if row is None else row).alias("row"))
    sized = stash(sized, "sized")
    # of rows alike in id and text so many that a bucket would grow with them: each copy gets an order of its own by its number
    alike = sized.groupBy("order").agg(F.count(F.lit(1)).alias("n"))
    many = alike.where(F.col("n") > BUCKET_ROWS).select("order")
    n = many.count()  # at most one for BUCKET_ROWS rows of the table
    if not n:
        return sized
    many = stash(many, "many")
    copies = narrow_to(sized, many, n, "order").withColumn("part", F.shiftright("row", 33))
    key = ["order", "name", "part"]
    copies = copies.withColumn("name", _name())
    parts = copies.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("before", F.sum("n").over(W.partitionBy("order", "name").orderBy("part")) - F.col("n")).drop("n")
    copies = copies.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("row"))).join(before, key)
    copies = copies.withColumn("order", _order(F.concat_ws(":", "order", F.col("before") + F.col("n"))))
    few = many.withColumnRenamed("order", "hot_order")
    rest = sized.join(F.broadcast(few) if n <= BROADCAST_ROWS else few, F.col("order") == F.col("hot_order"), "left_anti")
    return rest.unionByName(copies.select(*sized.columns))


def _order(text: Column) -> Column:
    """60 bits of a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _name() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def _placed(sized: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: int = len(SCHEDULES)) -> DataFrame:
    """Every row with its source's size, target and schedule, the words that stand before it and the words taken."""
    sizes = stash(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "sizes")
    goals = targets(sizes.select("source", "source_size"), weights, schedules).withColumn("name", _name()).drop("source")
    counts = sizes.select(_name().alias("name"), "docs", F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_ROWS)).alias("buckets"))
    per = stash(goals.join(counts, "name"), "targets")
    sized, n = sized.withColumn("name", _name()), per.count()
    if n <= BROADCAST_ROWS // 10:
        rows = sized.join(F.broadcast(per.drop("docs")), "name")
    else:
        rows = salted_join(sized, per.drop("docs"), "name", hot_keys(per, "name", "docs", sized.count()), ["row"])
    # the hash order cut into ranges, as many for a source as its rows ask for
    rows = rows.withColumn("bucket", F.floor(F.col("order").cast("double") / F.lit(float(1 << 60)) * F.col("buckets")))
    starts = rows.groupBy("name", "bucket").agg(F.sum("size").alias("in_bucket"))
    starts = starts.withColumn("before_bucket", F.sum("in_bucket").over(W.partitionBy("name").orderBy("bucket")) - F.col("in_bucket")).drop("in_bucket")
    inside = W.partitionBy("name", "bucket").orderBy("order", "doc_id", "size", "row").rowsBetween(*_UPTO)
    rows = rows.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(starts, ["name", "bucket"]).withColumn("begins", F.col("before_bucket") + F.col("within"))
    goal = F.round("target").cast("long")
    # goal div size readings are complete for all; the rest of the goal goes to the front of the order
    full = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    last = F.least("size", F.greatest(F.lit(0), goal - full * F.col("source_size") - F.col("begins")))
    return rows.withColumn("taken", (full * F.col("size") + last).cast("long"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """The columns of ``docs``, whatever their names, one row for each reading that the mix takes, range-sorted by position.

    Readings are whole: of a document at its source's boundary one more is taken if its middle lies before the goal, so a
    source's words are within half a document of its target. Each row is a document of its own, whether it repeats an id,
    all of a row, or has none. A null or empty text has no words and is never taken. An empty table gives an empty result.
    The table is written once with a number for each row, by which readings find their row again.
    """
    row, at, turn, wanted = fresh(docs, "row_number", "reading_at", "reading_turn", "reading_row")
    kept = stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    # what is left over from complete readings is at least half of the text where its middle lies before the goal
    readings = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    took = _placed(_sized(kept, "doc_id", "text", "source", 0, F.col(row)), weights, len(schedules)).where("taken > 0").withColumn("readings", readings).where("readings > 0")
    took = stash(took.select("row", "readings", "begins", "source_size", "target", "schedule"), "took")
    n = took.count()
    took = with_due(took.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("readings") - 1))), F.col("turn"), "at", schedules)
    took = took.select(F.col("row").alias(wanted), F.col("turn").alias(turn), F.col("at").alias(at))
    out = kept.join(F.broadcast(took) if n <= BROADCAST_ROWS // MOST_TIMES else took, F.col(row) == F.col(wanted))
    return out.orderBy(at, "doc_id", row, turn).select(*docs.columns)


#: The mix by default weights and schedules over ``documents``.
ORACLE = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':0:' || md5(coalesce(text, ''))), 1, 15) as bigint) as o from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
r as (select *, rank % 3 + 1.0::double as weight, source_size * 3.0::double as cap from s),
l as (select max(((select sum(source_size) from s) - before) / weight_left) as level from (select coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as weight_left from r)),
t as (select source, source_size, least(cap, level * weight) as target, (rank % 5 - 2) / 4.0::double as slope from r, l),
b as (select d.*, source_size, target, slope, cast(round(target) as bigint) as goal, (sum(size) over (partition by d.source order by o, doc_id, size rows between unbounded preceding and current row))::bigint - size as begins from d join t on d.source is not distinct from t.source),
k as (select *, case when source_size > 0 then goal // source_size * size + least(size, greatest(0, goal - goal // source_size * source_size - begins)) else 0 end as taken, least(1.0::double, begins / nullif(target, 0)) as share from b)
select doc_id, size::bigint as size, source_size, target, taken::bigint as taken, case when taken > 0 then round(2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)), 9) end as position from k
"""
