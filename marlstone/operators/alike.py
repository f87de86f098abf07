"""Names that are alike, counted and ranked without a row for each pair.

Where most names share most of their trigrams, nearly every pair meets at some trigram, and pairs as rows of a join cost
what no cluster has. Here the known names are dealt into parts and the asked ones into blocks, both bounded by the trigrams
they hold, and each block meets each part once: the part is an index from trigram to names, a name's hits are added up
over the lists of its trigrams, and what leaves is its number of matches in the part and the best of them. All pairs are
still told apart, but by a byte each, and what is shuffled is each part once for a block and each block once for a part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trigrams of a part and of a block (about 100,000 names of 20): some 200 MB of a task.
BLOCK_GRAMS = 2_000_000
_FOUND = pa.schema([("input_index", pa.int64()), ("match_count", pa.int64()), ("top", pa.list_(pa.struct([("score", pa.float64()), ("neg", pa.int64())])))])


def least_common(n: int, m: np.ndarray, threshold: float) -> np.ndarray:
    """For sets of n and m trigrams, the least number in common at which their similarity, in single precision, reaches the
    threshold; m + 1 if none does."""
    both = np.maximum(np.floor(threshold * (n + m) / (1 + threshold) * (1 - 1e-6)), 1)
    while (short := (both / (n + m - both)).astype(np.float32) < np.float32(threshold)).any():
        both += short
    return np.where(both > np.minimum(n, m), m + 1, both).astype(np.int64)


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the sets after a leading 0, all their trigrams) of a column of arrays."""
    sets = column.combine_chunks()
    return np.r_[0, np.cumsum(sets.value_lengths().to_numpy(), dtype=np.int64)], sets.flatten().to_numpy()


def _meet(threshold: float, shown: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block (input_index, grams) against a part (id, n, grams) as (input_index, match_count, top): see alike()."""

    def meet(block: pa.Table, part: pa.Table) -> pa.Table:
        if not block.num_rows or not part.num_rows:
            return _FOUND.empty_table()
        part = part.sort_by("id")  # so that the first of equals has the smallest id
        ids, weight = part["id"].to_numpy(), part["n"].to_numpy()
        ends, grams = _sets(part["grams"])
        sizes = np.diff(ends)
        hits_type = np.min_scalar_type(-int(sizes.max()) - 2)
        by = np.argsort(grams, kind="stable")
        holders = np.repeat(np.arange(len(ids)), sizes)[by]
        codes, starts = np.unique(grams[by], return_index=True)
        starts = np.r_[starts, len(holders)]
        # lists that hold a good part of the names are added as whole vectors, once for all names that share them
        dense = {}
        for g in np.flatnonzero(np.diff(starts) * 16 > len(ids)).tolist():
            dense[g] = np.zeros(len(ids), hits_type)
            dense[g][holders[starts[g] : starts[g + 1]]] = 1
        asked_ends, asked = _sets(block["grams"])
        at = np.searchsorted(codes, asked)
        at[codes[np.minimum(at, len(codes) - 1)] != asked] = -1
        names = []
        for i, (a, b) in enumerate(zip(asked_ends[:-1].tolist(), asked_ends[1:].tolist(), strict=True)):
            lists = [g for g in at[a:b].tolist() if g >= 0]
            names.append((b - a, sorted(g for g in lists if g in dense), [g for g in lists if g not in dense], i))
        names.sort()
        last, need, base = (None, None), None, None
        found, counts, tops, scores, best = [], [], [0], [], []
        for n, shared, own, i in names:
            if n != last[0]:
                need = least_common(n, np.arange(1, sizes.max() + 1), threshold)[sizes - 1].astype(hits_type)
            if (n, shared) != last:
                last, base = (n, shared), sum((dense[g] for g in shared), -need)
            hits = base.copy() if own else base
            for g in own:
                hits[holders[starts[g] : starts[g + 1]]] += 1  # a name has a trigram once
            alike = np.flatnonzero(hits >= 0)
            if not len(alike):
                continue
            both = hits[alike].astype(np.int64) + need[alike]
            score = (both / (n + sizes[alike] - both)).astype(np.float32).astype(np.float64)
            found.append(i)
            counts.append(int(weight[alike].sum()))
            for _ in range(min(shown, len(alike))):
                k = int(score.argmax())
                scores.append(float(score[k]))
                best.append(int(alike[k]))
                score[k] = -1
            tops.append(len(best))
        pairs = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(-ids[np.array(best, np.int64)])], ["score", "neg"])
        columns = [block["input_index"].take(pa.array(found, pa.int64())), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(tops, pa.int32()), pairs)]
        return pa.table(columns, names=_FOUND.names)

    return meet


def alike(asked: DataFrame, known: DataFrame, threshold: float, shown: int, most: int = BLOCK_GRAMS) -> DataFrame:
    """input_index, match_count, top of each asked set (input_index, grams) that any known one (id, n, grams) is alike: the sum of n
    over those whose similarity reaches the threshold, and the ``shown`` most alike as (score, neg, the negative id), best first,
    ties to the smaller id. Sets have distinct trigrams and at least one, ids are distinct."""
    blocks, parts = (max(1, -(-(df.agg(F.sum(F.size("grams"))).first()[0] or 0) // most)) for df in (asked, known))
    dealt = lambda df, key, own, other: df.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(own))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    left = dealt(asked, "input_index", blocks, parts).select((F.col("_own") * parts + F.col("_other")).cast("int").alias("_at"), F.col("input_index").cast("long").alias("input_index"), "grams")
    right = dealt(known, "id", parts, blocks).select((F.col("_other") * parts + F.col("_own")).cast("int").alias("_at"), F.col("id").cast("long").alias("id"), "n", "grams")
    # a task for each meeting: these are few rows with much work
    left, right = (df.repartitionById(blocks * parts, "_at").groupBy("_at") for df in (left, right))
    met = left.cogroup(right).applyInArrow(_meet(threshold, shown), "input_index long, match_count long, top array<struct<score: double, neg: long>>")
    return met.groupBy("input_index").agg(F.sum("match_count").alias("match_count"), F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, shown).alias("top"))
