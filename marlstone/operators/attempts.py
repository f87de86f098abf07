"""Attempts to classify a posting folded to one outcome: a batch's call first, single retries after it, up to a limit.

A log of calls (call_id, seq, error, cancelled, body) and whom each addressed (call_id, posting_id) is what a runner leaves
behind. Calls count in the order of seq, then call_id; a posting's later calls don't count once one gave a sound answer, was
cancelled, or the retries were used up, so a log with more calls than needed gives the same outcomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.expr import strip_code_fence
from marlstone.operators.lineage import cut
from marlstone.operators.validation import judged

MOST_RETRIES = 3
#: The shape of an answer; what has another shape is no answer.
ANSWER = (
    "results array<struct<posting_id: long, summary: string, classification: struct<seniority: string, notes: string>, "
    "canonical_roles: array<struct<slug: string, name: string, dimensions: array<string>, notes: string>>, "
    "specializations: array<struct<slug: string, name: string>>, skills: array<struct<slug: string, name: string>>>>, _odd string"
)


def addressed(calls: DataFrame, asked: DataFrame) -> DataFrame:
    """call_id, posting_id, seq, error, cancelled, broken, answered, a (the answer) of each posting that a call addressed, once.

    broken: the body isn't an answer: no JSON, another shape, or an id twice, also one that nobody asked for. Calls, what they
    answered and whom they addressed meet in one shuffle by call; a body is parsed once, behind it. A call_id must be given once.
    """
    known = F.col("call_id").isNotNull()
    lines = asked.where(known & F.col("posting_id").isNotNull()).select("call_id", "posting_id", F.lit(True).alias("asked"))
    lines = lines.unionByName(calls.where(known).select("call_id", "seq", "error", F.coalesce("cancelled", F.lit(False)).alias("cancelled"), "body"), allowMissingColumns=True).repartition("call_id")
    done = F.col("asked").isNull() & F.col("error").isNull() & ~F.col("cancelled")
    lines = lines.withColumn("r", F.from_json(strip_code_fence(F.when(done, F.col("body"))), ANSWER, {"columnNameOfCorruptRecord": "_odd"}))
    ids = F.transform("r.results", lambda a: F.coalesce(a.posting_id, F.lit(0)))
    twice = F.coalesce(F.size(F.array_distinct(ids)) < F.size(ids), F.lit(False))
    lines = lines.select("call_id", "posting_id", "asked", "seq", "error", "cancelled", (done & (F.col("r").isNull() | F.col("r._odd").isNotNull() | twice)).alias("broken"), F.col("r.results").alias("results"))
    # a call stands first, then each posting's requests with the answer behind them
    line = lambda kind, posting, answer: F.struct(F.lit(kind).alias("kind"), posting.alias("posting_id"), answer.alias("a"))
    none = F.get("results", F.lit(-1))
    said = F.transform(F.when(~F.col("broken"), F.col("results")), lambda a: line(2, F.coalesce(a.posting_id, F.lit(0)), a))
    parts = F.when(F.col("asked"), F.array(line(1, F.col("posting_id"), none))).otherwise(F.flatten(F.array_compact(F.array(F.array(line(0, F.lit(None).cast("long"), none)), said))))
    lines = lines.select("call_id", "seq", "error", "cancelled", "broken", F.explode(parts).alias("l")).select("call_id", "seq", "error", "cancelled", "broken", "l.*")
    by_call = W.partitionBy("call_id").orderBy("posting_id", "kind")
    head = F.first(F.struct("kind", "seq", "error", "cancelled", "broken")).over(by_call.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = lines.select("call_id", "posting_id", "kind", head.alias("c"), F.lead(F.struct("kind", "posting_id", "a")).over(by_call).alias("n"))
    again = F.coalesce(F.col("n.posting_id") == F.col("posting_id"), F.lit(False))
    answered = again & (F.col("n.kind") == 2)
    rows = rows.where((F.col("kind") == 1) & (F.col("c.kind") == 0) & ~(again & (F.col("n.kind") == 1)))
    return rows.select("call_id", "posting_id", "c.seq", "c.error", "c.cancelled", "c.broken", answered.alias("answered"), F.when(answered, F.col("n.a")).alias("a"))


def outcomes(postings: DataFrame, calls: DataFrame, asked: DataFrame, taxonomy: DataFrame, dimensions: DataFrame, retries: int = MOST_RETRIES) -> tuple[DataFrame, DataFrame]:
    """(posting_id, outcome, attempts, last_reason, summary, payload_id of each posting, the payloads of those enriched).

    enriched: the last call that counts gave a payload that breaks no rule. validation_failed: some call was answered, none
    soundly. json_failed: no call was answered. A cancelled call ends the attempts without being one; a posting that no call
    addressed was cancelled before its batch. summary is that of the last answer. A call counts once for a posting, however
    often it is listed. All postings of one fold are held against the same taxonomy: it is a wave's.

    What calls gave is shuffled by call, then by posting, and judged and folded there; the fold is kept, since outcomes and payloads are read from it.
    """
    line = W.partitionBy("posting_id").orderBy("seq", "call_id")
    # a rank that is filtered at once is cut in each task before the shuffle
    tried = addressed(calls, asked).withColumn("place", F.row_number().over(line)).where(F.col("place") <= retries + 1)
    own = F.struct("a.classification.seniority", "a.classification.notes", F.col("a.canonical_roles").alias("roles"), "a.specializations", "a.skills")
    step = F.struct("cancelled", "error", "broken", "answered", "a.summary", F.when(F.col("answered"), F.concat_ws(":", "call_id", "posting_id")).alias("payload_id"), F.when(F.col("answered"), own).alias("payload"))
    tried = tried.select("posting_id", "place", step.alias("step")).select("posting_id", "place", "step", "step.payload_id", "step.payload.*")
    rows = judged(tried, taxonomy, dimensions, keep=["posting_id", "place"], once=["step"])
    row = F.struct("place", "step", F.when(F.col("fails"), F.concat_ws(": ", "path", "code")).alias("fault"))
    # at most the terms of retries + 1 answers of a posting meet here
    folded = rows.groupBy("posting_id").agg(F.collect_list(row).alias("x"))
    faults = lambda place: F.array_join(F.array_sort(F.transform(F.filter("x", lambda y: (y.place == place) & y.fault.isNotNull()), lambda y: y.fault)), "; ")
    reason = lambda s, fault: F.when(s.cancelled, "cancelled").when(s.error.isNotNull(), s.error).when(s.broken, "no json").when(~s.answered, "missing from the answer").otherwise(fault)
    steps = F.transform(F.array_sort(F.transform(F.filter("x", lambda y: y.step.isNotNull()), lambda y: F.struct(y.place.alias("place"), y.step.alias("s")))), lambda y: F.struct(y.s.alias("s"), reason(y.s, faults(y.place)).alias("reason")))
    folded = folded.select("posting_id", steps.alias("h"))
    sound = lambda y: y.s.answered & (y.reason == "")
    folded = folded.withColumn("end", F.array_position(F.transform("h", lambda y: sound(y) | y.s.cancelled), True).cast("int"))
    folded = folded.select("posting_id", F.when(F.col("end") > 0, F.slice("h", 1, F.col("end"))).otherwise(F.col("h")).alias("h"))
    folded = folded.select("posting_id", F.element_at("h", -1).alias("last"), F.filter("h", lambda y: y.s.answered).alias("said"), F.size(F.filter("h", lambda y: ~y.s.cancelled)).cast("long").alias("attempts"))
    good = sound(F.col("last"))
    outcome = F.when(good, "enriched").when(F.size("said") > 0, "validation_failed").otherwise("json_failed")
    out = folded.select("posting_id", outcome.alias("outcome"), "attempts", F.col("last.reason").alias("last_reason"), F.when(F.size("said") > 0, F.element_at("said", -1)["s"]["summary"]).alias("summary"), F.when(good, F.col("last.s.payload_id")).alias("payload_id"), F.when(good, F.col("last.s.payload")).alias("payload"))
    out = postings.select("posting_id").distinct().join(out, "posting_id", "left")
    never = F.col("outcome").isNull()
    out = cut(out.select("posting_id", F.coalesce("outcome", F.lit("json_failed")).alias("outcome"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.when(never, "cancelled").otherwise(F.col("last_reason")).alias("last_reason"), "summary", "payload_id", "payload"))
    return out.drop("payload"), out.where("payload_id is not null").select("posting_id", "payload_id", "payload.*")
