"""The given tables seen as the engine's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.skew import BROADCAST_ROWS

#: A snapshot's place among those of one time: all other columns, so the order is total up to equal rows.
SNAPSHOT_ORDER = ("fetched_at", "line", "supplier", "quantity", "price", "discount", "tax", "flag")
#: A posting is a company and a part; both fit 31 bits, so that ids are whole numbers below 2**63.
PART_SPAN = 4294967296


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Tables:
    companies: DataFrame
    runs: DataFrame
    snapshots: DataFrame
    postings: DataFrame
    classifications: DataFrame
    terms: DataFrame


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "failed").otherwise("in_progress")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), status.alias("status"))


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_id, title, location_text, p_size of parts: the texts of their snapshots."""
    place = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Remote, "), F.col("p_name"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("hybrid "), F.col("p_name"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("On-site "), F.col("p_name"))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("title"), place.alias("location_text"), "p_size")


def _lines(spark: SparkSession, sf_dir: str, parts: DataFrame | None) -> DataFrame:
    """Line items, or those of ``parts`` (part_id) before they are dealt for any join. A posting is of one part, so it is kept or dropped whole."""
    line = read(spark, sf_dir, "lineitem")
    if parts is None:
        return line
    few = parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return line.join(F.broadcast(parts) if few else parts, F.col("l_partkey") == F.col("part_id"), "left_semi")


def snapshots(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """Line items as snapshots: text from the part's name, a reported workplace for some, JSON built from a flag for others; of ``parts`` alone if given."""
    line = _lines(spark, sf_dir, parts).join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.join(part_texts(spark, sf_dir).select(F.col("part_id").alias("p_partkey"), "title", "location_text"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return line.select(
        F.col("l_orderkey").alias("fetch_run_id"), (F.col("o_custkey") * F.lit(PART_SPAN) + F.col("l_partkey")).alias("job_posting_id"), F.col("o_custkey").alias("company_id"),
        F.col("l_partkey").alias("part_id"), F.col("o_orderdate").cast("timestamp").alias("run_at"), F.col("l_shipdate").cast("timestamp").alias("fetched_at"), "title",
        "location_text", F.when(F.col("l_returnflag") == "A", "onsite").alias("workplace_type"), F.when(F.col("l_returnflag") == "R", F.lit('{"telecommuting": true}')).otherwise(F.lit('{"telecommuting": false}')).alias("raw_data"),
        F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_posting_id, company_id, fetch_run_id of snapshots: from line items and orders alone."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return line.select((F.col("o_custkey") * F.lit(PART_SPAN) + F.col("l_partkey")).alias("job_posting_id"), F.col("o_custkey").alias("company_id"), F.col("l_orderkey").alias("fetch_run_id"))


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id, fetched_at of snapshots: from line items and orders alone."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("company_id"))
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("fetched_at"))
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("company_id", "fetched_at")


def postings(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """Company and part of a posting follow from its id, and its first sighting from line items and orders alone; of ``parts`` alone if given."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("run_at"))
    seen = _lines(spark, sf_dir, parts).select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    first = seen.groupBy((F.col("o_custkey") * F.lit(PART_SPAN) + F.col("l_partkey")).alias("id")).agg(F.min("run_at").alias("first_seen_at"))
    return first.select("id", F.shiftright("id", 32).alias("company_id"), (F.col("id") % PART_SPAN).alias("part_id"), "first_seen_at")


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as classifications of a part, and so of every posting for it."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("part_id"), F.col("ts").cast("timestamp").alias("classified_at"), F.col("event_type").alias("seniority"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classification_id, term_kind, slug, name: brand as role, type as specialization, words of the name as skills, region as function."""
    part = read(spark, sf_dir, "part")
    own = read(spark, sf_dir, "events").select(F.col("event_id").alias("classification_id"), F.col("user_id").alias("p_partkey")).join(part, "p_partkey")
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    one = lambda kind, c: own.select("classification_id", F.lit(kind).alias("term_kind"), slug(c).alias("slug"), c.alias("name"))
    skills = own.select("classification_id", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    function = own.join(F.broadcast(region), F.col("p_size") % 5 == F.col("r_regionkey"))  # five rows by its schema
    parts = one("role", F.col("p_brand")).unionByName(one("specialization", F.col("p_type")))
    parts = parts.unionByName(skills.select("classification_id", F.lit("skill").alias("term_kind"), slug(F.col("w")).alias("slug"), F.col("w").alias("name")))
    return parts.unionByName(function.select("classification_id", F.lit("function").alias("term_kind"), slug(F.col("r_name")).alias("slug"), F.col("r_name").alias("name")))


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(companies(spark, sf_dir), runs(spark, sf_dir), snapshots(spark, sf_dir), postings(spark, sf_dir), classifications(spark, sf_dir), terms(spark, sf_dir))
