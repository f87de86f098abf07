"""Text that most descriptions of a company share, found and cut out.

A window of 200 bytes qualifies if at least ``ceil(0.6 n)`` of the company's n texts hold it. Counting every window of
every text would shuffle as many rows as there are bytes, so a window is first represented by the least hash among the
32-byte pieces inside it, which each of its copies has too: only where that piece is frequent are whole windows counted.
A company with most of the texts is no single group: all counting is by (company, hash) with partial aggregation, what
qualifies in a company is bounded by the mean length of its texts over 0.6, and where it meets the company's texts they
are dealt over parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.skew import hot_keys, salted_join

WINDOW, PREVALENCE, LEAST_TEXTS, PIECE = 200, 0.6, 3, 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = b" \t\n\r\f\v"


def rolling(raw: bytes, width: int) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` bytes, by doubling: a window's hash joins those of its two halves."""
    if len(raw) < width:
        return np.zeros(0, np.uint64)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * _BASE
        return x ^ (x >> np.uint64(29))

    h = mix(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1))
    out, done, size, left = None, 0, 1, width
    while left:
        if left & 1:
            piece = h[done:]
            out = piece if out is None else mix(out[: len(piece)] * np.uint64(3) + piece[: len(out)])
            done += size
        left >>= 1
        if left:
            h = mix(h[:-size] * np.uint64(5) + h[size:])
            size *= 2
    return out[: len(raw) - width + 1]


def anchors(raw: bytes) -> np.ndarray:
    """For each window, the least hash of the pieces inside it."""
    h = rolling(raw, PIECE)
    span = WINDOW - PIECE + 1
    if len(h) < span:
        return np.zeros(0, np.uint64)
    width = 1
    while width * 2 <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (span - width)], h[span - width :])


def _each(out_schema: pa.Schema, fn):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for r in batch.to_pylist() for x in fn(r)]
            yield pa.RecordBatch.from_pylist(rows, out_schema)

    return run


def _spans(raw: bytes, good: np.ndarray) -> list[bytes]:
    """Runs of qualifying windows as spans, trimmed to blanks, those that stay long enough."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2] - 1 + WINDOW
    # a place may cut where a blank stands on either side of it, or at the text's ends: the next such place, and the last
    blank = np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(_BLANK, np.uint8))
    cuts = np.flatnonzero(np.concatenate([[True], blank[1:] | blank[:-1], [True]]))
    begins, ends = cuts[np.searchsorted(cuts, begins)], cuts[np.searchsorted(cuts, ends, "right") - 1]
    return [raw[a:b] for a, b in zip(begins, ends, strict=True) if b - a >= WINDOW]


def cut_spans(text: str, spans: list[bytes]) -> str:
    """The text without the spans, longest first (ties by bytes); a blank on each side goes with a span, and its ends close up."""
    raw = original = text.encode()
    for s in sorted(spans, key=lambda s: (-len(s), s)):
        at = raw.find(s)
        while at >= 0:
            raw = raw[:at].removesuffix(b" ") + raw[at + len(s) :].removeprefix(b" ")
            at = raw.find(s)
    if raw == original:
        return text
    cleaned = re.sub(" {2,}", " ", raw.decode("utf-8", "ignore")).strip()
    return cleaned or text


def strip_boilerplate(texts: DataFrame) -> DataFrame:
    """job_posting_id, stripped of (company_id, job_posting_id, description_text), one row for each text that isn't null.

    Companies with fewer than three texts keep theirs as they are, and so does a text that nothing would be left of.
    """
    texts = texts.select("company_id", "job_posting_id", "description_text").where("description_text is not null")
    sized = texts.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS)
    least = F.ceil(F.col("n") * PREVALENCE - 1e-9)
    hot = hot_keys(sized, "company_id", "n", texts.count())

    def with_company(of: DataFrame, how: str = "inner") -> DataFrame:
        return salted_join(texts, of, "company_id", hot, ["job_posting_id"], how)

    rows = with_company(sized.select("company_id"))
    pair = pa.schema([("company_id", pa.int64()), ("h", pa.int64())])

    def first(r: dict) -> list[dict]:
        return [{"company_id": r["company_id"], "h": x} for x in np.unique(anchors(r["description_text"].encode())).view(np.int64).tolist()]

    frequent = rows.mapInArrow(_each(pair, first), "company_id long, h long").groupBy("company_id", "h").count().join(sized, "company_id").where(F.col("count") >= least).groupBy("company_id").agg(F.sort_array(F.collect_list("h")).alias("anchors"))

    def second(r: dict) -> list[dict]:
        raw = r["description_text"].encode()
        good = np.isin(anchors(raw).view(np.int64), np.array(r["anchors"], np.int64))
        return [{"company_id": r["company_id"], "h": x} for x in np.unique(rolling(raw, WINDOW)[good]).view(np.int64).tolist()]

    windows = with_company(frequent).mapInArrow(_each(pair, second), "company_id long, h long").groupBy("company_id", "h").count().join(sized, "company_id").where(F.col("count") >= least).groupBy("company_id").agg(F.sort_array(F.collect_list("h")).alias("windows"))
    span = pa.schema([("company_id", pa.int64()), ("span", pa.binary())])

    def third(r: dict) -> list[dict]:
        raw = r["description_text"].encode()
        return [{"company_id": r["company_id"], "span": s} for s in _spans(raw, np.isin(rolling(raw, WINDOW).view(np.int64), np.array(r["windows"], np.int64)))]

    spans = with_company(windows).mapInArrow(_each(span, third), "company_id long, span binary").distinct().groupBy("company_id").agg(F.collect_list("span").alias("spans"))
    out = pa.schema([("job_posting_id", pa.int64()), ("stripped", pa.string())])

    def fourth(r: dict) -> list[dict]:
        return [{"job_posting_id": r["job_posting_id"], "stripped": cut_spans(r["description_text"], r["spans"]) if r["spans"] else r["description_text"]}]

    return with_company(spans, "left").mapInArrow(_each(out, fourth), "job_posting_id long, stripped string")


def stripped_for(selected: DataFrame, corpus: DataFrame) -> DataFrame:
    """job_posting_id, description_text of the selected postings, stripped by what their whole company's texts share, where
    at least three of it are selected; else, or if nothing is left, as they were; '' if a posting has no text."""
    many = selected.join(corpus.select("job_posting_id", "company_id"), "job_posting_id").groupBy("company_id").count().where(F.col("count") >= LEAST_TEXTS).select("company_id")
    cleaned = strip_boilerplate(corpus.join(many, "company_id", "left_semi"))
    own = corpus.select("job_posting_id", "description_text")
    return selected.select("job_posting_id").join(own, "job_posting_id", "left").join(cleaned, "job_posting_id", "left").select("job_posting_id", F.coalesce(F.nullif("stripped", F.lit("")), "description_text", F.lit("")).alias("description_text"))
