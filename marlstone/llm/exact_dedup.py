"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each input partition hashes its normalised texts, cuts 48-bit fingerprints from the SHA-256 digests and writes, for
   each owner (a range of fingerprints), its distinct fingerprints sorted and Golomb-Rice coded.
2. Each owner decodes what all partitions sent and answers with a bitmap per partition: which fingerprints it saw twice.
3. Only rows that a bitmap marks (suspects) send their text; grouping by the text itself is the byte verification.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, discard, each_batch, fresh, narrow_to, stash

FINGERPRINT_BITS = 48
#: Rows of one message: the least and the most (about 300 MB of a task), between them so many that each of the owners gets
#: A_MESSAGE fingerprints. The messages are then at most a row for A_MESSAGE rows of input, up to 60e9 rows; only beyond
#: do they grow with the square.
CHUNK_ROWS, MOST_CHUNK_ROWS, A_MESSAGE = 100_000, 2_000_000, 64
#: Fingerprints of one owner: what its task holds at once, about 50 MB.
OWNER_ROWS = 2_000_000
LEDGER = "part string, owner int, n int, rice int, quotients binary, remainders binary, twice binary, ranks binary, ids binary, no_id binary, digests binary"


def rice_encode(sorted_values: np.ndarray, universe: int) -> tuple[int, bytes, bytes]:
    """(k, unary quotients, k-bit remainders) of the gaps of a sorted, distinct, non-empty uint64 array."""
    gaps = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(universe // len(gaps)).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    stops = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    bits = np.zeros((len(gaps), k), np.uint8)
    for i in range(k):  # a byte for each bit at most, never a word
        bits[:, i] = (gaps >> np.uint64(k - 1 - i)) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, remainders: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(stops, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * k].reshape(n, k)
    low = np.zeros(n, np.uint64)
    for i in range(k):
        low = (low << np.uint64(1)) | bits[:, i]
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def _base(owner: int, owners: int) -> int:
    """Where an owner's range of fingerprints begins."""
    return (owner << FINGERPRINT_BITS) // owners


def _flush(part: str, owners: int, universe: int, ids: list, digests: list[bytes]) -> pa.RecordBatch:
    digest = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
    prints = np.zeros(len(ids), np.uint64)
    for i in range(FINGERPRINT_BITS // 8):
        prints = (prints << np.uint64(8)) | digest[:, i].astype(np.uint64)
    missing = np.array([x is None for x in ids])
    keys = np.array([0 if x is None else x for x in ids], np.int64)
    order = np.argsort(prints, kind="stable")
    prints, digest, missing, keys = prints[order], digest[order], missing[order], keys[order]
    owner = (prints * np.uint64(owners)) >> np.uint64(FINGERPRINT_BITS)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    rows = []
    for a, b in zip([0, *cuts], [*cuts, len(owner)], strict=True):
        distinct, rank, count = np.unique(prints[a:b], return_inverse=True, return_counts=True)
        k, unary, low = rice_encode(distinct - np.uint64(_base(int(owner[a]), owners)), universe // owners)
        rows.append((part, int(owner[a]), len(distinct), k, unary, low, np.packbits(count > 1).tobytes(), rank.astype(np.int32).tobytes(), keys[a:b].tobytes(), np.packbits(missing[a:b]).tobytes(), digest[a:b].tobytes()))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in LEDGER.split(", ")])


def chunk_rows(owners: int) -> int:
    return min(MOST_CHUNK_ROWS, max(CHUNK_ROWS, A_MESSAGE * owners))


def _send(owners: int):
    universe, chunk = 1 << FINGERPRINT_BITS, chunk_rows(owners)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, ids, digests = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(key)
                digests.append(hashlib.sha256((text.as_py() or "").encode().lower()).digest())
                if len(ids) >= chunk:
                    yield _flush(f"{part}-{seq}", owners, universe, ids, digests)
                    seq, ids, digests = seq + 1, [], []
        if ids:
            yield _flush(f"{part}-{seq}", owners, universe, ids, digests)

    return run


def _answer(codes: pa.Table) -> pa.Table:
    """One owner: a bitmap for each sender, over that sender's fingerprints (less the owner's base) in order."""
    rows = codes.to_pylist()
    sent = [rice_decode(r["n"], r["rice"], r["quotients"], r["remainders"]) for r in rows]
    seen, count = np.unique(np.concatenate(sent), return_counts=True)
    twice = seen[count > 1]
    maps = [np.packbits(np.isin(x, twice)).tobytes() for x in sent]
    return pa.table({"part": [r["part"] for r in rows], "owner": pa.array([r["owner"] for r in rows], pa.int32()), "bitmap": maps})


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ranks, ids = np.frombuffer(r["ranks"], np.int32), np.frombuffer(r["ids"], np.int64)
            marks = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8) | np.frombuffer(r["twice"], np.uint8))[: r["n"]].astype(bool)
            missing = np.unpackbits(np.frombuffer(r["no_id"], np.uint8))[: len(ids)].astype(bool)
            text = r["digests"].hex()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=missing), pa.array([text[i : i + 64] for i in range(0, len(text), 64)], pa.string()), pa.array(marks[ranks])], ["doc_id", "text_sha256", "suspect"])


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text; the row with the largest id
    stays. A null id is the smallest, and keep_id is null where all ids of a group are. Rows that repeat an id with the
    same text count each in group_size and share one answer. An empty table gives an empty result. Other columns are
    not read, so their names can't clash.

    ``owners``: number of fingerprint ranges; default: as many as keep each within OWNER_ROWS rows, and at least the
    session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    rows, least = docs.count(), max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    owners = owners or max(least, -(-rows // OWNER_ROWS))
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    # a table in very many small partitions would send messages of a few fingerprints each
    senders = docs.coalesce(max(least, -(-rows // chunk_rows(owners))))
    ledger = stash(each_batch(senders, ["doc_id", "text"], LEDGER, _send(owners)), "fingerprints")
    bitmaps = ledger.select("part", "owner", "n", "rice", "quotients", "remainders").groupBy("owner").applyInArrow(_answer, "part string, owner int, bitmap binary")
    rows = stash(ledger.select("part", "owner", "n", "twice", "ranks", "ids", "no_id", "digests").join(bitmaps, ["part", "owner"]).mapInArrow(_unpack, "doc_id long, text_sha256 string, suspect boolean"), "suspects")
    discard(ledger)
    suspects = rows.where("suspect").select("doc_id", "text_sha256")
    n = suspects.count()
    texts = narrow_to(docs, suspects.select("doc_id").distinct(), n).select("doc_id", ascii_lower("text").alias("_text"))
    # a hot group of copies collapses here before the shuffle: one row for each text and task
    groups = stash(texts.groupBy("_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select(F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    # at most 1000 groups can hold over a thousandth of the suspects: those are broadcast, the rest has no hot key
    hot = groups.where(F.col("group_size") > max(1000, n // 1000))
    cold = groups.where(F.col("group_size") <= max(1000, n // 1000))
    by_hot = suspects.join(F.broadcast(hot), "text_sha256", "left")
    answered = by_hot.where("group_size is not null").select("doc_id", "keep_id", "group_size", "text_sha256")
    other = by_hot.where("group_size is null").select("doc_id", "text_sha256").join(cold, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    alone = rows.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    return alone.unionByName(answered).unionByName(other).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    A row goes by its id and its text, so of a repeated id only the rows whose text is kept elsewhere go. Rows that repeat
    both id and text share one answer. A null text counts as empty; a row without an id goes if any row with one has its
    text, and stays otherwise. An empty table gives an empty result.
    """
    dropped = stash(exact_groups(docs, id_column, text_column).where("not kept").select("doc_id", "text_sha256").distinct(), "dropped")
    n = dropped.count()
    gone, sha = fresh(docs, "gone_id", "gone_text")
    dropped = dropped.select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(sha))
    same = F.col(id_column).cast("long").eqNullSafe(F.col(gone)) & (F.sha2(ascii_lower(text_column).cast("binary"), 256) == F.col(sha))
    return docs.join(F.broadcast(dropped) if n <= BROADCAST_ROWS // 4 else dropped, same, "left_anti")


ORACLE = """
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from (
  select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, sha256(t) as text_sha256
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
  window g as (partition by t))
"""
