"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit.  Documents longer than the capacity are cut; every piece then is a document of
at most ``capacity`` tokens.  Spark ranks the pieces within their length (the range sort: length, then a
number that needs no single task for a frequent length).  Pieces of one length are interchangeable, and so are
sequences with the same free space: both sides of the matching are *runs*, a length with consecutive ranks and a
gap with consecutive sequence numbers.  A superstep sweeps documents and gaps in order of size at once; every gap
is taken by the longest unplaced document that fits, so a document gets its successor among the gaps; of several
claims on a gap the one of the next rank wins and the rest stay for the next superstep; the gaps shrink; repeat.
When no document fits any gap, as many sequences as the rest needs at least are opened by its longest documents.

The number of runs follows the capacity, not the corpus (at most one split for every pair of sizes a sweep
meets), so only the histogram of lengths, at most ``capacity`` rows, is swept on the driver.  All work that grows with
the corpus is done by Spark: tokenising, the histogram, the ranks, and placing each piece by its length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from carelattice.llm.tokens import BYTE_BPE, encoder
from carelattice.session import cut_lineage

CAPACITY = 2048
SALTS = 512  # parts in which the pieces of one length are ranked
PLAN = "length long, rank_from long, rank_to long, first_sequence long, offset long"


def pieces(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (bytes).

    A document is the ids of its whole text (null counts as empty) and ``end_id``; so an empty text has one id.  Longer
    ones than ``capacity`` are cut; every piece but the first is full.  Other columns are not read.  Repeated
    rows are packed as often as they come."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            held = 0
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1))):
                ids = memoryview(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    part = ids[4 * at:4 * (at + capacity if k else first)]
                    for col, x in zip(rows, (key, k, at, len(part) // 4, zlib.crc32(part), bytes(part) if with_ids else None)):
                        col.append(x)
                    held += len(part)
                if held > 32 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                    rows, held = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
        enc.chunks.trim()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, first_sequence, offset): pieces of the length with these ranks go to sequences
    first_sequence, first_sequence + 1, ... at the offset.  Bulk-synchronous; see the module's text."""
    out: list[tuple[int, int, int, int, int]] = []
    left = {n: [0, c] for n, c in histogram.items() if c}  # length: next rank, end
    gaps: dict[int, list[tuple[int, int]]] = {}            # free space: runs of sequences
    sequences = 0

    def open_with(length: int, count: int) -> None:
        nonlocal sequences
        lo = left[length][0]
        out.append((length, lo, lo + count, sequences, 0))
        if length < capacity:
            gaps.setdefault(capacity - length, []).append((sequences, sequences + count))
        sequences += count
        left[length][0] += count
        if left[length][0] == left[length][1]:
            del left[length]

    for length in sorted(left, reverse=True):  # no two of these share a sequence
        if 2 * length > capacity:
            open_with(length, left[length][1])
    while left:
        matched = False
        shrunk: dict[int, list[tuple[int, int]]] = {}
        waiting: list[int] = []  # lengths not above the gap in hand, the longest last
        for size in sorted({*left, *gaps}):
            if size in left:
                waiting.append(size)
            for lo, hi in gaps.get(size, []):
                while lo < hi and waiting:
                    length = waiting[-1]
                    rank, end = left[length]
                    m = min(hi - lo, end - rank)
                    out.append((length, rank, rank + m, lo, capacity - size))
                    matched = True
                    if size > length:
                        shrunk.setdefault(size - length, []).append((lo, lo + m))
                    lo += m
                    left[length][0] += m
                    if left[length][0] == end:
                        waiting.pop()
                if lo < hi:
                    shrunk.setdefault(size, []).append((lo, hi))
        left = {n: r for n, r in left.items() if r[0] < r[1]}
        gaps = {size: _joined(runs) for size, runs in shrunk.items()}
        if not matched and left:
            need = -(-sum(n * (r[1] - r[0]) for n, r in left.items()) // capacity)
            for length in sorted(left, reverse=True):
                if need <= 0:
                    break
                count = min(need, left[length][1] - left[length][0])
                open_with(length, count)
                need -= count
    return out


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    done: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if done and done[-1][1] == lo:
            done[-1] = (done[-1][0], hi)
        else:
            done.append((lo, hi))
    return done


def pack(items: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` (a column ``length``, 1 to ``capacity``) with sequence_id and offset: in each sequence the places
    from 0 on are taken without gaps.  ``items`` is read twice, so it should be a stored table."""
    spark = items.sparkSession
    salted = items.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts)  # at most capacity * SALTS rows
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    runs = spark.createDataFrame(plan(histogram, capacity), PLAN)
    by_length = Window.partitionBy("length").orderBy("salt")
    ranges = counts.withColumn("before", F.sum("n").over(by_length) - F.col("n"))
    ranges = (ranges.join(runs, "length").where((F.col("rank_from") < F.col("before") + F.col("n")) & (F.col("rank_to") > F.col("before")))
              .groupBy("length", "salt").agg(F.first("before").alias("before"), F.collect_list(
                  F.struct("rank_from", "rank_to", "first_sequence", "offset")).alias("runs")))
    placed = (salted.join(ranges, ["length", "salt"])
              .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy(*key)) - 1)
              .withColumn("run", F.filter("runs", lambda r: (r.rank_from <= F.col("rank")) & (F.col("rank") < r.rank_to))[0]))
    return placed.select(*items.columns, (F.col("run.first_sequence") + F.col("rank") - F.col("run.rank_from")).alias("sequence_id"),
                         F.col("run.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (bytes of the whole sequence), parts (doc_id, piece, offset, length): for pieces made with_ids.
    A group is one sequence, so it is bounded by the capacity."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    out = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    return out.select("sequence_id", F.aggregate("rows", F.lit(b"").cast(T.BinaryType()), lambda a, r: F.concat(a, r.ids)).alias("ids"),
                      F.transform("rows", lambda r: F.struct(r.doc_id, r.piece, r.offset, r.length)).alias("parts"))


def pack_documents(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """pieces() and pack() in one: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.
    Empty table: no rows.  A null doc_id is packed like any other."""
    return pack(cut_lineage(pieces(docs, tokenizer, capacity, end_id, with_ids=with_ids)), capacity)
