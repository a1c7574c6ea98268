"""Token ids in Simple-8b words, written to files in document order and read back.

A word has 64 bits: 4 for the selector, 60 for as many ids as the selector packs.  Greedy: each word takes the selector
with the most ids that fit.  Ids of more than 60 bits escape to a word of their own.  A *segment* (one row of the files)
holds whole documents, about SEGMENT_IDS ids; it is cut into blocks of BLOCK ids, each beginning with a new word at a
noted offset, so blocks are encoded side by side and can be decoded alone.  Decoding needs no loop over words.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelattice.llm.tokens import BYTE_BPE, encoder
from carelattice.session import ensure_checkpoint_dir

# Fixed values of the format: ids per word and bits per id, by selector.  Selector 0 is the escape: the next
# word is one id of 64 bits.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
SEGMENT_IDS = 1 << 18

SEGMENTS = ("task int, segment int, ids_before long, n_ids long, doc_ids array<long>, doc_tokens array<long>, "
            "block_words array<int>, words binary")


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if int(ids.max(initial=0)) < 1 << 24:
        return np.frexp(ids.astype(np.float32))[1].astype(np.uint8)
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, index of each block's first word) of unsigned ids.  No ids: no words, no blocks."""
    ids = np.asarray(ids, dtype=np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    width = BLOCK + int(COUNTS.max())  # what stands beyond a block's end is 0 and fits anywhere
    values = np.zeros((blocks, BLOCK), np.uint64)
    values.ravel()[:n] = ids
    values = np.pad(values, ((0, 0), (0, width - BLOCK))).ravel()

    spans = {1: bit_lengths(values)}  # the most bits among so many ids from here on
    for k in (2, 4, 8, 16, 32, 64):
        spans[k] = _span(spans[k // 2], k // 2)
    selector = np.zeros(len(values), np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        k = 1 << (int(COUNTS[s]).bit_length() - 1)
        selector[_span(spans[k], int(COUNTS[s]) - k) <= BITS[s]] = s

    at = np.arange(blocks) * width
    stop = at + np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    found, live = [], np.arange(blocks)
    while len(live):  # one word of every block at a time
        found.append(at[live])
        at[live] += COUNTS[selector[at[live]]]
        live = live[at[live] < stop[live]]
    starts = np.sort(np.concatenate(found))
    chosen = selector[starts]
    place = np.arange(len(starts)) + np.cumsum(chosen == 0) - (chosen == 0)
    words = np.zeros(len(starts) + int((chosen == 0).sum()), np.uint64)
    for s in np.unique(chosen):
        which = np.flatnonzero(chosen == s)
        if s == 0:
            words[place[which] + 1] = values[starts[which]]
            continue
        word = np.full(len(which), int(s) << 60, np.uint64)
        if BITS[s]:
            for k in range(COUNTS[s]):
                word |= values[starts[which] + k] << np.uint64(k * BITS[s])
        words[place[which]] = word
    return words, place[np.searchsorted(starts, np.arange(blocks) * width)]


def _span(most: np.ndarray, step: int) -> np.ndarray:
    if not step:
        return most
    out = most.copy()
    np.maximum(most[:-step], most[step:], out=out[:-step])
    return out


def decode(words: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of what encode() gave."""
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for e in np.flatnonzero(selector == 0).tolist():  # the word after an escape may itself look like one
        if not raw[e]:
            raw[e + 1] = True
    kept = np.flatnonzero(~raw)
    selector = selector[kept]
    ends = np.cumsum(COUNTS[selector])
    first = np.searchsorted(kept, np.asarray(block_words, dtype=np.int64))
    of_block = np.searchsorted(first, np.arange(len(kept)), side="right") - 1
    starts = ends - COUNTS[selector]
    starts += (np.arange(len(first)) * BLOCK - starts[first])[of_block] if len(first) else 0
    stop = np.minimum((of_block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector):
        which = np.flatnonzero(selector == s)
        if s == 0:
            out[starts[which]] = words[kept[which] + 1]
        elif BITS[s]:
            body, mask = words[kept[which]], np.uint64((1 << int(BITS[s])) - 1)
            for k in range(COUNTS[s]):
                inside = starts[which] + k < stop[which]
                out[starts[which][inside] + k] = (body[inside] >> np.uint64(k * BITS[s])) & mask
    return out


def write(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes the whole texts (null counts as empty), each with ``end_id`` after it, and writes segments in
    ascending order of doc_id (nulls first; rows of one doc_id by text): task, then segment, then place.
    Repeated rows are written as often as they come; other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        keys, parts, held, before, segment = [], [], 0, 0, 0

        def full() -> pa.RecordBatch:
            words, first = encode(np.concatenate(parts))
            row = ([task], [segment], [before], [held], [keys], [[len(p) for p in parts]], [first.tolist()], [words.astype("<u8").tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1))):
                keys.append(key)
                parts.append(np.append(ids, np.uint32(end_id)))
                held += len(parts[-1])
                if held >= SEGMENT_IDS:
                    yield full()
                    before, segment = before + held, segment + 1
                    keys, parts, held = [], [], 0
        if parts:
            yield full()

    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all before it), n_tokens, ids_crc32[, ids (bytes)], decoded from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(np.frombuffer(row["words"], "<u8"), row["block_words"], row["n_ids"]).astype("<u4").tobytes()
                sizes = np.array(row["doc_tokens"], dtype=np.int64)
                ends = np.cumsum(sizes)
                parts = [ids[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = [pa.array([row["task"]] * len(parts), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                           pa.array(row["ids_before"] + ends - sizes), pa.array(sizes), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, names=names)

    names = ["task", "doc_id", "local_start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    segments = spark.read.schema(SEGMENTS).parquet(path)
    docs = segments.drop("segment").mapInArrow(run, "task int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
                                                              + ", ids binary" * with_ids)
    tasks = segments.groupBy("task").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    return docs.join(tasks, "task").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32",
                                           *(["ids"] * with_ids))


def fresh_path(spark: SparkSession) -> str:
    """A new folder's name in the shared place."""
    return f"{ensure_checkpoint_dir(spark)}/simple8b/{uuid.uuid4().hex}"
