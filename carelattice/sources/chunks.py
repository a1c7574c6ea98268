"""Chunking of source texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import js_trim, stable_id

# --- fixed values -----------------------------------------------------------
MAX_CHUNK, MIN_BREAK = 1200, 300
_BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200b)))
# --- end of fixed values ----------------------------------------------------

OUTPUT_CHARS = 4 << 20  # pieces of about so many characters leave a task together


def _cuts(text: str) -> list[tuple[int, int]]:
    """(start, end) of each piece: up to MAX_CHUNK characters, cut at the last paragraph break, else
    after the last sentence, if that leaves more than MIN_BREAK characters; else hard."""
    cuts, start, size = [], 0, len(text)
    while start < size:
        end = min(start + MAX_CHUNK, size)
        if end < size:
            low = start + MIN_BREAK + 1
            paragraph = text.rfind("\n\n", low, end + 2)
            sentence = text.rfind(". ", low, end + 2)
            end = paragraph if paragraph >= 0 else sentence + 1 if sentence >= 0 else end
        cuts.append((start, end))
        start = end
    return cuts


def chunk_documents(docs: DataFrame, id_col: str = "source_id", text: str = "raw_text") -> DataFrame:
    """(id, ordinal, start_offset, end_offset, text).  Offsets count characters of the trimmed text;
    blank pieces are skipped without using an ordinal."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for key, body in zip(pdf["id"], pdf["body"]):
                ordinal = 0
                for start, end in _cuts(body):
                    piece = body[start:end].strip(_BLANKS)
                    if piece:
                        rows.append((key, ordinal, start, end, piece))
                        ordinal += 1
                held += len(body)
                if held > OUTPUT_CHARS:  # bounds what a task holds, not what it reads
                    yield pd.DataFrame(rows, columns=["id", "ordinal", "start_offset", "end_offset", "text"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["id", "ordinal", "start_offset", "end_offset", "text"])

    body = docs.select(F.col(id_col).alias("id"), js_trim(F.col(text)).alias("body")).filter(F.col("body") != "")
    out = body.mapInPandas(run, f"id {id_type}, ordinal int, start_offset int, end_offset int, text string")
    return out.withColumnRenamed("id", id_col)


def with_chunk_id(chunks: DataFrame, id_col: str = "source_id") -> DataFrame:
    return chunks.withColumn("chunk_id", stable_id("chunk", F.concat_ws(
        ":", F.col(id_col).cast("string"), F.col("ordinal").cast("string"), F.col("start_offset").cast("string"),
        F.col("end_offset").cast("string"))))
