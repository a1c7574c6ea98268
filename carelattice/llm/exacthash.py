"""Exact deduplication by an extendible-hash index on shared files, with DataFrame functions only.

A text's key is a 64-bit hash of its normalised form and its length.  Entries (key, doc_id, SHA-256) go to shared files
first.  The directory is grown from their distinct keys: a bucket is a range of hashes with common leading bits; while it
holds more than a bucket's capacity of keys it is split by one bit more, and the directory has as many bits as its
deepest bucket.  Ranges of whole buckets belong to owner tasks.  Texts go to the owner of their bucket, where those with
one key form its chain: Spark groups them by their bytes, so different texts under one key stay apart.  Owners write
the chains to shared files; entries then look up the text they are a copy of.

Texts with a large part of all rows are brought together before they move (partial aggregates), and their entries
find them in a broadcast table of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.llm import skew
from carelattice.session import cut_lineage

CAPACITY = 4096           # distinct keys in a bucket before it is split
SPARE_BITS = 3            # bits by which a directory may be deeper than evenly spread keys need
MAX_BITS = 20             # of the directory; a bucket that is still overfull then stays so (its chains get longer)
OWNER_BYTES = 32 << 20    # of normalised text for an owner task, about
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case, other letters as they are; null: empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def _keyed(docs: DataFrame, doc_id: str, text: str, key_bits: int) -> DataFrame:
    """doc_id, text (normalised), hash, size."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").bitwiseAND(F.lit(-1 << (64 - key_bits))).alias("hash"), F.octet_length("text").alias("size"))


def directory(keys: DataFrame, bits: int, capacity: int) -> DataFrame:
    """(slot, depth, prefix) for each slot in use of a directory of ``bits`` bits: the bucket of the hashes that begin so.

    ``keys``: distinct keys with their hash.  A bucket is the longest prefix whose parent is overfull.  All depths are
    counted at once, which gives what splitting one bucket after the other gives."""
    slot = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")
    cells = cut_lineage(keys.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")))
    levels = cells.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftrightunsigned(slot, {bits} - depth)"))
    nodes = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    full = nodes.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    split = nodes.withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(full, ["depth", "parent"], "left_semi")
    root = nodes.where("depth = 0").withColumn("parent", F.lit(0).cast("long"))
    leaves = root.unionByName(split).where((F.col("n") <= capacity) | (F.col("depth") == bits)).select("depth", "prefix")
    return levels.join(leaves, ["depth", "prefix"]).select("slot", "depth", "prefix")


def entries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key_bits: int = 64) -> DataFrame:
    """doc_id, hash, size, sha, row (any number, one for each row), written to shared files."""
    keyed = _keyed(docs, doc_id, text, key_bits)
    return cut_lineage(keyed.select("doc_id", "hash", "size", F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row")))


def chains(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", key_bits: int = 64, capacity: int = CAPACITY,
           hot: int | None = None) -> DataFrame:
    """hash, size, sha, group_size, keep_id: each different text once, from comparing bytes; written to shared files.

    ``found``: the entries of ``docs``.  Keys with more rows than ``hot`` are grouped before they move."""
    keys = cut_lineage(found.groupBy("hash", "size").agg(F.count("*").alias("n")))
    total = keys.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.sum(F.col("size").cast("long") * F.col("n")).alias("bytes"),
                     F.max("n").alias("most")).first()
    wanted = max(0, -(-(total["keys"] or 0) // capacity) - 1).bit_length() + SPARE_BITS
    bits = min(key_bits, MAX_BITS, wanted)
    limit = skew.hot_limit(total["rows"] or 0) if hot is None else hot
    buckets = F.broadcast(directory(keys, bits, capacity))  # 2 ** MAX_BITS rows at most
    owners = max(1, min(-(-(total["bytes"] or 0) // OWNER_BYTES), 1 << bits))
    texts = _keyed(docs, doc_id, text, key_bits)
    group = [F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")]
    known = ["hash", "size", F.sha2("text", 256).alias("sha"), "group_size", "keep_id"]
    cold, warm = texts, None
    if (total["most"] or 0) > limit:
        few = F.broadcast(keys.where(F.col("n") > limit).select("hash", "size"))  # fewer than skew.HOT keys
        cold, warm = texts.join(few, ["hash", "size"], "left_anti"), texts.join(few, ["hash", "size"], "left_semi")
    placed = cold.withColumn("slot", F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")).join(buckets, "slot")
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")  # the bucket's first slot: buckets are dealt out in order of their ranges
    owned = placed.withColumn("owner", F.floor(first * owners / F.lit(1 << bits)).cast("int")).repartitionById(owners, F.col("owner"))
    out = owned.groupBy("owner", "depth", "prefix", "hash", "size", "text").agg(*group).select(*known)
    if warm is not None:
        out = out.unionByName(warm.groupBy("hash", "size", "text").agg(*group).select(*known))
    return cut_lineage(out)


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key_bits: int = 64, capacity: int = CAPACITY, hot: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Null text is an empty one; empty texts are equal to each other; texts of any length are taken whole.  keep_id is the
    largest doc_id of the equal texts (null counts as the smallest; null only if all are).  Repeated rows: one of those
    with the largest doc_id is kept.  Empty table: no rows.  Other columns are not read, whatever their names."""
    found = entries(docs, doc_id, text, key_bits)
    texts = chains(docs, found, doc_id, text, key_bits, capacity, hot)
    rows = found.withColumn("rank", F.coalesce("doc_id", F.lit(-(1 << 63))))
    key = ["hash", "size", "sha"]
    top = rows.groupBy(*key).agg(F.max_by("row", "rank").alias("keep_row"))
    index = cut_lineage(texts.join(top, key))
    total = found.count()
    joined = skew.join_split(found, index.withColumn("n", F.col("group_size")), key, "n", skew.hot_limit(total) if hot is None else hot)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: one with the largest doc_id; all columns as they are."""
    held = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("long").alias("id"), F.sha2(normalised(F.col(text)), 256).alias("sha"))
    kept = copies(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    stay = held.join(kept, held.id.eqNullSafe(kept.id) & (held.sha == kept.sha)).select(held.id, held.sha, "doc")
    return stay.groupBy("id", "sha").agg(F.first("doc").alias("doc")).select("doc.*")


SQL = f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
"""
