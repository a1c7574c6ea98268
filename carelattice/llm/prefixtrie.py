"""Prefix trie of conversations, by digests of fixed-length blocks of turns.

A turn is its SHA-256 bound to its place (two 64-bit hashes); a prefix is the exclusive or of its turns' hashes, so prefixes of
any length come from running sums and two prefixes are equal if their 128 bits are.  Conversations are cut into blocks of
BLOCK turns and grouped by (digest before the block, block): equal beginnings become one row per block, however many share them.
Where all that goes on from a block's start goes on alike, the turns within are a chain and its nodes are read off; only
where siblings diverge (several blocks, or a shorter one, after one start) turns are grouped one by one.

Sums over subtrees double their reach: after r rounds a node has the sum of all below it by less than 2**r levels and knows its
ancestor 2**r levels up.  No step holds all turns of a conversation, children of a node or members of a group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelattice.llm.skew import hot_limit, join_split
from carelattice.session import cut_lineage

BLOCK = 4        # turns in a block
STRETCH = 256    # blocks of a conversation that are summed up by one task
CHUNK = 8192     # ids in one piece of a list that is hashed
NODE = ["a", "b"]


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), digest, bytes (of the text in UTF-8), written to shared files.

    Turns go in order of ``turn``, null first; equal ones by role, then by the digest of role and text.  Null role or text
    is empty.  Rows without a conversation are left out.  Repeated rows are turns like any other.  The order comes from
    ranges of (conversation, turn), so a conversation of any length is spread over tasks."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what), 256)).alias("digest"),
        F.octet_length(what).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")).where("conv is not null")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    dealt = cut_lineage(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            begins = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.repeat(begins, np.diff(np.append(begins, len(conv))))
            if conv[0] == last:
                at[:begins[1] if len(begins) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), part)), pa.array(at + 1)], names=["conv", "digest", "bytes", "part", "at"])

    placed = cut_lineage(dealt.mapInArrow(run, "conv long, digest binary, bytes long, part long, at long"))
    pieces = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.broadcast(pieces.withColumn("before", before).where("before > 0").drop("n"))  # one a task at most: only a range's first conversation began earlier
    return placed.join(later, ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def lengths(told: DataFrame) -> DataFrame:
    """conv, n: the number of its turns."""
    return told.groupBy("conv").agg(F.count("*").alias("n"))


def spliced(told: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first ``head`` turns of conversation ``base`` (both made from the column conv), then the own ones
    after the first ``head``.  ((conv, pos, digest, bytes, n), (conv, n: turns of the rebuilt one, maybe none)).  ``head`` is ``most`` at most."""
    told = cut_lineage(told)
    own = cut_lineage(lengths(told).select("conv", "n", base.alias("base"), head.cast("long").alias("head")))
    bases = own.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    cut = own.join(bases, "base", "left").withColumn("used", F.least("head", F.coalesce("n_base", F.lit(0))))
    cut = cut_lineage(cut.select("conv", "base", "head", "used", "n", (F.col("used") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n_new")))
    first = told.where(F.col("pos") <= most).withColumnRenamed("conv", "base")
    taken = cut.join(first, "base").where("pos <= head").select("conv", "pos", "digest", "bytes", F.col("n_new").alias("n"))
    total = told.count()
    rest = join_split(told, cut.select("conv", "head", "used", "n_new", "n"), ["conv"], "n", hot_limit(total)).where("pos > head")
    rest = rest.select("conv", (F.col("pos") - F.col("head") + F.col("used")).alias("pos"), "digest", "bytes", F.col("n_new").alias("n"))
    return taken.unionByName(rest), cut.select("conv", F.col("n_new").alias("n"))


def blocks(told: DataFrame) -> DataFrame:
    """conv, block, a, b (digest before the block), turns: array<struct<x, y, bytes>>, last: whether it is the conversation's last.

    ``told``: conv, pos, digest, bytes, n.  The digest before a block sums up the conversation's blocks before it: first within a stretch of
    STRETCH blocks, then the stretches before."""
    hashed = told.select("conv", "n", F.floor((F.col("pos") - 1) / BLOCK).alias("block"), F.struct(
        "pos", F.xxhash64("pos", "digest").alias("x"), F.xxhash64(F.lit(1), "digest", "pos").alias("y"), "bytes").alias("turn"))
    hashed = hashed.withColumn("stretch", F.floor(F.col("block") / STRETCH)).repartition("conv", "stretch")
    grouped = hashed.groupBy("conv", "stretch", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = lambda c: F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(t[c]))
    before = lambda c, w: F.coalesce(F.bit_xor(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    within = Window.partitionBy("conv", "stretch").orderBy("block")
    summed = grouped.withColumns({"p": whole("x"), "q": whole("y")})
    known = cut_lineage(summed.select("conv", "stretch", "block", "p", "q", before("p", within).alias("a"), before("q", within).alias("b"), F.col("block") * BLOCK + BLOCK >= F.col("n"),
                                      F.transform("turns", lambda t: F.struct(t.x.alias("x"), t.y.alias("y"), t.bytes.alias("bytes"))).alias("turns"))
                        .toDF("conv", "stretch", "block", "p", "q", "a", "b", "last", "turns"))
    long = known.where("stretch > 0").select("conv").distinct()
    stretches = known.join(long, "conv", "left_semi").groupBy("conv", "stretch").agg(F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"))
    over = Window.partitionBy("conv").orderBy("stretch")
    earlier = stretches.select("conv", "stretch", before("p", over).alias("ea"), before("q", over).alias("eb")).where("stretch > 0")
    zero = F.lit(0).cast("long")
    return known.join(earlier, ["conv", "stretch"], "left").select(
        "conv", "block", F.col("a").bitwiseXOR(F.coalesce("ea", zero)).alias("a"), F.col("b").bitwiseXOR(F.coalesce("eb", zero)).alias("b"), "turns", "last")


def _upto(start: str, lane: str, i: Column) -> Column:
    return F.aggregate(F.slice("turns", F.lit(1), i), F.col(start), lambda s, t: s.bitwiseXOR(t[lane]))


def nodes(parts: DataFrame) -> DataFrame:
    """depth, a, b, pa, pb (the parent), bytes, n_convs, conv_id of all nodes but the root.  ``parts``: blocks(), a written table."""
    key = ["block", "a", "b"]
    distinct = cut_lineage(parts.groupBy(*key, "turns").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")))
    starts = cut_lineage(distinct.groupBy(*key).agg(F.count("*").alias("ways")))
    total = distinct.count()
    met = join_split(distinct, starts.withColumn("rows", F.col("ways")), key, "rows", hot_limit(total))
    inner = met.select("ways", "block", "n_convs", "conv_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("turns")), lambda i: F.struct(
        i.alias("i"), _upto("a", "x", i).alias("a"), _upto("b", "y", i).alias("b"), _upto("a", "x", i - 1).alias("pa"), _upto("b", "y", i - 1).alias("pb"),
        F.element_at("turns", i).bytes.alias("bytes")))).alias("t"))
    every = inner.select("ways", (F.col("block") * BLOCK + F.col("t.i")).alias("depth"), *(f"t.{c}" for c in ("a", "b", "pa", "pb", "bytes")), "n_convs", "conv_id")
    chain = every.where("ways = 1").drop("ways")
    refined = every.where("ways > 1").groupBy("depth", "a", "b", "pa", "pb", "bytes").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return chain.unionByName(refined)


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """a, b and each of ``values`` (long) summed over the node and all below it.  ``tree``: depth, a, b, pa, pb, written; the root has depth 0."""
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    state = tree.select("depth", *NODE, F.col("pa").alias("ja"), F.col("pb").alias("jb"), *values)
    reach = 1
    while reach <= deepest:  # ja, jb: the ancestor ``reach`` levels up, for nodes that are deep enough
        far = state.where(F.col("depth") >= reach)
        added = cut_lineage(far.groupBy(F.col("ja").alias("a"), F.col("jb").alias("b")).agg(F.count("*").alias("rows"), *(F.sum(v).alias(f"more_{v}") for v in values)))
        more = state.join(added, NODE, "left").select("depth", *NODE, "ja", "jb", *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values))
        if 2 * reach <= deepest:
            more = cut_lineage(more)
            deep = more.where(F.col("depth") >= 2 * reach)
            via = cut_lineage(more.join(added.select(*NODE, "rows"), NODE).where(F.col("depth") >= reach).select(
                F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("ja").alias("ka"), F.col("jb").alias("kb"), "rows"))
            hops = join_split(deep, via, ["ja", "jb"], "rows", hot_limit(tree.count())).select(
                "depth", *NODE, F.col("ka").alias("ja"), F.col("kb").alias("jb"), *values)
            more = hops.unionByName(more.where(F.col("depth") < 2 * reach))
        state = cut_lineage(more)
        reach *= 2
    return state.select(*NODE, *values)


def list_hashes(ids: DataFrame) -> DataFrame:
    """a, b, sha: SHA-256 (lowercase hex) of the node's ids in decimals, ascending, comma-joined.  ``ids``: a, b, conv.

    Ranges of (node, id) make pieces of text first, so that what hashes a long list in order reads few rows and keeps none."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (c.to_numpy() for c in batch.columns)
            if not len(conv):
                continue
            cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            sizes = np.diff(np.append(cut, len(a)))
            at = np.concatenate([np.arange(lo, lo + n, CHUNK) for lo, n in zip(cut, sizes)]) if sizes.max() > CHUNK else cut
            names, ends = conv.astype(str), np.append(at, len(a))
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(conv[at]), pa.array([",".join(names[lo:hi]) for lo, hi in zip(ends, ends[1:])])],
                                             names=["a", "b", "first", "names"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for a, b, names in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if last != (a, b):
                    if state:
                        done.append((*last, state.hexdigest()))
                    last, state = (a, b), hashlib.sha256(names.encode())
                else:
                    state.update(b"," + names.encode())
            yield _hashes(done)
        if state:
            yield _hashes([(*last, state.hexdigest())])

    ranged = ids.select("a", "b", "conv").repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    text = ranged.mapInArrow(pieces, "a long, b long, first long, names string")
    return text.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a long, b long, sha string")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.string())], names=["a", "b", "sha"])


def trie(told: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    ``told``: conv, pos, digest, bytes, n; ``members``: conv, n of all conversations, those without turns too.  A node is a distinct sequence
    of first turns; the root has none.  No conversations: no rows, not even a root."""
    parts = cut_lineage(blocks(told))
    zero = F.lit(0).cast("long")
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("bytes"), "n_convs", "conv_id")
    found = cut_lineage(nodes(parts).unionByName(root))
    children = found.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    tree = cut_lineage(found.join(children, NODE, "left").select(
        *found.columns, F.coalesce("n_children", zero).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
    sums = subtree_sums(tree, ["leaves", "saved"]).toDF(*NODE, "n_leaves", "saved_tokens")
    ended = parts.where("last").select("conv", _upto("a", "x", F.size("turns")).alias("a"), _upto("b", "y", F.size("turns")).alias("b"))
    ended = ended.unionByName(members.where("n = 0").select("conv", zero.alias("a"), zero.alias("b")))
    ends = cut_lineage(list_hashes(cut_lineage(ended)))
    above = tree.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = tree.where("depth > 0").drop("n_children")
    linked = join_split(below, above.withColumnRenamed("n_children", "rows"), ["pa", "pb"], "rows", hot_limit(tree.count())).select(*NODE, "parent_conv_id")
    out = tree.join(sums, NODE).join(ends, NODE, "left").join(linked, NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


SQL = """
WITH own AS (
  SELECT conv_id AS c, count(*) OVER (PARTITION BY conv_id) AS n, octet_length(encode(coalesce(text, ''))) AS bytes,
         sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, n, c - c % 5 AS base, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)), lambda crc, byte:
           list_reduce([xor(crc, byte)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS head
  FROM (SELECT DISTINCT c, n FROM own)),
cut AS (SELECT k.*, least(k.head, coalesce(b.n, 0)) AS used FROM convs k LEFT JOIN convs b ON k.base = b.c),
told AS (
  SELECT k.c, o.pos, o.digest, o.bytes FROM cut k JOIN own o ON o.c = k.base AND o.pos <= k.head
  UNION ALL SELECT k.c, o.pos - k.head + k.used, o.digest, o.bytes FROM cut k JOIN own o ON o.c = k.c AND o.pos > k.head),
seqs AS (
  SELECT k.c, coalesce(list(t.digest ORDER BY t.pos) FILTER (WHERE t.pos IS NOT NULL), []) AS s,
         coalesce(list(t.bytes ORDER BY t.pos) FILTER (WHERE t.pos IS NOT NULL), []) AS sizes
  FROM cut k LEFT JOIN told t ON k.c = t.c GROUP BY k.c),
passed AS (
  SELECT c, d, array_to_string(s[1:d], ',') AS node, array_to_string(s[1:d - 1], ',') AS parent, len(s) = d AS ends, coalesce(sizes[d], 0) AS bytes
  FROM seqs, unnest(range(len(s) + 1)) r(d)),
nodes AS (
  SELECT d, node, CASE WHEN d > 0 THEN parent END AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM passed GROUP BY ALL),
kids AS (SELECT parent, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY parent),
sums AS (
  SELECT array_to_string(string_split(v.node, ',')[1:e], ',') AS node, count(*) FILTER (WHERE k.parent IS NULL) AS n_leaves,
         CAST(sum((v.n_convs - 1) * v.bytes) AS BIGINT) AS saved_tokens
  FROM nodes v LEFT JOIN kids k ON v.node = k.parent, unnest(range(v.d + 1)) r(e) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM nodes v JOIN sums s ON v.node = s.node LEFT JOIN kids k ON v.node = k.parent LEFT JOIN nodes p ON v.parent = p.node
"""
