"""SimHash fingerprints of word shingles, and their classes under a small number of differing bits.

Fingerprints that differ in at most ``max_bits`` bits agree on one of ``max_bits + 1`` blocks of bits, so they meet under
that block's value.  What meets there is searched with a Gray-order hierarchical index: sorted by Gray rank, neighbours
share most bits; a node keeps the bits all below it share (mask and pattern), a parent the bits its children share, so
going down only the newly shared bits are compared, the differences add up, and a node beyond the limit is pruned with
all below it.  The index of a block's value holds at most NODE fingerprints.  Values that more distinct fingerprints
share (a crowd of near copies) are not searched but linked by an exact rule: every fingerprint of the crowd, with each
set of at most ``max_bits / 2`` bits flipped, is a key; two fingerprints share a key just if they are near enough.  The
number of keys follows the number of fingerprints, and the smallest fingerprint of a key links them all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelattice.llm.skew import hot_limit, join_split
from carelattice.operators.components import connected_components
from carelattice.session import cut_lineage

SEED = 42
NODE = 512        # distinct fingerprints in one index
FANOUT = 16       # children of a node of the index
FEW_KEYS = 1 << 21  # at most so many 64-bit keys are broadcast
SAMPLE = 4096     # nodes, about, that show which shingles of crowds are common
PAIRS = 4         # pairs that may meet for each prefix key stored before crowded keys are put last
COMMON = 64       # nodes whose pairs are as many as may meet under a shingle before it is put last in the order of shingles
STEP_BYTES = 1 << 20


def _word_steps(data: bytes) -> Iterator[list[bytes]]:
    """The words, about STEP_BYTES of text at a time."""
    at = 0
    while len(data) - at > STEP_BYTES:
        cut = at + STEP_BYTES
        while cut < len(data) and data[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


def _hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles in order, repeats included, as big-endian arrays; nothing if it has no words."""
    import xxhash

    none, held = True, []
    for some in _word_steps((text or "").encode().lower()):  # bytes.lower and bytes.split know ASCII only
        held += some
        m = len(held) - words + 1
        if m > 0:
            shingles = map(b" ".join, zip(*(held[k:] for k in range(words))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), ">u8", m)
            none, held = False, held[m:]
    if none and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], ">u8")


def _majority(hashes: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for some in hashes:
        for at in range(0, len(some), 1 << 16):
            part = some[at:at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(some)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _distinct(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]).astype(np.uint64))


def fingerprint(text: str | None, words: int) -> int:
    """See fingerprints()."""
    return _majority(_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (long, the 64 bits).

    Lower-cases A-Z, splits at ASCII white space, and hashes shingles of so many words, repeats included (fewer words:
    the whole sequence), with XXH64; a bit is set if it is in over half of the hashes.  No words, or null: 0.
    One row per row of ``docs``; other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the sequence where neighbours differ in one bit."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def near_pairs(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of all fingerprints at most ``max_bits`` apart; ``prints`` in Gray order."""
    levels = []  # from the leaves up: (mask, pattern) of FANOUT members of the level below
    shared, pattern = np.full(len(prints), ~np.uint64(0)), prints
    while len(pattern) > 1:
        cuts = np.arange(0, len(pattern), FANOUT)
        ones, some = np.bitwise_and.reduceat(pattern, cuts), np.bitwise_or.reduceat(pattern, cuts)
        shared = np.bitwise_and.reduceat(shared, cuts) & ~(ones ^ some)
        pattern = ones & shared
        levels.append((shared, pattern))
    query = np.arange(len(prints))
    node, far = np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64)
    mask = np.zeros(len(prints), np.uint64)
    for level in range(len(levels) - 1, -1, -1):
        shared, pattern = levels[level]
        far = far + np.bitwise_count((prints[query] ^ pattern[node]) & shared[node] & ~mask)
        keep = far <= max_bits
        query, node, far, mask = query[keep], node[keep], far[keep], shared[node[keep]]
        below = len(levels[level - 1][0]) if level else len(prints)
        child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        query, far, mask = (np.repeat(x, FANOUT) for x in (query, far, mask))
        keep = child < below
        query, node, far, mask = query[keep], child[keep], far[keep], mask[keep]
    near = (query < node) & (far + np.bitwise_count((prints[query] ^ prints[node]) & ~mask) <= max_bits)
    return query[near], node[near]


def _stars(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of each component of these links within one index."""
    low = np.arange(len(roots))
    while len(i):
        a, b = low[i], low[j]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        low = low[low]
        if (low[i] == low[j]).all() and (low[low] == low).all():
            break
    order = np.lexsort((roots, low))
    first = np.full(len(roots), -1)
    first[low[order][::-1]] = order[::-1]
    best = first[low]
    moved = np.flatnonzero(best != np.arange(len(roots)))
    return roots[moved], roots[best[moved]]


def _search(max_bits: int):
    """Links among the rows (key, fingerprint, root) of a task, sorted by key."""
    def links(key, prints, root):
        order = np.lexsort((gray_rank(prints), key))
        key, prints, root = key[order], prints[order], root[order]
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(edges, len(key)))
        found_a, found_b = [], []
        small = np.repeat(sizes <= FANOUT, sizes)  # one leaf: compared as it is
        for d in range(1, FANOUT):
            i = np.flatnonzero(small[:-d] & (key[:-d] == key[d:])) if d < len(key) else np.zeros(0, np.int64)
            i = i[np.bitwise_count(prints[i] ^ prints[i + d]) <= max_bits]
            found_a.append(np.maximum(root[i], root[i + d]))
            found_b.append(np.minimum(root[i], root[i + d]))
        for at, n in zip(edges[sizes > FANOUT].tolist(), sizes[sizes > FANOUT].tolist()):
            a, b = _stars(root[at:at + n], *near_pairs(prints[at:at + n], max_bits))
            found_a.append(a)
            found_b.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.append(held[0], new[0]), np.append(held[1], new[1].view(np.uint64)), np.append(held[2], new[2])]
            if not len(held[0]):
                continue
            last = np.searchsorted(held[0], held[0][-1])  # the last key may go on in the next batch
            if last:
                yield links(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield links(*held)

    return run


def link(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fingerprint, component_id): the smallest doc_id whose fingerprint can be reached by steps of at most ``max_bits``
    bits; null where no document there has an id.  ``prints``: doc_id, fingerprint; read once."""
    if max_bits % 2:  # two sets of half as many flips could then not tell max_bits from one more
        raise ValueError("max_bits must be even")
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("root")))
    known = distinct.where("root is not null")
    cuts = [round(64 * k / (max_bits + 1)) for k in range(max_bits + 2)]
    block = lambda lo, hi: F.shiftrightunsigned(F.shiftleft("fingerprint", 64 - hi), 64 - hi + lo)
    # A key is the block's number in the low bits under the block's value.
    keys = known.select("fingerprint", "root", F.explode(F.array(*(
        block(lo, hi) * F.lit(max_bits + 1) + F.lit(k) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))))).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(keys.join(sizes, "key"))
    indexed = met.where(F.col("n") <= NODE).select("key", "fingerprint", "root").repartition("key").sortWithinPartitions("key")
    links = indexed.mapInArrow(_search(max_bits), "a long, b long")

    crowd = met.where(F.col("n") > NODE).select("fingerprint", "root").distinct()
    flips = [sum(1 << b for b in bits) for k in range(max_bits // 2 + 1) for bits in combinations(range(64), k)]
    balls = crowd.select("root", F.explode(F.transform(F.lit([_signed(f) for f in flips]), lambda f: F.col("fingerprint").bitwiseXOR(f))).alias("key"))
    lows = balls.groupBy("key").agg(F.min("root").alias("b"), F.max("root").alias("top")).where("b < top")
    links = links.union(balls.join(lows, "key").select(F.col("root").alias("a"), "b")).where("a <> b")
    return _classes(distinct, links)


WIDE_BITS = 14  # of 64: what texts have between them at most, mostly, whose five-word shingles are similar by 0.8


def candidates(prints: DataFrame, max_bits: int = WIDE_BITS) -> tuple[DataFrame, DataFrame]:
    """((fingerprint, root): the smallest doc_id of each fingerprint, (a, b): roots whose fingerprints are near), for more
    differing bits than blocks can be split for.

    Fingerprints meet where two of six blocks of bits are equal: all up to four bits apart; at 5, 6, 8, 10, 12 and 14 differing bits
    about 90, 72, 37, 16, 6 and 2 %.  What meets is searched with the index and linked at ``max_bits``; completed() finds the near copies
    that do not meet here.  A crowd, more than NODE distinct fingerprints under a key, is cut in Gray order, by ever more
    leading bits of the rank, until the parts fit an index; its first fingerprint is compared with all of it, so the parts
    hang together where they are near."""
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("root")))
    known = distinct.where("root is not null")
    cuts = (0, 11, 22, 33, 43, 54, 64)
    block = lambda f, lo, hi: F.shiftrightunsigned(F.shiftleft(f, 64 - hi), 64 - hi + lo)

    parts = [block(F.col("fingerprint"), lo, hi) for lo, hi in zip(cuts, cuts[1:])]
    every = F.array(*((parts[i] * 2048 + parts[j]) * 64 + 8 * i + j for i, j in combinations(range(len(parts)), 2)))
    keys = known.select("fingerprint", "root", F.explode(every).alias("key"))
    crowded = cut_lineage(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > NODE))
    parts, links, depth = keys.join(crowded, "key", "left_anti"), [], 0
    crowd = cut_lineage(keys.join(crowded, "key"))
    first = crowd.groupBy("key").agg(F.min(F.struct("root", "fingerprint")).alias("first"))
    links.append(crowd.join(first, "key").where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("first.fingerprint"))) <= max_bits)
                 .select(F.col("root").alias("a"), F.col("first.root").alias("b")))
    rank = F.col("fingerprint")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    while not crowd.isEmpty():
        depth += 4  # at 64 every fingerprint stands alone, so this ends
        split = crowd.withColumn("key", F.xxhash64("key", F.shiftrightunsigned(rank, 64 - depth))).drop("n")
        split = cut_lineage(split.join(split.groupBy("key").agg(F.count("*").alias("n")), "key"))
        parts, crowd = parts.unionByName(split.where(F.col("n") <= NODE).drop("n")), split.where(F.col("n") > NODE)
    indexed = parts.select("key", "fingerprint", "root").repartition("key").sortWithinPartitions("key")
    links.append(indexed.mapInArrow(_search(max_bits), "a long, b long"))
    return distinct, links[0].union(links[1]).where("a <> b").distinct()


def shingle_sets(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, shingles: the distinct hashes of a text's shingles, as fingerprints() makes them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_distinct(list(_hashes(value.as_py(), words))).view(np.int64) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, shingles array<long>")


def _prefix(shingles: np.ndarray, least: float) -> np.ndarray:
    """Of n sorted distinct shingles the first n - ceil(least * n) + 1."""
    return shingles[:len(shingles) - math.ceil(least * len(shingles) - 1e-9) + 1]


def _moved_in(shingles: np.ndarray, least: float, common: np.ndarray) -> np.ndarray:
    """What the prefix has with the shingles that are among ``common`` after all others: those behind the plain prefix that
    come into it, and the common ones that are left in it because others run out."""
    often, n = np.isin(shingles, common), len(_prefix(shingles, least))
    last = np.concatenate([np.flatnonzero(~often), np.flatnonzero(often)])[:n]
    return shingles[np.sort(last[(last >= n) | often[last]])]


def sketches(docs: DataFrame, words: int, least: float, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key: a hash of the text, fingerprint, node: a hash of the set of distinct shingles, size: of the set,
    prefix: the shingles of which similar sets share one."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(2):
                hashes = list(_hashes(value.as_py(), words))
                shingles = _distinct(hashes)
                found.append((_signed(_majority(hashes)), _signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)), len(shingles),
                              _prefix(shingles, least).view(np.int64)))
            types = {"fingerprint": pa.int64(), "node": pa.int64(), "size": pa.int32(), "prefix": pa.list_(pa.int64())}
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "text_key", *types])

    return _keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, text_key long, fingerprint long, node long, size int, prefix array<long>")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_key"), whole.alias("text"))


def similar(links: DataFrame, docs: DataFrame, words: int, least: float, doc_id: str, text: str) -> DataFrame:
    """The links (a, b) whose texts' shingle sets have a Jaccard similarity of ``least`` or more.  Of several texts with one
    doc_id the first counts."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(ends, "id")
    sets = cut_lineage(shingle_sets(some.groupBy("id").agg(F.min("text").alias("text")), words, "id", "text"))
    pairs = links.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.where(both >= least * (F.size("x") + F.size("y") - both)).select("a", "b")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _classes(distinct: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links.where("a <> b").distinct(), [])
    return (distinct.join(found, distinct.root == found.node, "left")
            .select("fingerprint", F.coalesce(found.root, distinct.root).alias("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, max_bits: int = WIDE_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest doc_id, nulls last, then by a hash of the text.
    Near copies have the same set of distinct shingles, or sets with a similarity of ``least`` or more.
    Repeated rows are copies.  Documents without ids are compared like any other.  Texts without words are one class.
    All columns stay as they are."""
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    nodes = cut_lineage(sketches(docs, words, least, doc_id, text).groupBy("node").agg(
        F.min(own).alias("own"), *(F.first(c).alias(c) for c in ("fingerprint", "size", "prefix"))))
    texts = lambda ids: _texts(docs, nodes.join(ids, "node", "left_semi"), doc_id, text)
    distinct, near = candidates(nodes.select(F.col("node").alias("doc_id"), "fingerprint"), max_bits)
    same = nodes.join(distinct, "fingerprint").select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    links = _verified(near.union(same), texts, words, least)
    links = links.union(completed(texts, nodes, links, words, least))
    found = connected_components(links, []).withColumnRenamed("node", "member")
    kept = nodes.join(found, nodes.node == found.member, "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("own").alias("own"))
    kept = kept.select(F.col("own.doc_id").alias("kept_id"), F.col("own.text_key").alias("kept_key"))
    row = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("row_id"), F.xxhash64(F.col(text).cast("string")).alias("row_key"))
    stay = row.join(kept, row.row_id.eqNullSafe(kept.kept_id) & (row.row_key == kept.kept_key))
    first = F.row_number().over(Window.partitionBy("kept_id", "kept_key").orderBy("kept_key"))
    return stay.withColumn("first", first).where("first = 1").select("row.*")


def _texts(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, text): the text of each node's first document, again for each repeated row."""
    of = nodes.select("node", F.col("own.doc_id").alias("of_id"), F.col("own.text_key").alias("of_key"))
    all_ = _keyed(docs, doc_id, text)
    return all_.join(of, all_.doc_id.eqNullSafe(of.of_id) & (all_.text_key == of.of_key)).select("node", "text")


def _verified(links: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, least: float) -> DataFrame:
    links = cut_lineage(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return cut_lineage(similar(links, texts(ends), words, least, "node", "text"))


def moved_in(texts: DataFrame, words: int, least: float, common: DataFrame) -> DataFrame:
    """(node, key): what _moved_in() gives for the texts of ``texts`` (node, text) with the shingles of ``common`` (key) last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, often in zip(batch.column(1), batch.column(2)):
                found.append(_moved_in(_distinct(list(_hashes(text.as_py(), words))), least, often.values.to_numpy().view(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "keys"])

    every = shingle_sets(texts, words, "node", "text").select(F.col("doc_id").alias("node"), F.explode("shingles").alias("key"))
    own = every.join(common, "key").groupBy("node").agg(F.collect_set("key").alias("often"))  # a node's own shingles bound it
    return texts.join(own, "node").select("node", "text", "often").mapInArrow(run, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def _needed(least: float, small_a: str, small_b: str, large_a: str, large_b: str) -> Column:
    """Prefix shingles that two similar sets share at least, if their sizes are within these bounds.  Of the shingles that both
    have, those up to the end of the prefix that ends first are in both prefixes; all others are behind that set's prefix."""
    both = F.ceil(F.lit(least / (1 + least)) * (F.col(small_a) + F.col(small_b)) - 1e-9)
    behind = F.greatest(*(F.ceil(F.lit(least) * F.col(c) - 1e-9) for c in (large_a, large_b))) - 1
    return F.greatest(F.lit(1), both - behind)


def completed(texts: Callable[[DataFrame], DataFrame], nodes: DataFrame, links: DataFrame, words: int, least: float) -> DataFrame:
    """The links (a, b) of similarity ``least`` or more between nodes that ``links`` leaves in different components; none is missed,
    but where the first nodes of two components are similar no other pair of these two is looked at.

    Similar sets share a shingle of their prefixes, whatever the order of shingles (prefix filter), and as many as _needed()
    says.  Nodes of one component are not compared again, so a crowd of near copies makes no pairs.  A key under which more pairs
    of nodes meet than COMMON nodes make goes last in the order, with all shingles as common among the nodes that had it; nodes with such
    a shingle in their prefix get a new one, until no such key is new.  So mixed crowds meet under their rarer shingles.
    Only keys that several components have are stored.  ``nodes``: a written table; ``texts``: (node, text) of given nodes."""
    found = connected_components(links, []).withColumnRenamed("node", "member")
    known = nodes.join(found, nodes.node == found.member, "left").select("node", "size", F.coalesce("root", "node").alias("component"), "prefix")
    base = known.select("node", "component", F.explode("prefix").alias("key"))
    about = cut_lineage(known.drop("prefix"))
    shared = cut_lineage(base.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"))
                         .where("low < high").select("key", "rows"))
    base = base.drop("component")
    if shared.count() <= FEW_KEYS:
        met = base.join(F.broadcast(shared.drop("rows")), "key")
    else:
        met = join_split(base, shared, ["key"], "rows", hot_limit(nodes.agg(F.sum(F.size("prefix"))).first()[0]))
    pool = cut_lineage(met.join(about, "node"))
    common, fresh = pool.select("key").limit(0), pool.select("node", "key").limit(0)
    while True:
        tops = cut_lineage(pool.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
            F.sum("n").alias("rows"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")))
        total = tops.agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).first()
        if (total["pairs"] or 0) <= PAIRS * (total["rows"] or 0):
            break
        new = cut_lineage(tops.where(F.col("pairs") > COMMON * (COMMON - 1) // 2).select("key").join(common, "key", "left_anti"))
        if new.isEmpty():
            break
        # Any shingles may go last; a part of the nodes is enough to tell which others are as common, for fewer rounds.
        had = cut_lineage(pool.join(new, "key", "left_semi").select("node").distinct())
        part = max(1, had.count() // SAMPLE)
        some = cut_lineage(had.where(F.pmod(F.xxhash64("node"), F.lit(part)) == 0))
        sets = shingle_sets(texts(some), words, "node", "text").select(F.explode("shingles").alias("key"))
        often = sets.groupBy("key").count().where(F.col("count") > max(1, COMMON // (2 * part))).select("key")
        new = cut_lineage(new.union(often).distinct().join(common, "key", "left_anti"))
        now = base.join(common, "key", "left_anti").unionByName(fresh)
        again = cut_lineage(now.join(new, "key", "left_semi").select("node").distinct())
        common = cut_lineage(common.union(new))
        extra = cut_lineage(moved_in(texts(again), words, least, common))
        fresh = cut_lineage(fresh.join(again, "node", "left_anti").unionByName(extra))
        now = base.join(common, "key", "left_anti").unionByName(fresh)
        also = now.join(extra.select("key").distinct(), "key", "left_semi").join(about, "node")
        both = cut_lineage(pool.join(new, "key", "left_anti").unionByName(also).distinct())
        several = both.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        pool = cut_lineage(both.join(several, "key", "left_semi"))
    here = cut_lineage(pool.groupBy("key", "component").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("node").alias("first"), F.max("node").alias("last")))
    one, two = (here.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("component", "least", "most", "first", "last"))) for x in "ab")
    fits = lambda small, large: F.col(large) >= F.lit(least) * F.col(small) - 1e-9
    met = one.join(two, "key").where(F.col("component_a") < F.col("component_b")).groupBy("component_a", "component_b").agg(
        F.count("*").alias("keys"), *(f(c).alias(c) for x in "ab" for f, c in ((F.min, f"least_{x}"), (F.max, f"most_{x}"), (F.min, f"first_{x}"), (F.max, f"last_{x}"))))
    met = cut_lineage(met.where(fits("least_a", "most_b") & fits("least_b", "most_a")).where(F.col("keys") >= _needed(least, "least_a", "least_b", "most_a", "most_b")))
    firsts = _verified(met.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")), texts, words, least)
    rest = met.where("first_a < last_a or first_b < last_b").join(firsts, (F.col("first_a") == F.col("a")) & (F.col("first_b") == F.col("b")), "left_anti")
    a, b = (pool.select("key", F.col("component").alias(f"component_{x}"), F.col("node").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
    pairs = rest.select("component_a", "component_b", "first_a", "first_b").join(a, "component_a").join(b, ["key", "component_b"])
    pairs = pairs.where("a <> first_a or b <> first_b").where(fits("size_a", "size_b") & fits("size_b", "size_a"))
    pairs = pairs.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("keys")).where(F.col("keys") >= _needed(least, "size_a", "size_b", "size_a", "size_b"))
    return firsts.union(_verified(pairs.select("a", "b"), texts, words, least))


def components(docs: DataFrame, words: int = 3, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id, one row per row of ``docs``.

    Nulls and texts without words have fingerprint 0 and link like any other.  A null doc_id never names a component.
    Ties and repeated rows: same fingerprint, same component.  Empty table: no rows."""
    prints = cut_lineage(fingerprints(docs, words, doc_id, text))
    return prints.join(link(prints, max_bits), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
