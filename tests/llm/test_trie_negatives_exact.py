import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelattice.llm import exacthash, hardneg, prefixtrie, queries

EMPTY = hashlib.sha256(b"").hexdigest()


# --- op11 ---------------------------------------------------------------------------------------------------

def told(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest()
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", digest, x or ""))
    return {c: [(v[2], v[4]) for v in sorted(vs)] for c, vs in convs.items()}


def brute_trie(convs):
    members, kids, leaves, saved, out = {}, {}, {}, {}, []
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    for n in sorted(members, key=len, reverse=True):
        below = kids.get(n, [])
        leaves[n] = sum(leaves[k] for k in below) or 1
        saved[n] = sum(saved[k] for k in below) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
        ends = sorted(c for c in members[n] if len(convs[c]) == len(n))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(below), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(-1 if x is None else x for x in r))


def head(c):
    return zlib.crc32(str(c).encode()) % 9


def spliced(own):
    return {c: own.get(c - c % 5, [])[:head(c)] + own[c][head(c):] for c in own}


SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(frame):
    conv = F.col("conv")
    return prefixtrie.spliced(prefixtrie.turns(frame), conv - F.pmod(conv, F.lit(5)), F.crc32(conv.cast("string").cast("binary")) % 9, 8)


def plain(frame):
    own = prefixtrie.turns(frame)
    n = prefixtrie.lengths(own)
    return own.join(n, "conv"), n


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert ordered(prefixtrie.trie(*rebuilt(frame)).collect()) == ordered(brute_trie(spliced(told(rows))))
    assert ordered(prefixtrie.trie(*plain(frame)).collect()) == ordered(brute_trie(told(rows)))


def test_trie_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_prefix_trie(spark, sf_dir).collect()
    assert ordered(got) == ordered(brute_trie(spliced(told(rows))))


def test_trie_of_few_texts_with_nulls_ties_and_repeats(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["", "a", "b", "ä long text " * 50, None]
    rows = []
    for c in range(60):
        for t in range(int(rng.integers(1, 14))):
            rows.append((c, None if rng.random() < 0.1 else int(rng.integers(0, 9)), [None, "user", "tool"][rng.integers(0, 3)], words[int(rng.integers(0, 5) * (rng.random() < 0.4))]))
    rows += rows[:7] + [(None, 1, "user", "no conversation")]
    monkeypatch.setattr(prefixtrie, "CHUNK", 4)
    monkeypatch.setattr(prefixtrie, "hot_limit", lambda total: 3)
    check(spark, rows)


def test_trie_of_long_and_of_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "STRETCH", 3)
    long = [(10, t, "user", f"{t % 7}") for t in range(150)] + [(11, t, "user", f"{t % 7}") for t in range(120)] + [(12, t, "user", "x") for t in range(40)]
    same = [(c, t, "user", "hello") for c in range(100, 160) for t in range(3)]
    check(spark, long + same + [(200, 0, "user", "hello")])


def test_trie_of_no_conversations(spark):
    assert prefixtrie.trie(*plain(spark.createDataFrame([], SCHEMA))).collect() == []


def test_trie_ignores_other_columns(spark):
    frame = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "a")], SCHEMA).selectExpr("*", "1 AS conv", "2 AS digest", "3 AS n", "4 AS row")
    assert ordered(prefixtrie.trie(*plain(frame)).collect()) == ordered(brute_trie({1: [("u", "a")], 2: [("u", "a")]}))


def test_only_diverging_blocks_are_refined(spark):
    rows = [(c, t, "u", "same" if t < 8 else f"{c} {t}") for c in range(20) for t in range(12)]
    own, _ = plain(spark.createDataFrame(rows, SCHEMA))
    parts = prefixtrie.blocks(own).collect()
    ways = {}
    for p in parts:
        ways.setdefault((p.block, p.a, p.b), set()).add(str(p.turns))
    assert sorted((k[0], len(v)) for k, v in ways.items()) == [(0, 1), (1, 1), (2, 20)]


# --- op12 ---------------------------------------------------------------------------------------------------

def quantise(x, scale):
    return [int(np.floor(np.float64(v) * scale)) for v in x]


def brute_negatives(rows, anchors, positive=5, negative=3, low=50, high=95):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, la, ta in sorted(set(anchors)):
        scored = sorted(((-dot(ta, t), v, lv) for v, lv, t in rows if v != a))
        for s, p, _ in [x for x in scored if x[2] == la][:positive]:
            hits = [x for x in scored if x[2] != la and low * -s <= 100 * -x[0] <= high * -s][:negative]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(hits, 1)]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    make = lambda some: spark.createDataFrame([(v, la, list(t)) for v, la, t in some], "vec_id long, label long, terms array<long>")
    got = hardneg.mine(make(rows), make(anchors), **options)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_residue_products_are_exact():
    rng = np.random.default_rng(5)
    for size, width in ((3, 1), (200, 64), (30_000, 3000), (2 ** 20, 40), (2 ** 21, 900)):
        a, b = rng.integers(-size, size, (7, width)), rng.integers(-size, size, (11, width))
        product = hardneg.Product(a, b)
        assert (product.scores(slice(0, 7)) == a @ b.T).all()
        assert (product.scores(slice(2, 4)) == (a @ b.T)[2:4]).all()
    extreme = np.full((1, 2048), -(2 ** 21))
    assert hardneg.Product(extreme, extreme).scores(slice(0, 1)) == 2048 * 2 ** 42
    with pytest.raises(ValueError):
        hardneg.Product(extreme * 1024, extreme)


def test_mining_against_brute_force_with_ties_repeats_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "SHARD", 37)
    monkeypatch.setattr(hardneg, "BLOCK", 5)
    monkeypatch.setattr(hardneg, "TILE", 2)
    rng = np.random.default_rng(6)
    rows = [(int(i), int(rng.integers(0, 4)), tuple(int(x) for x in rng.integers(-3, 4, 6))) for i in rng.permutation(300)]
    rows += rows[:20] + [(700, 1, rows[5][2][:4] + (0, 0))] * 60
    anchors = [r for r in rows if r[0] % 10 == 0] + [(0, 2, rows[3][2])]
    assert mined(spark, rows, anchors) == brute_negatives(rows, anchors)
    assert mined(spark, rows, anchors, positive=2, negative=7, low=0, high=100) == brute_negatives(rows, anchors, 2, 7, 0, 100)
    assert mined(spark, rows, []) == mined(spark, [], anchors) == []


def test_large_components(spark):
    rows = [(i, i % 2, (2 ** 25 + i, -(2 ** 24) - 3 * i, i)) for i in range(40)]
    assert mined(spark, rows, rows[:4], low=0, high=100) == brute_negatives(rows, rows[:4], low=0, high=100)


def test_quantised_leaves_out_what_has_no_scores(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, 1, [float("nan"), 1.0]), (3, None, [1.0]), (None, 1, [1.0]), (4, 1, None), (5, 1, [float("inf")]), (6, 2, []), (7, 2, [1.0, None])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "3 AS terms", "4 AS x")
    assert sorted((r.vec_id, r.label, r.terms) for r in hardneg.quantised(frame).collect()) == [(1, 1, [128, -1]), (6, 2, [])]
    big = spark.createDataFrame([(1, 1, [1e300])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        hardneg.quantised(big).collect()


def test_negatives_query_against_brute_force(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, tuple(quantise(r.embedding, 256))) for r in some if r.label is not None]
    want = brute_negatives(rows, [r for r in rows if r[0] % 50 == 0])
    assert want and sorted(tuple(r) for r in queries.op12_hard_negatives(spark, sf_dir).collect()) == want


# --- op13 ---------------------------------------------------------------------------------------------------

def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for i in ids:
            kept, first = (first, False) if i == keep and first else (False, first)
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return ordered(out)


DOCS = [(1, "Some Text"), (2, "some text"), (3, "SOME TEXT "), (4, None), (5, ""), (6, "ÄÖ straße İ K"), (7, "äö straße i̇ k"), (8, "ÄÖ STRAßE İ k"),
        (None, "some text"), (9, "long " * 50_000), (10, "LONG " * 50_000), (None, "alone"), (None, "alone"), (11, "again"), (11, "again"), (11, "AGAIN"),
        *((100 + i, "hot") for i in range(300)), *((500 + i, f"text {i % 40}") for i in range(120))]


def copies(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS hash", "1 AS size", "2 AS owner", "3 AS row", "4 AS kept")
    return ordered(exacthash.copies(frame, **options).collect())


@pytest.mark.parametrize("options", [{}, {"capacity": 4}, {"capacity": 1, "hot": 5}, {"key_bits": 3, "capacity": 2, "hot": 20}, {"key_bits": 1, "hot": 0}])
def test_copies_against_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(exacthash, "OWNER_BYTES", 20_000)
    assert copies(spark, DOCS, **options) == brute_copies(DOCS)


def test_different_texts_under_one_key_stay_apart(spark):
    rows = [(i, f"{i // 2:05d}") for i in range(400)]  # one length, two hashes
    assert copies(spark, rows, key_bits=1, capacity=2) == brute_copies(rows)


def test_buckets_are_split_until_none_is_overfull(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("hash"), F.lit(1).alias("size"))
    slots = exacthash.directory(keys, 12, 50)
    found = keys.withColumn("slot", F.shiftrightunsigned("hash", 52)).join(slots, "slot").groupBy("depth", "prefix").count().collect()
    assert sum(r["count"] for r in found) == 3000 and max(r["count"] for r in found) <= 50
    parents = {}
    for r in found:
        for up in range(1, r.depth + 1):
            parents[(r.depth - up, r.prefix >> up)] = parents.get((r.depth - up, r.prefix >> up), 0) + r["count"]
    assert min(parents.values()) > 50  # nothing was split without need


def test_no_documents(spark):
    assert copies(spark, []) == []


def test_dedup_keeps_whole_rows(spark):
    frame = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(DOCS)], "doc_id long, text string, sha string").withColumn("id", F.lit(5))
    kept = exacthash.dedup(frame)
    assert kept.columns == frame.columns
    assert sorted(lower(r.text) for r in kept.collect()) == sorted({lower(t) for _, t in DOCS})
    assert {(r.doc_id, lower(r.text)) for r in kept.collect()} == {(g[1], lower(t)) for g in brute_copies(DOCS) for i, t in DOCS if g[3] and i == g[0] and hashlib.sha256(lower(t).encode()).hexdigest() == g[4]}


def test_exact_dedup_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(queries.op13_exact_dedup(spark, sf_dir).collect()) == brute_copies(rows)
