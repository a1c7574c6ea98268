import numpy as np
import xxhash
from pyspark.sql import functions as F

from carelattice.llm import simhash as S


def fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in sh], dtype=">u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int).sum(0)
    return int.from_bytes(np.packbits(2 * bits > len(sh)).tobytes(), "big")


def components(ids, prints, most):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(ids))]


def test_near_pairs_of_the_index():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 64, 30, dtype=np.uint64)
    prints = np.unique(np.concatenate([base] + [base[:10] ^ np.uint64((1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 64, (40, 2))]))
    prints = prints[np.argsort(S.gray_rank(prints))]
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    for most in (0, 2, 14):
        i, j = S.near_pairs(prints, most)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(apart <= most)) if a < b}


def test_components_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("x").alias("fingerprint"), F.lit(1).alias("root"))
    odd = [(10 ** 6, None), (10 ** 6 + 1, " \n\t "), (10 ** 6 + 2, "two words"), (10 ** 6 + 3, "TWO\x0bWords"), (10 ** 6 + 4, "Été été"), (None, "two words")]
    docs = docs.union(spark.createDataFrame([(a, b, "x", 1) for a, b in odd + odd[:1]], docs.schema))
    rows = docs.collect()
    prints = [fingerprint(r.text, 3) for r in rows]
    want = sorted(zip(["%016x" % p for p in prints], [str(r.doc_id) for r in rows], components([r.doc_id for r in rows], prints, 2)))
    got = sorted((r.fingerprint, str(r.doc_id), r.component_id) for r in S.components(docs, 3, 2).collect())
    assert got == want


def test_crowds_link_like_pairs(spark, monkeypatch):
    """Many more fingerprints under one key than an index holds: the exact rule for crowds finds the same components."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2 ** 63))
    prints = {base}
    for _ in range(260):
        p = base
        for b in rng.integers(0, 64, int(rng.integers(1, 6))):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints)
    monkeypatch.setattr(S, "NODE", 20)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fingerprint long")
    got = {r.fingerprint % (1 << 64): r.component_id for r in S.link(df, 2).collect()}
    assert [got[p] for p in prints] == components(list(range(len(prints))), prints, 2)


def test_empty_table(spark):
    assert S.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_near_copy(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(12)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [(100, texts[3], "exact"), (101, texts[3] + " and more", "near"), (102, texts[4].upper(), "case"), (None, texts[5], "nameless"), (7, texts[7], "x"),
             (103, None, "x"), (104, "", "x"), (105, " ", "x"), (None, "only nameless here", "x"), (None, "only nameless here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for node in (512, 3):
        monkeypatch.setattr(S, "NODE", node)
        got = sorted((str(r.doc_id), r.text or "") for r in S.one_of_each(docs).collect())
        assert got == sorted([(str(i), t) for i, t in enumerate(texts)] + [("103", ""), ("None", "only nameless here")])


def test_similarity_decides(spark):
    """Near fingerprints alone are no link: half the shingles differ."""
    base = [f"w{i}" for i in range(300)]
    other = base[:220] + [f"x{i}" for i in range(80)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
    links = spark.createDataFrame([(2, 1)], "a long, b long")
    assert S.similar(links, docs, 5, 0.8, "doc_id", "text").count() == 0
    assert S.similar(links, docs, 5, 0.5, "doc_id", "text").count() == 1


def near_classes(texts, words, least):
    """Smallest member of each text's class, by all pairs."""
    sets = [{tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_no_pair_at_the_similarity_is_lost(spark):
    """Pairs a little over 0.8, whose fingerprints differ in 9 bits and more: recall is 1 against all pairs."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(150):
        base = [f"w{x}" for x in rng.integers(0, 50000, int(rng.integers(60, 400)))]
        at, n = int(rng.integers(0, len(base) - 12)), int(len(base) * rng.uniform(0.05, 0.13))
        texts += [" ".join(base), " ".join(base[:at] + [f"z{x}" for x in rng.integers(0, 50000, n)] + base[at + n:])]
    prints = np.array([S.fingerprint(t, 5) for t in texts], np.uint64)
    root = near_classes(texts, 5, 0.8)
    assert sum(np.bitwise_count(prints[i] ^ prints[r]) > 11 for i, r in enumerate(root)) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.one_of_each(docs).collect()) == sorted(set(root))


def test_mixed_crowds_equal_all_pairs(spark, monkeypatch):
    """Different texts around one long stock passage, and near copies of some: crowded keys, small limits, no pair lost."""
    rng = np.random.default_rng(12)
    stock, texts = [f"s{x}" for x in range(60)], []
    for k in range(60):
        own = [f"w{x}" for x in rng.integers(0, 9000, int(rng.integers(8, 40)))]
        texts.append(" ".join(own + stock))
        if k % 3 == 0:
            texts.append(" ".join(own + stock[:-4] + [f"z{k}"]))
    monkeypatch.setattr(S, "NODE", 8)
    monkeypatch.setattr(S, "COMMON", 3)
    monkeypatch.setattr(S, "PAIRS", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.one_of_each(docs).collect()) == sorted(set(near_classes(texts, 5, 0.8)))
    none = spark.createDataFrame([], "a long, b long")  # the completing join alone, without the index's links
    nodes = S.sketches(docs, 5, 0.8, "doc_id", "text").withColumn("node", F.col("doc_id"))
    pick = lambda ids: docs.withColumnRenamed("doc_id", "node").join(ids, "node", "left_semi")
    got = {(max(r), min(r)) for r in S.completed(pick, nodes, none, 5, 0.8).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i) if near_classes([texts[i], texts[j]], 5, 0.8) == [0, 0]}
    assert got == want and want


def test_equal_fingerprints_are_no_copies(spark):
    """One shingle that fills over half of each text is the fingerprint of both."""
    texts = [" ".join(["n/a"] * 130 + [f"{x}{i}" for i in range(100)]) for x in "ab"] + [" ".join(["n/a"] * 150 + [f"b{i}" for i in range(100)])]
    assert len({S.fingerprint(t, 5) for t in texts}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.one_of_each(docs).collect()) == [0, 1]


def test_two_crowds_under_one_key(spark, monkeypatch):
    """Two crowds of near copies share a passage: their nodes are not multiplied out, and a text near a few of one crowd only is found."""
    rng = np.random.default_rng(21)
    stock, texts = [f"s{x}" for x in range(9)], []
    for crowd in "ab":
        base = [f"{crowd}{x}" for x in range(120)]
        for k in range(40):
            at = int(rng.integers(0, 110))
            texts.append(" ".join(base[:at] + [f"{crowd}z{k}"] + base[at + 1:] + stock))
    texts.append(" ".join([f"b{x}" for x in range(112)] + ["other"] * 3 + stock))
    monkeypatch.setattr(S, "COMMON", 6)
    monkeypatch.setattr(S, "SAMPLE", 30)
    monkeypatch.setattr(S, "PAIRS", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_classes(texts, 5, 0.8)
    assert len(set(want)) == 2 and sorted(r.doc_id for r in S.one_of_each(docs).collect()) == sorted(set(want))
    nodes = S.sketches(docs, 5, 0.8, "doc_id", "text").withColumn("node", F.col("doc_id"))
    links = spark.createDataFrame([(i, 0 if i < 40 else 40) for i in range(80) if i not in (0, 40)], "a long, b long")
    pick = lambda ids: docs.withColumnRenamed("doc_id", "node").join(ids, "node", "left_semi")
    found = [tuple(r) for r in S.completed(pick, nodes, links, 5, 0.8).collect()]
    assert found and all({a < 40, b < 40} == {False} for a, b in found)


def test_moved_in_keys_are_those_of_the_new_prefix():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 50):
        shingles = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        for share in (0, 0.1, 0.5, 1):
            common = shingles[rng.random(len(shingles)) < share]
            order = [x for x in shingles if x not in common] + [x for x in shingles if x in common]
            old, new = set(S._prefix(shingles, 0.8)), set(order[:len(S._prefix(shingles, 0.8))])
            assert {x for x in old if x not in common} | set(S._moved_in(shingles, 0.8, common)) == new
