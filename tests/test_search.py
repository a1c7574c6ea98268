import collections
import math
import random

from pyspark.sql import functions as F

from carelattice.operators import components, search, similarity
from carelattice.functions.text import STOP_WORDS


def test_dot_product(spark):
    r = spark.range(1).select(search.dot(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(9.0))).alias("a"),
                              search.dot(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("b")).first()
    assert (r.a, r.b) == (1.0, 0.0)


def test_vector_search_floor_and_upsert(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.92, 0.39], 1), ("c", [0.0, 1.0], 2)], "id string, vector array<float>, seq int")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    hits = search.vector_top_k(v.drop("seq"), q, 5).orderBy("rank").collect()
    assert [h.id for h in hits] == ["a", "b"]
    new = spark.createDataFrame([("a", [0.0, 1.0], 7)], "id string, vector array<float>, seq int")
    up = {r.id: (list(r.vector), r.seq) for r in search.upsert_vectors(v, new).collect()}
    assert len(up) == 3 and up["a"] == ([0.0, 1.0], 0)


def test_vector_search_in_slices(spark, monkeypatch):
    rng = random.Random(3)
    vecs = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    v = spark.createDataFrame(vecs, "id int, vector array<double>")
    q = v.select(F.col("id").alias("query_id"), "vector")
    whole = search.vector_top_k(v, q, 3).collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "VECTOR_PART", 9)
    assert sorted(search.vector_top_k(v, q, 3).collect()) == sorted(whole)


def test_rrf_and_fusion(spark):
    ranked = spark.createDataFrame([(1, x, r) for lst in (["x", "y", "z"], ["y", "x", "w"]) for r, x in enumerate(lst, 1)],
                                   "query_id int, item_id string, rank int")
    s = {r.item_id: r.score for r in search.reciprocal_rank_fusion(ranked, ["query_id"]).collect()}
    assert s["y"] > s["z"] and s["x"] > s["w"]
    lex = spark.createDataFrame([(1, "a", 5.0, ["k"], 1), (1, "b", 2.0, ["k"], 2), (2, "c", 1.0, ["k"], 1)],
                                "query_id int, doc_id string, score double, matched_terms array<string>, rank int")
    none = spark.createDataFrame([], "query_id int, doc_id string, rank int")
    alone = search.fuse(lex, none, ["query_id"]).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id, r.score) for r in alone] == [(1, "a", 5.0), (1, "b", 2.0), (2, "c", 1.0)]
    sem = spark.createDataFrame([(1, "d", 1), (1, "b", 2)], "query_id int, doc_id string, rank int")
    fused = search.fuse(lex, sem, ["query_id"]).filter("query_id = 1").orderBy("rank").collect()
    assert fused[0].item_id == "b" and {r.item_id: r.matched_terms for r in fused}["d"] == ["semantic"]


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    words = ["kidney", "pain", "the", "lab", "dose", "a1c", "is", "5.4%"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(30)]
    docs = spark.createDataFrame([(i, "Visit", t) for i, t in texts], "doc_id int, title string, text string")
    q = "kidney pain kidney 5.4%"
    got = {r.doc_id: r.score for r in search.bm25(docs, spark.createDataFrame([(0, q)], "query_id int, query_text string"), 30).collect()}
    toks = {i: [w for w in f"visit {t}".split() if w not in STOP_WORDS] for i, t in texts}
    avg = sum(map(len, toks.values())) / len(toks)
    want = {}
    for i, tk in toks.items():
        total = 0.0
        for term in q.split():
            df = sum(term in x for x in toks.values())
            tf = tk.count(term)
            if tf:
                total += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf / (tf + 0.5 + 1.5 * len(tk) / avg)
        if total:
            want[i] = total
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_embedding_backfill_only_touches_missing(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(99, "")], "id int, text string")
    done = rows.filter("id < 10").select("id")

    def embedder(texts):
        assert len(texts) <= 25
        return [[float(len(t))] for t in texts]

    out = search.embed_missing(rows, done, embedder).collect()
    assert sorted(r.id for r in out) == list(range(10, 60))


def _sim(a, b):
    import re
    from collections import Counter
    if a == b:
        return 1.0
    ta, tb = ({t for t in re.sub(r"[^a-z0-9\s]", " ", x.lower()).split() if len(t) > 1} for x in (a, b))
    j = len(ta & tb) / len(ta | tb) if ta and tb else 0.0
    ga, gb = (Counter(c[i:i + 2] for i in range(len(c) - 1)) for c in (re.sub("[^a-z0-9]", "", x.lower()) for x in (a, b)))
    n = sum(ga.values()) + sum(gb.values())
    d = 2 * sum((ga & gb).values()) / n if ga and gb else 0.0
    return max(j, d)


def test_similarity_join_matches_brute_force(spark):
    rng = random.Random(5)
    base = ["fibromyalgia syndrome", "chronic pain of the left lower back region", "ab", "a-b", "rash", "rashes", "hand rash", "rash hand",
            "post viral fatigue state", "post-viral fatigue states", "one two three four five six seven", "seven six five four three two one"]
    names = sorted(set(base + ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 9))).strip() or "z" for _ in range(40)]))
    df = spark.createDataFrame([("k", n, i % 3 != 0, True) for i, n in enumerate(names)], "block string, label string, left boolean, right boolean")
    left = {n for i, n in enumerate(names) if i % 3 != 0}
    for threshold in (0.84, 0.3):
        got = {frozenset((r.a, r.b)) for r in similarity.similar_pairs(df, threshold).collect()}
        want = {frozenset((a, b)) for a in names for b in names if a < b and (a in left or b in left) and _sim(a, b) >= threshold - 1e-12}
        assert got == want, (threshold, got ^ want)


def test_components_of_chains_and_hubs(spark):
    chain = [("p", f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]
    hub = [("q", "zz", f"m{i}") for i in range(10)]
    df = spark.createDataFrame(chain + hub, "scope string, a string, b string")
    out = {(r.scope, r.node): r.root for r in components.connected_components(df, ["scope"]).collect()}
    assert len(out) == 32 and {v for (s, _), v in out.items() if s == "p"} == {"n00"} and {v for (s, _), v in out.items() if s == "q"} == {"m0"}


def test_bounds_leave_out_parts_and_no_hit(spark, tmp_path):
    """Same rows as without an index; a query for rare words reads a few parts, one for common words more."""
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    docs = spark.createDataFrame([(i, "", " ".join(words[(i * k) % 5] for k in range(1, 4 + i % 7)) + (f" rare{i // 3}" if i % 50 == 0 else "")) for i in range(600)],
                                 "doc_id long, title string, text string")
    search.build_bounded_index(docs, str(tmp_path / "i"), parts=16)
    for text in ("rare0", "rare50 rare100", "alpha beta", "omega rare150 rare150", "nothing", "gamma delta alpha rare183"):
        queries = spark.createDataFrame([(1, text)], "query_id int, query_text string")
        hits, read = search.search_bounded_index(spark, str(tmp_path / "i"), queries, 3)
        cols = ["query_id", "doc_id", "rank", "matched_terms"]
        want = search.bm25(docs, queries, 3)
        assert sorted(map(tuple, hits.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
        assert len(read) < 16 if "rare" in text and len(text) < 20 else len(read) <= 16
    both = spark.createDataFrame([(1, "alpha"), (2, "rare50 delta")], "query_id int, query_text string")
    assert search.search_bounded_index(spark, str(tmp_path / "i"), both, 3)[0].count() == 6


def test_bounded_index_stores_postings_once_and_only_the_best_hits(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "", "alpha " * (1 + i % 5) + f"w{i % 9}") for i in range(600)], "doc_id long, title string, text string")
    stored, own = [], search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: (kept := own(df), stored.append(kept.count()))[0])
    search.build_bounded_index(docs, str(tmp_path / "i"), parts=4)
    assert not stored and spark.read.parquet(str(tmp_path / "i" / "postings")).count() == 3 * 600  # two terms and the document itself
    hits, _ = search.search_bounded_index(spark, str(tmp_path / "i"), spark.createDataFrame([(1, "alpha w3")], "query_id int, query_text string"), 5)
    assert max(stored) <= 10 and [(r["rank"], len(r.matched_terms)) for r in hits.orderBy("rank").collect()] == [(i, 2) for i in range(1, 6)]


def test_bounded_index_with_repeated_and_null_documents_in_scopes(spark, tmp_path):
    rows = [("p", 1, "kidney labs"), ("p", 1, "kidney labs"), ("p", 1, "kidney"), ("p", 2, "labs labs stable"), ("p", None, "kidney kidney"), ("p", 3, ""),
            ("q", 1, "kidney stable"), ("q", 4, "nothing"), (None, 5, "kidney")]
    docs = spark.createDataFrame([(p, d, "", t) for p, d, t in rows], "patient_id string, doc_id long, title string, text string")
    queries = spark.createDataFrame([("p", "a", "kidney labs labs"), ("q", "a", "kidney"), (None, "a", "kidney"), ("q", None, "kidney")], "patient_id string, query_id string, query_text string")
    search.build_bounded_index(docs, str(tmp_path / "i"), ["patient_id"], parts=3)
    hits, _ = search.search_bounded_index(spark, str(tmp_path / "i"), queries, 8, ["patient_id"])
    got = {(r.patient_id, r.query_id, r.doc_id): (round(r.score, 9), r.matched_terms) for r in hits.collect()}

    def brute(texts: list[tuple], asked: list[str]) -> dict:
        """Equal documents count each, but have one posting a term."""
        n, mean = len(texts), sum(len(t.split()) for _, t in texts) / len(texts)
        tf = collections.Counter((t, d, len(x.split())) for d, x in texts for t in x.split())
        df, out = collections.Counter(t for t, _, _ in tf), {}
        for (t, d, size), f in tf.items():
            if t in asked:
                out[d] = out.get(d, 0) + asked.count(t) * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f / (f + 0.5 + 1.5 * size / mean)
        return {d: (round(v, 9), sorted({t for t, e, _ in tf if e == d and t in asked})) for d, v in out.items()}

    want = {("p", "a", d): v for d, v in brute([(d, t) for p, d, t in rows if p == "p"], ["kidney", "labs", "labs"]).items()}
    assert got == want | {("q", "a", d): v for d, v in brute([(d, t) for p, d, t in rows if p == "q"], ["kidney"]).items()} and len(got) == 4
