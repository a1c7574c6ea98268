import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from carelattice.llm import lines, mixing, rules, toxicity

DOCS = "doc_id long, text string, words string, tokens string, score string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "w", "t", "s") for r in rows], DOCS)


# -- lines -------------------------------------------------------------------------------------

def brute_lines(rows):
    import re
    paths = {}
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            w = re.sub(lines.VARIABLE_TOKEN, lines.VARIABLE, line.strip(" ")).split(" ")
            if not w[0]:
                continue
            keys = [(len(w), 0, tuple(w), ())]
            if len(w) >= lines.GENERAL_TOKENS:
                cut = [lines.LEAD + (len(w) - lines.LEAD) * k // lines.PARTS for k in range(lines.PARTS + 1)]
                keys += [(len(w), k + 1, tuple(w[:cut[k]]), tuple(w[cut[k + 1]:])) for k in range(lines.PARTS)]
            for key in keys:
                paths.setdefault(key, []).append((doc, n))
    out = set()
    for key, places in paths.items():
        seen = {d for d, _ in places}
        if len(seen) >= (lines.MIN_GENERAL if key[1] else lines.MIN_DOCS * 2 ** max(0, lines.LONG - key[0])):
            out |= {p for p in places if p[0] > min(seen)}
    return {(d, "\n".join(x for n, x in enumerate((t or "").split("\n")) if (d, n) not in out)) for d, t in rows}


PASSAGE = " ".join(f"passage{i}" for i in "abcdefgh") + " of many words"
LINES = [(i, f"Own line of document {chr(97 + i)} alone\n{PASSAGE}\nshort one") for i in range(4)] + [
    (10 + i, f"We thank {name} very much for the kind order\nsecond line only here {name}") for i, name in enumerate(["Ann", "Bob", "Cid", "Dee", "Eve", "Fay"])] + [
    (30, "Order 17 was shipped on 2024-01-02 to you"), (31, "Order 18 was shipped on 2023-05-06 to you"), (40, None), (41, ""), (42, "\n\n"),
    (43, "the same line twice in one\nthe same line twice in one"), (44, "x " * 5000)]


def test_lines_equal_brute_force(spark):
    got = {(r.doc_id, r.text or "") for r in lines.dedup(docs_of(spark, LINES)).collect()}
    assert got == brute_lines(LINES)
    text = dict(got)
    assert PASSAGE in text[0] and not any(PASSAGE in text[i] for i in (1, 2, 3))
    assert "thank Ann" in text[10] and "thank Fay" not in text[15] and text[31] == "" and text[43].count("same") == 2


def test_lines_equal_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(c.execute(lines.SQL).fetchall())
    got = lines.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_dropped")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_lines_keep_columns_rows_and_nothing(spark):
    rows = [LINES[0], LINES[0], (None, PASSAGE)]
    docs = docs_of(spark, rows).withColumn("n_lines", F.lit("mine"))
    out = lines.dedup(docs, counts=False)
    assert out.columns == docs.columns and out.count() == 3 and {r.n_lines for r in out.collect()} == {"mine"}
    assert [r.text for r in out.collect() if r.doc_id is None] == [PASSAGE]  # the smallest, so the first
    assert lines.dedup(docs.limit(0)).count() == 0


def test_short_lines_need_more_documents(spark):
    rows = [(i, f"own text of document {'abcdefghijklmnopqrstuvwxyz'[i % 26] * (1 + i // 26)}\nAll rights reserved.\n" + ("Les.\n" if i < 31 else "") + ("three short words\n" if i < 7 else "") + "\n") for i in range(40)]
    got = {(r.doc_id, r.text) for r in lines.dedup(docs_of(spark, rows)).collect()}
    assert got == brute_lines(rows)
    text = dict(got)
    assert "All rights reserved." in text[0] and not any("reserved" in text[i] for i in range(1, 40))
    assert all("Les." in text[i] for i in range(31)) and all("three short words" in text[i] for i in range(7))


def test_lines_with_clashing_columns_and_a_very_long_text(spark):
    names = ["doc", "row", "lines", "dropped", "held", "line", "_doc", "_row", "_dropped", "template", "tokens", "part", "words"]
    rows = [(1, "a b c d e f"), (2, "a b c d e f\nx y z u v"), (3, "\n".join(f"{'qwertzuiop'[i % 10]} {'asdfghjkl'[i % 9]} w" + "xyz"[i % 3] * (1 + i // 90) + " line of text" for i in range(30_000)))]
    docs = docs_of(spark, rows + [(4, rows[2][1])])
    for n in names:
        docs = docs.withColumn(n, F.lit(f"my {n}"))
    out = lines.dedup(docs)
    assert out.columns == docs.columns + ["n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i][n] == f"my {n}" for i in got for n in names)
    assert got[1].text == "a b c d e f" and got[2].text == "x y z u v" and got[3].n_lines == 30_000 and got[4].text == ""


# -- rules -------------------------------------------------------------------------------------

def test_statistics(spark):
    rows = [(1, "Hello, World! | a a\n\nx1"), (2, None), (3, ""), (4, "y" * 100000)]
    got = {r.doc_id: r for r in rules.statistics(docs_of(spark, rows)).collect()}
    assert (got[1].chars, got[1].words, got[1].bars, got[1].marks) == (23, 6, 1 / 6, 1 / 6) and got[1].upper == 2 / 23
    assert all(got[2][s] == got[3][s] for s in rules.STATISTICS) and got[3].chars == 0 and got[3].word_length == 0 and got[4].chars == 100000


def test_rules_column_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(rules.STATISTICS)))
    y = ((x[:, 0] > 0.6) & (x[:, 5] <= 0.4) | (x[:, 3] > 0.9)).astype(float)
    model = rules.fit(x, y)
    assert model.rules and len(model.rules) < 150
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], ", ".join(f"{s} double" for s in rules.STATISTICS))
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    z = model.intercept + sum(w * rules.holds(r, x[:200]) for r, w in model.rules) + sum(s * np.clip(x[:200, k], lo, hi) for k, lo, hi, s in model.slopes)
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got > 0.5) == y[:200]).mean() > 0.97


def test_rules_without_labels(spark):
    docs = docs_of(spark, [(1, "a"), (2, None)])
    model = rules.train(docs, spark.createDataFrame([(9, None), (None, 1)], "doc_id long, quality int"))
    got = rules.score(rules.statistics(docs), model).collect()
    assert {r.score for r in got} == {0.5} and rules.score(rules.statistics(docs.limit(0)), model).count() == 0


@pytest.fixture(scope="module")
def held(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r for r in labels.collect()}


def test_quality_on_held_out_documents(held):
    docs, labels, truth = held
    out = rules.held_out(F.col("doc_id"), 5, 0)
    model = rules.train(docs, labels.where(~out))
    rows = rules.score(rules.statistics(docs), model).where(out).select("doc_id", "score", "predicted").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in rows if r.doc_id in truth]) > 0.93


# -- toxicity ----------------------------------------------------------------------------------

def test_words():
    assert toxicity.words(None) == set() and toxicity.words("You IDIOT!!! (idiot)\tx") == {"you", "idiot", "x"}


def test_pu_learning_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(2)
    plain = [f"word{i}" for i in range(200)]
    texts, toxic = [], []
    for i in range(1500):
        bad = i % 10 == 0
        texts.append(" ".join(list(rng.choice(plain, 30)) + ([str(rng.choice(["foul", "nasty", "vile"]))] if bad else [])))
        toxic.append(bad)
    docs = docs_of(spark, list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, "x " * 300000 + "Foul!")])
    labels = spark.createDataFrame([(i, 1) for i in range(0, 700, 10)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, prior=0.1)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = range(700, 1500)
    assert np.mean([got[i].predicted == toxic[i] for i in unseen]) > 0.99
    assert got[9000].score == got[9001].score and got[9000].predicted == 0 and got[9002].predicted == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pu_without_positives(spark):
    docs = docs_of(spark, [(1, "a b"), (2, None)])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.weights == {} and {r.predicted for r in toxicity.score(docs, model).collect()} == {0}


def test_risk_estimator_does_not_go_below_zero():
    """Where every unlabelled row is a positive seen before, the prior's correction must not pay for unlearning them."""
    rows = columns = np.repeat(np.arange(20), 1)
    w, c = toxicity.nn_pu(rows, columns, np.arange(20) < 10, 20, 0.5)
    assert np.isfinite(w).all() and np.isfinite(c) and np.abs(w).max() < 50


# -- mixing ------------------------------------------------------------------------------------

def projected_gradient(tokens, p, goal, steps=200_000):
    """The same least squares by a solver of its own: fixed small steps on all rates at once."""
    share = tokens[:, None] * p
    size = np.sqrt(np.maximum((share[:, :, None] * p[:, None, :]).sum(0).diagonal(), 1.0))
    gram = (share[:, :, None] * p[:, None, :]).sum(0) / size[:, None] / size[None, :]
    step, rate, last = 0.5 / np.linalg.eigvalsh(gram)[-1], np.ones(len(tokens)), None
    for _ in range(steps):
        totals = share.T @ rate
        if last is not None and np.abs(totals - last).max() <= 1e-12 * goal.sum():
            break
        rate, last = np.maximum(0, rate - step * p @ ((totals - goal) / size / size)), totals
    return rate, share.T @ rate


@pytest.mark.parametrize("goal", [[20_000.0, 20_000.0, 10_000.0], [100.0, 100.0, 100.0]])
def test_rates_equal_a_second_solver(spark, goal):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.4, 0.3, 0.2], 120)
    tokens = rng.integers(0, 900, 120)
    soft = spark.createDataFrame([(i, i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, text_key long, tokens long, p array<double>")
    out, reached = mixing.rates(soft, targets=goal)
    rate, totals = projected_gradient(tokens.astype(float), p, np.array(goal))
    got = np.array([r.rate for r in out.orderBy("doc_id").collect()])
    assert (got >= 0).all() and np.allclose((tokens[:, None] * p).T @ got, reached, rtol=1e-6, atol=1e-3)
    scale = np.sqrt((tokens[:, None] * p * p).sum(0))
    assert np.abs((np.array(reached) - goal) / scale).sum() <= np.abs((totals - goal) / scale).sum() + 2e-3 * sum(goal) / scale.min()


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    tokens = rng.integers(0, 2000, 500)
    soft = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")
    out, reached = mixing.rates(soft, weights=[0.7, 0.2, 0.1])
    rows = out.collect()
    rate = np.array([r.rate for r in rows])
    totals = np.array([r.tokens * np.array(r.p) * r.rate for r in rows]).sum(0)
    assert (rate >= 0).all() and np.allclose(totals, reached) and np.allclose(totals, np.array([0.7, 0.2, 0.1]) * tokens.sum(), rtol=1e-3)


def test_rates_of_a_domain_nobody_is_in(spark):
    soft = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 0, [0.5, 0.5])], "doc_id long, tokens long, p array<double>")
    out, reached = mixing.rates(soft, targets=[20.0, 5.0])
    assert reached == pytest.approx([20.0, 0.0]) and {r.doc_id: r.rate for r in out.collect()}[1] == pytest.approx(2.0)
    assert mixing.rates(soft.limit(0), targets=[20.0, 5.0])[0].count() == 0


def test_copies_and_repeats(spark):
    docs = docs_of(spark, [(i, f"t{i}") for i in range(2000)] + [(None, "n"), (None, "n")])
    taken = docs.select("doc_id", F.xxhash64("text").alias("text_key"), mixing.copies(F.lit(1.25), "doc_id").alias("copies"))
    out = mixing.repeated(docs, taken)
    assert out.columns == docs.columns and abs(out.count() - 2502) < 80
    assert mixing.repeated(docs, taken.withColumn("copies", F.lit(0))).count() == 0


def test_posteriors_on_real_labels(held):
    docs, labels, truth = held
    model = mixing.train(docs, mixing.domain_labels(labels).where("doc_id % 3 <> 0"))
    rows = mixing.members(docs, model).where("doc_id % 3 = 0").collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in rows)
    named = [(np.argmax(r.p), 0 if truth[r.doc_id].quality and not truth[r.doc_id].toxic else 1) for r in rows if r.doc_id in truth]
    assert np.mean([bool(a) == bool(b) for a, b in named]) > 0.85


def test_mixing_without_labels(spark):
    docs = docs_of(spark, [(1, "a b"), (2, None), (None, "")])
    model = mixing.train(docs, spark.createDataFrame([], "doc_id long, domain string"))
    assert all(r.p == pytest.approx([1 / 3] * 3) for r in mixing.members(docs, model).collect())
