import numpy as np
import pytest
from pyspark.sql import functions as F

from carelattice.llm import audio, maxscore


def brute_top(vectors, queries, k):
    out = []
    for q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q[1], v[1])), v[0]) for v in vectors if v[0] != q[0])
        out += [(q[0], i + 1, v, -s) for i, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    data += [(1000 + i, data[5][1]) for i in range(60)]  # copies: equal scores
    data += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (None, data[0][1]), (2004, []), (2005, [2.0, -1.0])]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, score string")
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for shard, block in ((4096, 2048), (64, 3)):
        monkeypatch.setattr(maxscore, "SHARD", shard)
        monkeypatch.setattr(maxscore, "BLOCK", block)
        terms = maxscore.quantised(df)
        got = maxscore.top_k(terms, terms.where("vec_id % 50 = 0"), 10)
        assert sorted(tuple(r) for r in got.collect()) == brute_top(good, [v for v in good if v[0] % 50 == 0], 10)


def test_top_k_with_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, 1.0])], "vec_id long, embedding array<float>")
    terms = maxscore.quantised(df)
    assert sorted(tuple(r) for r in maxscore.top_k(terms, terms, 10).collect()) == [(0, 1, 1, 1048576), (1, 1, 0, 1048576)]
    assert maxscore.top_k(terms.limit(0), terms.limit(0), 10).count() == 0


def test_bounds_prune_without_loss():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(3000, 64)) * rng.gamma(0.5, 1, 64) * 100)
    ids = np.arange(3000)
    for q in range(0, 3000, 500):
        best, scores = maxscore.search_shard(ids, np.ascontiguousarray(x.T), q, x[q], 10)
        whole = x @ x[q]
        whole[q] = -np.inf
        order = np.lexsort((ids, -whole))[:10]
        assert best.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()


def song(seed, notes=60):
    rng = np.random.default_rng(seed)
    time = np.arange(1500) / audio.RATE
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * time) for k in rng.integers(0, 24, notes)]).astype(np.float32)


def pcm(samples):
    return (np.clip(samples, -1, 1) * 20000).astype("<i2").tobytes()


def test_integral_image_filters_equal_plain_sums():
    image = np.random.default_rng(1).random((40, 12))
    got = audio.integers(image)
    for i in (0, 7, len(got) - 1):
        want = 0
        for shape, y, high, wide in audio.FILTERS:
            box = image[i:i + wide, y:y + high]
            a = [box.sum(), image[i:i + wide, y:y + high // 2].sum(), image[i:i + wide // 2, y:y + high].sum(),
                 image[i:i + wide // 2, y:y + high // 2].sum() + image[i + wide // 2:i + wide, y + high // 2:y + high].sum(),
                 image[i + max(1, wide // 3):i + wide - max(1, wide // 3), y:y + high].sum()][shape]
            b = image[i:i + wide].sum() - a if shape == 0 else box.sum() - a
            want = want << 2 | int(audio.GRAY[np.searchsorted(audio.LIMITS, np.log((1 + a) / (1 + b)), side="right")])
        assert int(got[i]) == want
    assert len(audio.integers(image[:15])) == 0 and len(audio.chroma(np.zeros(10))) == 0


def brute_align(prints, queries):
    out = {}
    for q in queries:
        for c in prints:
            if c == q:
                continue
            votes = {}
            a, b = prints[q], prints[c]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    if (i == 0 or a[i - 1] != x) and (j == 0 or b[j - 1] != y):
                        same = ((x ^ y) & 0xFFFF == 0) + ((x ^ y) >> 16 & 0xFFFF == 0)
                        if same:
                            votes[j - i] = votes.get(j - i, 0) + same
            if votes and max(votes.values()) >= audio.MIN_VOTES:
                offset = max(votes, key=lambda o: (votes[o], -abs(o), -o))
                pairs = [(a[i], b[i + offset]) for i in range(len(a)) if 0 <= i + offset < len(b)]
                errors = sum(bin((x ^ y) & 0xFFFFFFFF).count("1") for x, y in pairs)
                if len(pairs) >= audio.MIN_OVERLAP and errors <= 32 * len(pairs) * audio.MAX_ERROR:
                    out[q, c] = (offset, votes[offset], len(pairs), errors)
    return out


def test_shifted_noisy_and_foreign_recordings(spark):
    one, two = song(1), song(2)
    rng = np.random.default_rng(9)
    cut = one[6 * audio.HOP:]
    rows = [(0, pcm(one)), (1, pcm(cut)), (2, pcm(one * 0.7 + rng.normal(0, 0.02, len(one)))), (3, pcm(two)), (4, pcm(one)), (5, None), (6, b""), (7, b"\1"),
            (8, pcm(np.zeros(20000))), (9, pcm(one[:4000])), (None, pcm(two)), (4, pcm(one))]
    media = spark.createDataFrame([(*r, "x") for r in rows], "id long, sound binary, prints string")
    found = audio.fingerprints(media, "id", "sound")
    out = audio.search(found, F.col("recording").isin(0, 3))
    members = [(r.recording, r.class_id) for r in out.where("kind = 'member'").collect()]
    assert len(members) == len(rows) and members.count((4, 0)) == 2 and dict(members)[8] == 8
    assert all((k, None) in members for k in (5, 6, 7, 9)) and (None, 3) in members
    links = {(r.query_class, r.class_id): (r.offset, r.votes, r.overlap, r.bit_errors) for r in out.where("kind = 'link'").collect()}
    prints = {r.class_id: r.prints for r in audio.classes(found).collect()}
    assert links == brute_align(prints, [0, 3])
    assert links[0, 1][0] == -6 and links[0, 2][0] == 0 and not any(3 in k for k in links)
    assert audio.search(audio.fingerprints(media.limit(0), "id", "sound"), F.lit(True)).count() == 0


@pytest.mark.parametrize("noise, cut", [(0.2, 0), (0.35, 0), (0.5, 0), (0, 256), (0.2, 256), (0, 3 * 512)])
def test_recall_of_noisy_and_shifted_copies(spark, noise, cut):
    """Copies that pass the error limit at their true offset, found among other recordings: at least nine in ten."""
    rng = np.random.default_rng(1)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").limit(160).collect()
    sounds = [audio.melody(r.embedding) for r in rows]
    noisy = [s[cut:] + rng.normal(0, noise, len(s) - cut).astype(np.float32) if noise else s[cut:] for s in sounds[:60]]
    made = [audio.integers(audio.chroma(s)) for s in sounds + noisy]
    table = spark.createDataFrame([(i, p.view(np.int32).tolist()) for i, p in enumerate(made)], "recording long, prints array<int>")
    out = audio.search(table, F.col("recording") >= 160).where("kind = 'link'")
    found = {(r.query_class, r.class_id): r.offset for r in out.collect()}
    shift, passes, hits = cut // audio.HOP, 0, 0
    for k in range(60):
        a, b = made[160 + k], made[k][shift:]
        n = min(len(a), len(b))
        if np.bitwise_count(a[:n] ^ b[:n]).sum() <= 32 * n * audio.MAX_ERROR:
            passes += 1
            hits += 0 if (160 + k, k) not in found and not (a == b).all() else 1
    assert passes >= 55 and hits >= 0.9 * passes


def test_a_frequent_integer_meets_in_pieces(spark, monkeypatch):
    """Recordings that share long stretches of two integers, in several shards and blocks: the same links as by plain counting."""
    monkeypatch.setattr(audio, "SHARD", 100)
    monkeypatch.setattr(audio, "BLOCK", 2)
    monkeypatch.setattr(audio, "MEETINGS", 50)
    rng = np.random.default_rng(4)
    base = rng.integers(-2 ** 31, 2 ** 31, 6)
    prints = {k: [int(base[(i // (1 + k % 3)) % 2]) if rng.random() < 0.8 else int(base[rng.integers(0, 6)]) for i in range(int(rng.integers(26, 60)))] for k in range(14)}
    prints[20] = prints[3][:-1] + [prints[3][-1] ^ 7]
    table = spark.createDataFrame(list(prints.items()), "recording long, prints array<int>")
    links = {(r.query_class, r.class_id): (r.offset, r.votes, r.overlap, r.bit_errors)
             for r in audio.search(table, F.col("recording").isin(0, 3, 5, 20)).where("kind = 'link'").collect()}
    assert links == brute_align(prints, [0, 3, 5, 20]) and links[3, 20][0] == 0


def test_vectors_as_melodies():
    assert audio.melody(None) is None and len(audio.melody([])) == 0
    sound = audio.melody([0.1, None, float("nan")])
    assert len(sound) == 3 * audio.HOP and sound[audio.HOP:].max() == 0
