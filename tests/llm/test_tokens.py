import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carelattice.llm import packing, simple8b
from carelattice.llm.tokens import BYTE_BPE, Encoder, tokenizer_file

ODD = ["", None, " ", "a", " lead", "trail ", "a  b", "a\nb", "\n\na", "a \n b", "tab\tx", "nbsp\xa0x", "don't 'sfoo ß.é!", "a <|endoftext|> b",
       "中文 текст 😀", "1,234.56\n\n  zz", "x\x1cy !\x1c!", "w" * 3000]


def whole(texts, end=None):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_file(BYTE_BPE))
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end]), dtype="<u4") for t in texts]


def test_chunks_give_the_ids_of_the_whole_text(monkeypatch):
    rng = random.Random(1)
    letters = list("ab cdé'sß$%1²½ªº\n\t  ,.!|\xa0\x1c 中ж😀٣")
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = [x.tolist() for x in whole(texts)]
    enc = Encoder(BYTE_BPE)
    assert [x.tolist() for x in enc.encode_all(pa.array(texts))] == want
    assert [enc.encode(t).tolist() for t in texts] == want
    monkeypatch.setattr("carelattice.llm.tokens.STEP_CHARS", 7)
    monkeypatch.setattr("carelattice.llm.tokens.SLICE_BYTES", 40)
    monkeypatch.setattr("carelattice.llm.tokens.CACHE_ENTRIES", 5)
    assert [x.tolist() for x in Encoder(BYTE_BPE).encode_all(pa.array(texts))] == want


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("high", [1, 2, 100, 50257, 2 ** 40, 2 ** 63])
def test_simple8b_round_trip(n, high):
    x = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64, endpoint=True)
    if n > 10:
        x[[1, n // 3, n // 2 - 1, n // 2, n - 1]] = [2 ** 60 - 1, 0, 2 ** 60, 2 ** 64 - 1, 2 ** 61]
    words, blocks = simple8b.encode(x)
    assert (simple8b.decode(words, blocks, n) == x).all()


def test_simple8b_packs_small_ids():
    words, _ = simple8b.encode(np.zeros(1024, np.uint64))
    assert len(words) == 9 and len(simple8b.encode(np.full(1024, 3))[0]) < 40


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simple8b, "SEGMENT_IDS", 50)
    rows = [(10 * i % 187, t, "x") for i, t in enumerate(ODD)] + [(10, "a", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    simple8b.write(docs, str(tmp_path / "f"), end_id=2)
    got = simple8b.read(spark, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    ids = whole([r[1] for r in order], 2)
    assert [r.doc_id for r in got] == [r[0] for r in order]
    assert [r.start for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    assert [(r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == [(len(x), zlib.crc32(x.tobytes()), x.tobytes()) for x in ids]
    simple8b.write(docs.limit(0), str(tmp_path / "e"))
    assert simple8b.read(spark, str(tmp_path / "e")).count() == 0


def check_packing(got, ids, capacity):
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for key, x in ids.items():
        parts = sorted(by_doc[key], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and sum(p.length for p in parts) == len(x)
        assert all(p.length == capacity for p in parts[1:])
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(x[p.start:p.start + p.length].tobytes())
    return len(by_sequence)


def test_packing_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(1).alias("length"), F.lit(2).alias("salt"))
    docs = docs.union(spark.createDataFrame([(10 ** 6, None, 1, 2), (10 ** 6 + 1, "", 1, 2)], docs.schema))
    rows = docs.collect()
    ids = dict(zip([r.doc_id for r in rows], whole([r.text for r in rows], 0)))
    for capacity in (64, 2048):
        got = packing.pack_documents(docs, capacity=capacity).collect()
        n = check_packing(got, ids, capacity)
        assert n <= 1.02 * -(-sum(map(len, ids.values())) // capacity) + 2
    packed = packing.pack_documents(docs, capacity=256, with_ids=True)
    full = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in full) == 4 * sum(map(len, ids.values()))
    one = full[0]
    assert all(bytes(one.ids)[4 * p.offset:][:4 * p.length] in ids[p.doc_id].tobytes() for p in one.parts)


def test_packing_of_repeated_rows_ties_and_nothing(spark):
    docs = spark.createDataFrame([(1, "same text")] * 40 + [(None, "no id")], "doc_id long, text string")
    got = packing.pack_documents(docs, capacity=10).collect()
    assert len(got) == 41 and len({(r.sequence_id, r.offset) for r in got}) == 41
    assert packing.pack_documents(docs.limit(0)).count() == 0


def best_fit_decreasing(lengths, capacity):
    import bisect
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i == len(gaps):
            n, gap = n + 1, capacity - x
        else:
            gap = gaps.pop(i) - x
        bisect.insort(gaps, gap)
    return n


def test_plan_is_close_to_sequential_best_fit():
    from collections import Counter
    rng = random.Random(2)
    for sizes in ([1], [2048], [700], [1024, 1025], list(range(1, 2049)), [683, 682, 684, 1366]):
        lengths = [rng.choice(sizes) for _ in range(3000)]
        runs = packing.plan(Counter(lengths), 2048)
        used = max(r[3] + r[2] - r[1] for r in runs)
        assert used <= 1.01 * best_fit_decreasing(lengths, 2048) + 2
        assert Counter({n: sum(r[2] - r[1] for r in runs if r[0] == n) for n in set(lengths)}) == Counter(lengths)
    assert packing.plan({}, 2048) == []
