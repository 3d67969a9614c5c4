import random
import zlib

import numpy as np
import pytest

from tessera.llm import packing as K

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def check_pieces(rows, texts):
    """Every id in one piece, sequences gapless and within capacity; returns the padding."""
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for name, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[name], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_query_on_whole_table(spark, sf_dir):
    from tessera.llm.queries import op10_packing

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_packing(spark, sf_dir).collect()
    assert check_pieces(rows, texts) < 0.02 * sum(r.length for r in rows)


def test_odd_texts(spark):
    odd = [None, "", " ", "\n", "a  b", " a\n\nb ", "tab\tx", "<|endoftext|> x", "it's\nI'm 12 a's", "é ü x", "x" * 5000, "a b", "end\n", "w " * 3000]
    texts = dict(enumerate(odd))
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, start long")
    check_pieces(K.pack(docs, PATH).collect(), texts)
    assert K.pack(docs.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x")], "doc_id long, text string")
    assert K.pack(twice, PATH).count() == 3


@pytest.mark.parametrize("seed", range(5))
def test_differencing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 256) for _ in range(rng.randint(1, 700))]
    windows = K.differencing(sizes, 1024)
    assert sorted(k for w in windows for k in w) == list(range(len(sizes)))
    sums = [sum(sizes[k] for k in w) for w in windows]
    assert max(sums) <= 1024
    least = -(-sum(sizes) // 1024)
    assert len(windows) <= least + 1 + least // 50
    if len(sizes) > 50:
        assert max(sums) - min(sums) < 30
