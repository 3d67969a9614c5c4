"""The pipeline's stages against plain versions that work on lists of rows."""

import re

import corpus_pipeline as C
from tests.llm.test_packing import check_pieces
from tests.llm.test_secret_scan import plain_base
from tests.llm.test_simhash import plain_components, plain_fingerprint


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    done = [docs]
    for _, stage in C.STAGES:
        done.append(C.saved(stage(spark, done[-1], sf_dir), "test"))
    assert all(d.columns == columns for d in done[:-1])
    start, known, single, cut, clean = map(by_id, done[:-1])

    assert known.keys() == {k for k, r in start.items() if re.search(r"[^\W\d_]", r.text or "")}
    right = [r.lang == start[k].lang for k, r in known.items() if start[k].lang]
    assert sum(right) >= 0.95 * len(right)

    rows = [(k, plain_fingerprint(r.text)) for k, r in known.items()]
    assert single.keys() == {k for (k, _), low in zip(rows, plain_components(rows)) if k == low}

    gone = 0
    for k, r in single.items():
        words = r.text.split()
        left = cut[k].text.split() if k in cut else []
        gone += len(words) - len(left)
        it = iter(words)
        assert all(w in it for w in left)  # only words taken out, in order
        if len(left) < len(words):
            assert len(words) - len(left) >= 50
    grams = {}
    for k, r in sorted(cut.items()):
        words = r.text.lower().encode().split()
        for i in range(len(words) - 49):
            assert grams.setdefault(tuple(words[i : i + 50]), k) == k  # no passage of 50 words in two documents
    for k, r in clean.items():
        assert r.n_chars == len(r.text) and not [s for s in plain_base(r.text) if s[0] == "hex"]
        if not plain_base(cut[k].text):
            assert r.text == cut[k].text or "[secret]" in r.text
    assert clean.keys() == cut.keys()
    check_pieces(done[-1].collect(), {k: r.text for k, r in clean.items()})


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words of text", None, "s", 1), (3, "some words of text", None, "s", 1), (None, "more words", "en", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in C.STAGES:
            frame = C.saved(stage(spark, frame, ""), "test")
        frame.collect()
