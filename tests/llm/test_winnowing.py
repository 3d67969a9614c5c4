from hashlib import sha256

import pytest
import xxhash

from tessera.llm import winnowing as W


def signed_mod(h):
    return (h - (1 << 64) if h >> 63 else h) % W.PRIME


def plain_winnow(text):
    """[(position, hash)] by the definition: a hash that rolls over the code points, then one window after another."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    hashes, places = [], W.K // W.UNIT
    if 0 < len(text) < W.K:
        hashes = [signed_mod(xxhash.xxh64_intdigest(text.encode(), 42))]
    else:
        units = [signed_mod(xxhash.xxh64_intdigest(text[i : i + W.UNIT].encode("utf-32-be"), 42)) for i in range(len(text) - W.UNIT + 1)]
        for i in range(len(text) - W.K + 1):
            if i < W.UNIT:
                h = 0
                for k in range(places):
                    h = (h * W.BASE + units[i + k * W.UNIT]) % W.PRIME
            else:  # the first unit goes, another comes
                h = ((hashes[i - W.UNIT] - units[i - W.UNIT] * pow(W.BASE, places - 1, W.PRIME)) * W.BASE + units[i + W.K - W.UNIT]) % W.PRIME
            hashes.append(h)
    chosen = []
    for i in range(max(1, len(hashes) - W.WINDOW + 1) if hashes else 0):
        window = hashes[i : i + W.WINDOW]
        at = i + max(k for k, h in enumerate(window) if h == min(window))
        if (at, hashes[at]) not in chosen:
            chosen.append((at, hashes[at]))
    return chosen


def plain_rows(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] if d[0] is not None else 0, d[1] or ""), reverse=True)
    for k, (name, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        own, other, after = map(plain_winnow, (text, edited, following))

        def like(a, b):
            a, b = {h for _, h in a}, {h for _, h in b}
            return len(a & b) / len(a | b) if a | b else 1.0

        yield (name, len(text), sha256(edited.encode()).hexdigest(), *(" ".join(f"{p}:{h:x}" for p, h in x) for x in (own, other)), like(own, other), like(own, after))


def test_matches_definition_on_whole_table(spark, sf_dir):
    from tessera.llm.queries import op9_winnowing

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op9_winnowing(spark, sf_dir).collect())) == sorted(plain_rows(docs))


@pytest.mark.parametrize("docs", [
    [(5, "one"), (5, "two words"), (5, None), (None, "a b c d e f"), (7, ""), (9, "ä Ö ÜB " * 40), (2, "x " * 3000), (3, "Ab😀İΣς" * 30), (4, "q" * 15), (6, "語" * 16), (8, "0123456789" * 7 + "z"), (10, "The quick brown fox jumps over the lazy dog, again and again and once more"), (9, "same same")],
    [(1, "alone with itself here and there")],
    [(3, None), (2, "")],
])
def test_cases(spark, docs):
    rows = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, part int")
    assert sorted(map(tuple, W.edit_and_compare(rows).collect()), key=str) == sorted(plain_rows(docs), key=str)


def test_shared_run_shares_a_gram_and_empty_table(spark):
    shared = "".join(chr(0x4E00 + 7 * i) for i in range(W.WINDOW + W.K - 1))
    docs = [(1, "一" * 40 + shared + "丁" * 3), (2, "x" * 50 + shared + "y" * 9)]
    rows = W.edit_and_compare(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.near_next > 0 for r in rows)
    assert W.edit_and_compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edited_texts_of_every_length(spark):
    docs = [(k, "".join(chr(97 + (k * k + 3 * i * i + i // 7) % 26) for i in range(k))) for k in range(150)]
    rows = spark.createDataFrame([*docs, (200, "")], "doc_id long, text string")
    assert sorted(map(tuple, W.edit_and_compare(rows).collect())) == sorted(plain_rows([*docs, (200, "")]))
