from tessera.llm import language_id as L


def model_of(languages, tables):
    """A model of {gram: figures} for each length."""
    return L.Model(languages, [list(t) for t in tables], [L.np.array(list(t.values()), float).reshape(len(t), len(languages)) for t in tables])


def test_held_out_accuracy_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = L.identify(docs.withColumnRenamed("n_chars", "score_")).where("held_out AND lang IS NOT NULL").collect()
    assert rows
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_cases(spark):
    rows = [(k, "der hund und die katze", "de") for k in range(20)] + [(k + 20, "the dog and the cat", "en") for k in range(20)]
    rows += [(50, None, "de"), (51, "", None), (52, "12 34 !!", None), (54, "½ Ⅷ ²", None), (None, "der hund", None), (53, "hunden", None), (53, "thee", "x" * 3)]
    found = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.text): r for r in found}
    for key in ((50, None), (51, ""), (52, "12 34 !!"), (54, "½ Ⅷ ²")):
        assert (by[key].lang_pred, by[key].score) == ("und", 0.0)
    assert by[None, "der hund"].lang_pred == "de" and by[None, "der hund"].held_out
    assert by[53, "hunden"].lang_pred == "de"


def test_backoff_uses_longest_known_gram():
    tables = [{} for _ in range(6)]
    tables[3]["abc"], tables[3]["bc$"], tables[1]["a"] = (0.0, -1.0), (0.0, -3.0), (-1.0, 0.0)
    model = model_of(["x", "y"], tables)
    assert model.word("abc") == (0.0, -2.0)
    assert model.word("a") == (-1.0, 0.0)
    assert model.word("qq") == (0.0, 0.0)
    tables[0]["abc"] = (-5.0, 0.0)
    model = model_of(["x", "y"], tables)
    assert model.word("abc") == (-5.0, 0.0)


def test_words_together_as_one_by_one():
    import random

    rng = random.Random(3)
    draw = lambda most: "".join(rng.choice("abcde") for _ in range(rng.randint(1, most)))
    words = [draw(9) for _ in range(400)]
    tables = [{} for _ in range(6)]
    tables[0] = {w: (rng.random(), rng.random()) for w in words[:40]}
    for w in words[40:70]:
        for n in range(1, 6):
            for g in L._grams(w, n)[:1]:
                tables[n][g] = (rng.random(), rng.random())
    model = model_of(["x", "y"], tables)
    scorer = L.Scorer(model)
    for w, figures in zip(words, scorer.words(words)):
        assert figures.tolist() == L.np.array(model.word(w)).tolist() or abs(figures - L.np.array(model.word(w))).max() < 1e-12
    texts = ["", "1 2", " ".join(words[:50]), words[0] + "-" + words[1] + "  " + words[2], words[60]]
    best, share = scorer.score(L.pa.array(texts))
    assert best[:2].tolist() == [-1, -1] and share[:2].tolist() == [0, 0]
    for k in (2, 3, 4):
        sums = L.np.sum([model.word(w) for w in L._words(texts[k])], axis=0)
        assert best[k] == sums.argmax()
        assert abs(share[k] - 1 / L.np.exp(sums - sums.max()).sum()) < 1e-9


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.identify(docs).collect()] == [("und", 0.0)]
    assert L.identify(docs.limit(0)).count() == 0


def test_fit_as_counted_plainly(spark):
    import math
    from collections import Counter

    rows = [(k, t, lang) for k, (t, lang) in enumerate([("Der Hund, der Hund bellt", "de"), ("le chien; le CHAT", "fr"), ("the dog the end", "en"), ("hund hund", "de"), ("ein", None), (None, "fr"), ("Ünder ½ hund", "fr")])]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    counts = [Counter() for _ in range(6)]
    for _, text, lang in rows:
        for word in L._words((text or "").lower()) if lang else ():
            for n in range(6):
                counts[n].update((lang, g) for g in ([word] if n == 0 else L._grams(word, n)))
    assert model.languages == ["de", "en", "fr"]
    for n in range(6):
        sums = Counter()
        for (_, g), k in counts[n].items():
            sums[g] += k
        kept = {g for g, k in sums.items() if k >= L.LEAST}
        assert set(model.tables[n]) == kept
        for g in kept:
            logs = [math.log((counts[n][x, g] + 0.5) / (sum(counts[n][x, h] for h in kept) + 0.5 * len(kept))) for x in model.languages]
            assert max(abs(a - b + max(logs)) for a, b in zip(model.figures[n][model.tables[n][g]], logs)) < 1e-12


def test_a_rare_language_keeps_its_words(spark):
    rows = [(k, f"common{k % 50} words of this text {k}", "en") for k in range(3000)] + [(5000 + k, "sjaldan orðin koma", "is") for k in range(4)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=100)
    assert "sjaldan" in model.tables[0] and "orðin" in model.tables[0]


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "der hund", "de", "mine", "x", "y")], "doc_id long, text string, lang string, _found string, score string, __found string")
    row = L.identify(docs).first()
    assert (row._found, row["__found"]) == ("mine", "y") and 0 <= row.score <= 1
