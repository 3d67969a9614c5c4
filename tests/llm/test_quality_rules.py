from tessera.llm import quality_rules as Q


def test_held_out_accuracy_on_whole_table(spark):
    from tessera.llm.queries import op4_quality_rules

    sf_dir = "/root/testdata/sf0.01"
    rows = op4_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_paths_of_a_tree():
    described = "DecisionTree\n  If (feature 1 <= 0.5)\n   Predict: 0.0\n  Else (feature 1 > 0.5)\n   If (feature 0 <= 2.0)\n    Predict: 1.0\n   Else (feature 0 > 2.0)\n    Predict: 0.0\n"
    low, high = (1, True, 0.5), (1, False, 0.5)
    assert Q.tree_paths(described) == {(low,), (high,), ((0, True, 2.0), high), ((0, False, 2.0), high)}


def test_statistics(spark):
    rows = [(1, None), (2, ""), (3, "Aa Aa b !! 7"), (4, "x" * 100_000), (5, "one line\none line\nother.")]
    found = {r.doc_id: r._stats for r in Q.with_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found[1]) == {0.0} == set(found[2])
    three = found[3]
    assert (three.repeat_share, three.distinct_share, three.lone_mark_share) == (1 / 5, 4 / 5, 1 / 5)
    assert three.upper_share == 2 / 12 and three.digit_share == 1 / 12
    assert found[5].line_share == 2 / 3 and found[5].stop_share == 1 / 5


def test_too_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (7, 5)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.classify(docs, labels).collect())
    assert {r.score for r in Q.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.classify(docs.limit(0), labels).count() == 0


def plain_statistics(text):
    import math

    import regex

    text = text or ""
    words, lines = [w for w in regex.split(r"[ \t\n\x0B\f\r]+", text) if w], [x for x in text.split("\n") if x]
    space = r"[ \t\n\x0B\f\r]"
    count = lambda p: len(regex.findall(p.replace(r"\s", space[1:-1]), text))
    share = lambda a, b: a / b if b else 0.0
    whole = regex.split(space, text)
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    lone = sum(bool(regex.fullmatch(r"[^\p{L}\p{N}]+", w)) for w in whole if w)
    return [
        math.log1p(len(text)), math.log1p(len(words)), share(len(text), len(words)), share(count(r"\p{Lu}"), len(text)), share(count(r"\p{Nd}"), len(text)),
        share(count(r"[^\p{L}\p{N}\s]"), len(text)), share(lone, len(words)), share(repeated, len(words)), share(len(set(words)), len(words)),
        share(len(set(lines)), len(lines)), share(sum(w[-1] in ".!?" for w in words), len(words)),
    ]


def test_scores_as_from_the_rules_in_plain_python(spark):
    import math

    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rules = Q.fit(docs.where(~Q.held_out()), labels.where(~Q.held_out()))
    assert rules.rules
    rows = Q.with_statistics(docs).select("text", "_stats", rules.score().alias("score")).collect()
    for r in rows:
        stats = plain_statistics(r.text)
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(stats, r._stats)), (r.text[:80], stats, r._stats)
        total = rules.intercept + sum(w for rule, w in rules.rules if all((r._stats[k] <= at) == low for k, low, at in rule))
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), abs_tol=1e-12)


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "w", "c", "l", "s", "old")], "doc_id long, text string, _words string, _chars string, _lines string, _stats string, Score string")
    row = Q.classify(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).first()
    assert (row._words, row._chars, row._lines, row._stats) == ("w", "c", "l", "s") and 0 <= row.score <= 1
