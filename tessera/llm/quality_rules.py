"""Quality classifier: a sparse ensemble of rules over text statistics.

A random forest of shallow trees is grown on a bounded sample of labelled rows.  Every path from a root is a
conjunctive rule; a logistic regression with a lasso penalty weighs the rules and drops most; the rules that
are left are compiled into one Spark column expression, so that scoring is plain SQL over the statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved

TRAIN_ROWS = 4000
TREES = 20
DEPTH = 3
LASSO = 0.002
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "mark_share", "lone_mark_share", "repeat_share", "distinct_share", "line_share",
    "stop_share",
)

Condition = tuple[int, bool, float]  # statistic, at most (or else above), threshold


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with a struct column _stats of doubles; null counts as empty, and shares of nothing are 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / F.greatest(whole, F.lit(1.0))).otherwise(0.0)

    docs = docs.withColumns({
        "_words": F.filter(F.split(text, r"\s+"), lambda w: w != ""),
        "_chars": F.length(text).cast("double"),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x != ""),
    })
    words = F.size("_words").cast("double")
    one = {
        "log_chars": F.log1p("_chars"),
        "log_words": F.log1p(words),
        "word_length": share(F.col("_chars"), words),
        "upper_share": share(count(r"\p{Lu}"), F.col("_chars")),
        "digit_share": share(count(r"\p{Nd}"), F.col("_chars")),
        "mark_share": share(count(r"[^\p{L}\p{N}\s]"), F.col("_chars")),
        "lone_mark_share": share(count(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)"), words),
        "repeat_share": share(count(r"(?<!\S)(\S++)(?=\s+\1(?!\S))"), words),
        "distinct_share": share(F.size(F.array_distinct("_words")).cast("double"), words),
        "line_share": share(F.size(F.array_distinct("_lines")).cast("double"), F.size("_lines").cast("double")),
        "stop_share": share(count(r"[.!?](?!\S)"), words),
    }
    return docs.withColumn("_stats", F.struct(*[one[n].alias(n) for n in STATISTICS])).drop("_words", "_chars", "_lines")


@dataclass
class Rules:
    """An intercept, and rules with their weights."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self) -> Column:
        """The probability of label 1, over the column _stats."""
        total = reduce(lambda s, r: s + F.when(holds(r[0]), r[1]).otherwise(0.0), self.rules, F.lit(self.intercept))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def holds(rule: tuple[Condition, ...]) -> Column:
    parts = [F.col(f"_stats.{STATISTICS[k]}") <= at if low else F.col(f"_stats.{STATISTICS[k]}") > at for k, low, at in rule]
    return reduce(lambda a, b: a & b, parts)


def tree_paths(described: str) -> set[tuple[Condition, ...]]:
    """All paths of a forest from its description, a line for each side of a split and indented by depth."""
    found: set[tuple[Condition, ...]] = set()
    path: list[tuple[int, Condition]] = []
    for line in described.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line):
            depth = len(m[1])
            path = [x for x in path if x[0] < depth] + [(depth, (int(m[2]), m[3] == "<=", float(m[4])))]
            found.add(tuple(sorted(c for _, c in path)))
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Rules:
    """Rules learnt from about `train_rows` of the labelled rows, picked by a hash of the id."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
    share, most = min(1.0, train_rows / max(1, known.count())), 1 << 60
    known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(most)) < int(share * most)).groupBy("_id").agg(F.max("_label").alias("_label"))
    # The sample of labels has a bounded number of rows.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    rows = with_statistics(rows, "text").select("_id", "_label", "_stats")
    rows = saved(rows, "labelled").coalesce(4).orderBy("_id", "_stats")
    counts = dict(rows.groupBy("_label").count().collect())
    if len(counts) < 2:
        return Rules(0.0 if not counts else 3.0 if 1.0 in counts else -3.0, [])
    given = rows.select("_label", array_to_vector(F.array(*[f"_stats.{n}" for n in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(labelCol="_label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, featureSubsetStrategy="all", subsamplingRate=0.5, seed=7).fit(given)
    paths = sorted(set().union(*(tree_paths(t.toDebugString) for t in forest.trees)))
    if not paths:
        return Rules(3.0 if counts[1.0] > counts[0.0] else -3.0, [])
    ruled = rows.select("_label", array_to_vector(F.array(*[holds(p).cast("double") for p in paths])).alias("features"))
    ruled = saved(ruled, "ruled").coalesce(1)
    model = LogisticRegression(labelCol="_label", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(ruled)
    return Rules(float(model.intercept), [(p, float(w)) for p, w in zip(paths, model.coefficients.toArray(), strict=True) if w])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves remainder 0 by 5; null ids are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **bounds: int) -> DataFrame:
    """`docs` with held_out, score and predicted (1 at THRESHOLD or more), by rules fitted on rows that are not held out.

    Every row is scored, null and empty texts as texts of no words.  Columns of these names are replaced.
    Labels other than 0 and 1 are left out, and of labels of one id the greatest counts.
    """
    rules = fit(docs.where(~held_out(id_col)), labels.where(~held_out(id_col)), id_col, text_col, label_col, **bounds)
    # The caller's columns travel in one struct, so that none of theirs has the name of one of ours.
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    scored = with_statistics(rows, "text").withColumn("score", rules.score())
    scored = scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    return scored.select(*own, "held_out", "score", "predicted")
