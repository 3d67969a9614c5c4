"""Document fingerprints by winnowing, in DataFrame functions alone.

The k-grams of a text are runs of `K` code points, A-Z in lower case.  Their hashes are polynomials of the hashes of
`UNIT` code points, as rolling hashes are: no k-gram is hashed anew, but the hash of 2 m code points is made of those
of m and the m after them, for all positions at once.  Of every `WINDOW` neighbouring k-grams the one with the least
hash is chosen, the rightmost of equals, and kept with its position; so two texts that share WINDOW + K - 1
code points in a row share a chosen k-gram, whatever their script.  Hash and position stand in one long (hash above,
inverted position below), whose plain minimum is the rule; minima over windows are built by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Powers of two.
K = 16
WINDOW = 32
UNIT = 4
#: A text that has so many code points before a place tells all windows that end before it.
CONTEXT = K + WINDOW - 2
PRIME = (1 << 31) - 1
BASE = 1_000_003
#: No string has more bytes than positions that fit.
POSITION_BITS = 31
LAST = (1 << POSITION_BITS) - 1
#: Documents are dealt into at most so many ranges of ids, and their bounds come from so many ids for each.
RANGES = 16384
IDS_PER_RANGE = 50

_UPPER, _LOWER = ("".join(chr(c + k) for k in range(26)) for c in (65, 97))


def with_winnows(df: DataFrame, text: str, out: str, offset: str = "0") -> DataFrame:
    """`df` with `out`: the chosen k-grams of a text (SQL) in order, each hash << POSITION_BITS | LAST - position.

    A text of fewer than K code points is one k-gram; a null or empty text has none.  `offset` (SQL) is added to positions.
    """
    grams = f"_{out}_grams"
    # Four bytes for each code point, so that any of them is found at once; a lambda's variable, so that it is made once.
    points = f"encode(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), 'UTF-32')"
    hashed = f"transform(array({points}), b -> transform(sequence(0, greatest(length(b) div 4 - {UNIT}, 0)), i -> pmod(xxhash64(substring(b, i * 4 + 1, {4 * UNIT})), {PRIME}L)))[0]"
    df = df.withColumn(grams, F.expr(hashed))
    step, factor = UNIT, BASE
    while step < K:
        df = df.withColumn(grams, F.expr(f"zip_with({grams}, {_from(grams, step)}, (a, b) -> (a * {factor}L + b) % {PRIME}L)"))
        step, factor = 2 * step, factor * factor % PRIME
    short = f"array(pmod(xxhash64(encode(translate({text}, '{_UPPER}', '{_LOWER}'), 'UTF-8')), {PRIME}L))"
    whole = f"CASE WHEN length({text}) >= {K} THEN slice({grams}, 1, length({text}) - {K - 1}) WHEN length({text}) > 0 THEN {short} ELSE array() END"
    packed = f"transform({whole}, (h, i) -> shiftleft(h, {POSITION_BITS}) | ({LAST}L - i - {offset}))"
    df = df.withColumn(grams, F.expr(packed))
    step = 1
    while step < WINDOW:  # the minimum from each position on over `step` grams, then over twice as many
        df = df.withColumn(grams, F.expr(f"zip_with({grams}, {_from(grams, step)}, (a, b) -> least(a, b))"))
        step *= 2
    windows = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - (WINDOW - 1), F.lit(1)))
    return df.withColumn(out, F.array_distinct(windows)).drop(grams)


def _from(array: str, step: int) -> str:
    """What stands `step` places further on."""
    return f"slice({array}, {step + 1}, greatest(size({array}) - {step}, 0))"


def _position(p: str) -> str:
    return f"({LAST}L - ({p} & {LAST}L))"


def chosen_before(winnows: str, end: str) -> Column:
    """Of the chosen k-grams of a text those that its first `end` code points (SQL, more than CONTEXT) tell.

    What the last of their windows chose is the least of the k-grams that it holds, and earlier windows chose none
    that stands after that.
    """
    last = f"array_min(filter({winnows}, p -> {_position('p')} BETWEEN {end} - {CONTEXT + 1} AND {end} - {K}))"
    return F.expr(f"transform(array({last}), m -> filter({winnows}, p -> {_position('p')} <= {_position('m')}))[0]")


def printed(winnows: str) -> Column:
    """position:hash of each chosen k-gram, space-joined."""
    return F.expr(f"array_join(transform({winnows}, p -> concat({_position('p')}, ':', lower(hex(shiftright(p, {POSITION_BITS}))))), ' ')")


def _hashes(winnows: str) -> Column:
    return F.expr(f"array_distinct(transform({winnows}, p -> shiftright(p, {POSITION_BITS})))")


def likeness(a: str, b: str) -> Column:
    """Chosen hashes that two texts share, to those that either has; 1 if neither has any."""
    both = F.size(F.array_intersect(_hashes(a), _hashes(b)))
    either = F.size(F.array_union(_hashes(a), _hashes(b)))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def _ranges(docs: DataFrame) -> DataFrame:
    """`docs` (id, text) with `part`: the number of the range of ids that holds the row, null ids in the lowest.

    The bounds are ids of a sample of bounded size; they decide only how evenly the rows are dealt.
    """
    spark = docs.sparkSession
    wanted = min(RANGES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("id").where("id IS NOT NULL")
    share = min(1.0, wanted * IDS_PER_RANGE / max(1, ids.count()))
    hashed = F.pmod(F.xxhash64(F.lit("bound"), "id"), F.lit(1_000_000_000))
    sample = sorted({r.id for r in ids.where(hashed < int(share * 1_000_000_000)).collect()})
    bounds = sample[:: max(1, len(sample) // wanted)][1:]
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return docs.withColumn("part", F.lit(0))
    # Binary search: how many bounds are not above the id.
    found = F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda low, step: low + F.when((low + step <= len(bounds)) & (F.try_element_at(F.lit(bounds), low + step) <= F.col("id")), step).otherwise(0),
    )
    return docs.withColumn("part", F.coalesce(found, F.lit(0)))


def with_next(docs: DataFrame) -> DataFrame:
    """`docs` (id, text) with winnows, next_text and next_winnows of the next row by descending id; after the
    last comes the first.  Equal ids go by descending text, null ids last.

    Ids are dealt into ranges; each range also gets, at its end, a copy of the row that begins the next one,
    so that every row has its successor beside it.
    """
    ranged = _ranges(docs)
    heads = ranged.groupBy("part").agg(F.max("id").alias("id"))  # at most RANGES rows
    before = Window.orderBy(F.desc("part"))
    heads = heads.select("part", "id", F.lag("part").over(before).alias("to"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("lowest"))
    heads = F.broadcast(heads.select("part", F.col("id").alias("head"), F.coalesce("to", "lowest").alias("to")))
    first = ranged.join(heads, (ranged["part"] == heads["part"]) & ranged["id"].eqNullSafe(heads["head"]))
    first = first.groupBy("to", "id").agg(F.max("text").alias("text")).select("id", "text", F.col("to").alias("part"), F.lit(True).alias("copy"))
    dealt = ranged.select("id", "text", "part", F.lit(False).alias("copy")).unionAll(first).repartition("part")
    order = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("id"), F.desc("text"))
    beside = with_winnows(dealt, "text", "winnows").withColumns({"next_text": F.lead("text").over(order), "next_winnows": F.lead("winnows").over(order)})
    return beside.where(~F.col("copy"))


def edit_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text is the text with its last third (rounded down, in code points) replaced by the start of the
    next document, by descending id.  Null texts count as empty; an empty text has an empty fingerprint.
    Columns: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Every
    row gives one row; other columns are ignored.
    """
    rows = with_next(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("third", F.expr("CAST(n_chars div 3 AS INT)"))
    rows = rows.withColumn("stays", F.expr("CAST(n_chars AS INT) - third")).withColumn("put", F.expr("left(next_text, third)"))
    # Only windows that reach beyond what stays are new: they lie in the last CONTEXT code points of it and what is put there.
    rows = rows.withColumns({
        "edited_sha256": F.expr("sha2(concat(left(text, stays), put), 256)"),
        "begin": F.expr(f"greatest(stays - {CONTEXT}, 0)"),
        "tail": F.expr(f"concat(right(left(text, stays), least(stays, {CONTEXT})), put)"),
    }).drop("text", "next_text")
    rows = with_winnows(rows, "tail", "tail_winnows", "begin")
    rows = rows.withColumn(
        "edited_winnows",
        F.when(F.col("begin") == 0, F.col("tail_winnows"))
        .when(F.col("put") == "", chosen_before("winnows", "stays"))
        .otherwise(F.array_union(chosen_before("winnows", "stays"), "tail_winnows")),
    )
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        printed("winnows").alias("fingerprint"),
        printed("edited_winnows").alias("edited_fingerprint"),
        likeness("winnows", "edited_winnows").alias("near_edited"),
        likeness("winnows", "next_winnows").alias("near_next"),
    )
