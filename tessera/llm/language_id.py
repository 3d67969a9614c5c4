"""Language identification by word-first backoff.

A word that the model knows counts with its log frequency in each language.  An unseen word falls back to
its character n-grams, five characters first and then ever fewer, until some n-gram is known.  The language
with the greatest sum wins, and the score is its share of the likelihood.

The model is fitted on a bounded sample of labelled rows (about `train_docs` of each language, so that frequent
languages crowd no rare one out); counting is done by Spark.  The model holds every word and n-gram that the
sample has at least `least` times, all languages together.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, slices

TRAIN_DOCS = 1000
LEAST = 2
LONGEST = 5
UNKNOWN = "und"
#: Tokens that a worker remembers; it starts anew when there are more.
REMEMBERED = 400_000
#: New tokens that are worked on together, and bytes of text.
TOGETHER = 20_000
SLICE = 4 << 20

_RUNS = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    """Runs of letters.  The pattern takes other numerals (fractions, Roman ones) for letters: alone they are no word."""
    found = _RUNS.findall(text)
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """tables[n]: the n-grams (n = 0: words), each with its row of figures[n]: a log likelihood for each of `languages`."""

    def __init__(self, languages: list[str], grams: list[list[str]], figures: list[np.ndarray]) -> None:
        self.languages, self.figures = languages, figures
        self.tables = [{g: k for k, g in enumerate(own)} for own in grams]

    def word(self, word: str) -> tuple[float, ...]:
        """A known word's own figures, or the mean of its longest known n-grams'."""
        if (known := self.tables[0].get(word)) is not None:
            return tuple(self.figures[0][known].tolist())
        for n in range(LONGEST, 0, -1):
            get = self.tables[n].get
            if known := [x for x in map(get, _grams(word, n)) if x is not None]:
                return tuple(self.figures[n][known].mean(axis=0).tolist())
        return (0.0,) * len(self.languages)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, least: int = LEAST) -> Model:
    """Counts words and n-grams of a sample of about `train_docs` of the labelled rows of each language, picked by a
    hash of the id.  The model has a column for each language."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = dict(rows.groupBy("lang").count().collect())  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], [[] for _ in range(LONGEST + 1)], [np.zeros((0, 0))] * (LONGEST + 1))
    most = 1 << 60
    below = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, train_docs / n) * most))])
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(most)) < below[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            words: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), pc.utf8_lower(b.column(1)).to_pylist(), strict=True):
                words.update((lang, w) for w in _words(text))
            for (lang, word), k in words.items():
                found[lang, 0, word] += k
                for n in range(1, LONGEST + 1):
                    for g in _grams(word, n):
                        found[lang, n, g] += k
            lang, n, gram = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(gram, pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "n", "gram", "k"])

    counted = picked.select("lang", "text").mapInArrow(count, "lang string, n int, gram string, k long")
    each = counted.groupBy("n", "gram").agg(*[F.sum(F.when(F.col("lang") == x, F.col("k")).otherwise(0)).alias(f"k{i}") for i, x in enumerate(languages)])
    kept = each.where(reduce(lambda a, b: a + b, [F.col(f"k{i}") for i in range(len(languages))]) >= least).orderBy("n", "gram").toArrow()  # of the sample alone
    numbers = np.stack([kept[f"k{i}"].to_numpy() for i in range(len(languages))], axis=1).astype(np.float64)
    grams, figures = [], []
    for n in range(LONGEST + 1):
        own = kept["n"].to_numpy() == n
        grams.append(kept["gram"].filter(pa.array(own)).to_pylist())
        k = numbers[own]
        logs = np.log((k + 0.5) / (k.sum(axis=0) + 0.5 * max(1, len(k))))
        figures.append(logs - logs.max(axis=1, keepdims=True) if len(k) else logs)  # only differences between languages count
    return Model(languages, grams, figures)


def _gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n code points."""
    found = np.zeros(max(0, len(points) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            found = (found ^ points[k : k + len(found)]) * np.uint64(0x9E3779B97F4A7C15)
            found ^= found >> np.uint64(29)
    return found


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Scorer:
    """Sums of texts' words.  The figures of a token (what stands between spaces) are made once and remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.width = model, len(model.languages)
        self.grams = []
        for n in range(1, LONGEST + 1):  # of each length: sorted hashes, and figures in the same order
            hashes = _gram_hashes(_points("".join(model.tables[n])), n)[::n]
            order = np.argsort(hashes)
            self.grams.append((hashes[order], model.figures[n][order]))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((4096, self.width + 1))

    def words(self, words: list[str]) -> np.ndarray:
        """Figures of words, each as the model gives them one at a time."""
        get = self.model.tables[0].get
        given = list(map(get, words))
        out = np.zeros((len(words), self.width))
        there = [k for k, x in enumerate(given) if x is not None]
        out[there] = self.model.figures[0][[given[k] for k in there]].reshape(len(there), self.width)
        unseen = np.array([k for k, x in enumerate(given) if x is None], np.int64)
        for n in range(LONGEST, 0, -1):
            if not len(unseen):
                break
            own = [words[k] for k in unseen.tolist()]
            points = _points("".join(own) if n == 1 else "^" + "$^".join(own) + "$")
            sizes = np.fromiter(map(len, own), np.int64, len(own)) + (0 if n == 1 else 2)
            owner = np.repeat(np.arange(len(own)), sizes)[: max(0, len(points) - n + 1)]
            hashes, (known, figures) = _gram_hashes(points, n), self.grams[n - 1]
            if not len(known):
                continue
            within = np.arange(len(owner)) + n <= np.cumsum(sizes)[owner]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.nonzero(within & (known[at] == hashes))[0]
            number = np.bincount(owner[hit], minlength=len(own))
            done = number > 0
            for k in range(self.width):
                sums = np.bincount(owner[hit], figures[at[hit], k], len(own))
                out[unseen[done], k] = sums[done] / number[done]
            unseen = unseen[~done]
        return out

    def learn(self, tokens: list[str]) -> None:
        if len(self.known) + len(tokens) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(self.rows) + len(tokens), self.width + 1))])
        for k in range(0, len(tokens), TOGETHER):
            part = tokens[k : k + TOGETHER]
            split = list(map(_words, part))
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            figures = self.words([w for own in split for w in own])
            owner, first = np.repeat(np.arange(len(part)), sizes), len(self.known)
            for c in range(self.width):
                self.rows[first : first + len(part), c] = np.bincount(owner, figures[:, c], len(part))
            self.rows[first : first + len(part), -1] = sizes
            self.known.update(zip(part, range(first, first + len(part))))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts without nulls: the number of the language, -1 for none, and the score."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        self.learn([t for t in distinct if t not in self.known])
        row = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        sums = np.stack([np.bincount(owner, self.rows[row, c], len(texts)) for c in range(self.width + 1)], axis=1)
        none = sums[:, -1] == 0
        if not self.width:
            return np.full(len(texts), -1), np.zeros(len(texts))
        best = sums[:, :-1].argmax(axis=1)
        share = 1 / np.exp(sums[:, :-1] - sums[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return np.where(none, -1, best), np.where(none, 0.0, share)


class _Shared:
    """A broadcast model; equal for lru_cache if the name is."""

    def __init__(self, name: str, model: Broadcast) -> None:
        self.name, self.model = name, model

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Shared) and other.name == self.name

    @property
    def value(self) -> Model:
        return self.model.value


@lru_cache(maxsize=1)
def _scorer(shared: _Shared) -> Scorer:
    """One scorer of the last model for each Python worker, so that what it knows outlasts a task."""
    return Scorer(shared.value)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """struct<lang, score> for the text of each row; `und` and 0 if it is null or has no letter."""
    shared = _Shared(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model))  # grows with the sample alone

    @F.arrow_udf("struct<lang: string, score: double>")
    def language(texts: pa.Array) -> pa.Array:
        scorer = _scorer(shared)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        found = [scorer.score(part) for part in slices(texts, SLICE)]
        best, share = (np.concatenate([np.empty(0, kind), *x]) for kind, x in zip((np.int64, np.float64), zip(*found) if found else ((), ())))
        names = np.array([*scorer.model.languages, UNKNOWN], object)[best]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(share)], ["lang", "score"])

    # So marked, it is not run once more for each filter on what it gives.
    return language.asNondeterministic()(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """`docs` with held_out, lang_pred and score, by a model fitted on its rows that are not held out.

    Null and empty texts and texts without letters are `und` with score 0, as is everything if there is nothing
    to learn from.  Rows with a null id count as held out.  Columns of these names are replaced.
    """
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col, id_col, **bounds)
    found = fresh("found", docs)
    out = docs.withColumns({"held_out": held_out(id_col), found: predict(docs, model, text_col)})
    return out.withColumns({"lang_pred": F.col(found)["lang"], "score": F.col(found)["score"]}).drop(found)
