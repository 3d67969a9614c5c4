"""SentencePiece byte-pair encoding with seeded merge-dropout, and its decoding.

A text gets a space in front, and spaces become the piece mark.  No piece holds a mark after another
character, and none a newline, so a text is merged word by word (spaces and newlines, and what follows).  Merging keeps
an agenda of candidate merges, best score first and leftmost of equals; a candidate is skipped for good if a
hash of its place and length, keyed by the seed, the document's text and the number of the word in it, falls
below the dropout.  So every occurrence of a word draws anew, and the same seed always gives the same ids.
What is no piece in the end becomes bytes, and so does the mark itself where a text holds it: decoding gives
back every text.

Only skipped candidates that the agenda would have merged change anything.  A worker therefore remembers, for
each word, the merges that are made if nothing is skipped, and from there, for each first merge that is skipped,
those made without it, and so on: `Paths`.  An occurrence draws for the merges of its path alone.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

MARK = "▁"
DROPOUT = 0.1
SEED = 17
#: A worker remembers so many paths of words; when there are more, it starts anew (what is remembered changes no result).
REMEMBERED = 500_000
#: Words of so many characters are merged together, in arrays; longer ones one at a time.
SHORT = 24
#: Occurrences that draw together.
TOGETHER = 1 << 16
#: Texts are worked on in runs of about so many bytes, and ids in runs of as many.
SLICE = 4 << 20
#: No candidate begins here; where a rank stands in 64 bits; the bits below it, and those of a place.
_FAR = np.int64(1 << 16)
_ABOVE = 37
_BELOW = np.int64((1 << _ABOVE) - 1)
_PLACE = np.int64(31 << 32)
#: What a key is combined with, for each place << 6 | length.
_SPREAD = np.arange(32, dtype=np.uint64).repeat(64) * np.uint64(0x9E3779B1) + np.tile(np.arange(64, dtype=np.uint64), 32) * np.uint64(0x85EBCA77)



def drawn(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """What candidates (place << 6 | length) draw with these keys: 32 bits each."""
    with np.errstate(over="ignore"):
        return ((keys ^ _SPREAD[codes]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(29)) & np.uint64(0xFFFFFFFF)


_WORD = re.compile(r"[ \n]*[^ \n]+|[ \n]+$")


class Pieces:
    """The vocabulary of a SentencePiece model: ranks of pieces (0 is the best score), ids, and bytes of ids."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        plain = [k for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.ids = {model.id_to_piece(k): k for k in plain}
        order = sorted(plain, key=lambda k: -model.get_score(k))
        self.ranks = {model.id_to_piece(k): n for n, k in enumerate(order)}
        self.byte_ids = {int(model.id_to_piece(k)[3:-1], 16): k for k in range(size) if model.is_byte(k)}
        self.bytes = [b""] * size
        for piece, k in self.ids.items():
            self.bytes[k] = piece.replace(MARK, " ").encode()
        for b, k in self.byte_ids.items():
            self.bytes[k] = bytes([b])
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.byte_sizes = np.array(list(map(len, self.bytes)), np.int64)
        # Every way that a piece is made of two: left id << 15 | right id, with the piece's rank.
        pairs = sorted((self.ids[t[:c]] << 15 | self.ids[t[c:]], self.ranks[t]) for t, k in self.ids.items() for c in range(1, len(t)) if t[:c] in self.ids and t[c:] in self.ids)
        if size > 1 << 15:
            raise ValueError("a vocabulary of at most 32,768 pieces is needed")
        self.pairs, self.pair_ranks = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
        self.by_rank = np.array(order, np.int32)
        # Ids of single characters; for those that are no piece, and the mark itself, -2 less the code point.
        self.characters = -2 - np.arange(0x110000, dtype=np.int32)
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.characters[ord(piece)] = k
        self.characters[ord(" ")] = self.ids[MARK]
        self.characters[ord(MARK)] = -2 - ord(MARK)
        self.lengths = np.array([len(model.id_to_piece(k)) for k in range(size)], np.int64)

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of ids that stand one after another, `counts` for each text; the space in front goes."""
        sizes = self.byte_sizes[ids]
        data = _gathered(self.all_bytes, self.byte_sizes, ids)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        begins, ends = sums[ends - counts], sums[ends]
        keep = np.ones(len(data), bool)
        keep[begins[ends > begins]] = False
        offsets = np.concatenate([[0], np.cumsum(np.maximum(ends - begins - 1, 0))]).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])
        try:
            return found.cast(pa.string())
        except pa.ArrowInvalid:  # ids that no text gives
            return pa.array([x.as_py().decode("utf-8", "replace") for x in found], pa.string())

    def segment(self, word: str, dropout: float, key: int) -> list[int]:
        """Ids of one word (spaces in front stand for marks)."""
        ranks, limit = self.ranks, int(dropout * (1 << 32))
        # A mark in the text itself must not be taken for a space: it stays apart, as bytes.
        symbols = ["" if c == MARK else MARK if c == " " else c for c in word]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int]] = []

        def propose(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] and symbols[j]:
                rank = ranks.get(symbols[i] + symbols[j])
                if rank is not None:
                    length = len(symbols[i]) + len(symbols[j])
                    # Keyed hash of the place and length: a multiplicative mix of the word's own key.
                    if not limit or ((key ^ (i * 0x9E3779B1 + length * 0x85EBCA77)) * 0xC2B2AE3D27D4EB4F >> 29) & 0xFFFFFFFF >= limit:
                        heapq.heappush(agenda, (rank, i, length))

        for i in range(n - 1):
            propose(i)
        while agenda:
            _, i, length = heapq.heappop(agenda)
            j = after[i] if symbols[i] else n
            if j >= n or not symbols[j] or len(symbols[i]) + len(symbols[j]) != length:
                continue  # an older state
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            if before[i] >= 0 and symbols[before[i]]:
                propose(before[i])
            propose(i)
        out, i = [], 0
        while i < n:
            piece = symbols[i] or MARK
            if symbols[i] and (known := self.ids.get(piece)) is not None:
                out.append(known)
            else:
                out += [self.byte_ids[b] for b in piece.encode()]
            i = after[i]
        return out

    def merge_many(
        self, points: np.ndarray, begins: np.ndarray, sizes: np.ndarray, dropped: np.ndarray | None = None, keys: np.ndarray | None = None, limit: np.uint64 = np.uint64(0)
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some words (ranges of code points): all ids one after another, how many each word has, and the same of the
        merges made, in order (place << 6 | length).  Candidates in `dropped` (a row for each word) are skipped, and those
        that draw below the limit with the word's key.
        Each round merges, in every word, the best candidate; the columns after it move up."""
        width = int(sizes.max())
        column = np.arange(width)
        # A symbol, above it its place, above that the rank of the candidate that begins there: the least of a row is
        # the best candidate, leftmost of equals.
        symbols = np.where(column < sizes[:, None], points[np.minimum(begins[:, None] + column, len(points) - 1)], np.int32(-1))
        state = _FAR << _ABOVE | column.astype(np.int64) << 32 | symbols.view(np.uint32).astype(np.int64)

        def propose(r: np.ndarray, c: np.ndarray) -> None:
            """Ranks of the candidates that begin at columns c of rows r."""
            plain = state[r, c] & _BELOW
            left, right = plain.astype(np.int32), state[r, c + 1].astype(np.int32)
            pair = np.where((left >= 0) & (right >= 0), left << 15 | right, np.int32(-1))
            found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            there = self.pairs[found] == pair
            if dropped is not None or keys is not None:
                code = (plain >> 32) << 6 | self.lengths[np.maximum(left, 0)] + self.lengths[np.maximum(right, 0)]
                there &= (dropped[rows[r]] != code[:, None]).all(axis=1) if keys is None else drawn(keys[rows[r]], code) >= limit
            state[r, c] = np.where(there, self.pair_ranks[found], _FAR) << _ABOVE | plain

        out, rows = np.full((len(sizes), width), np.int32(-1)), np.arange(len(sizes))
        steps, turn = np.zeros((len(sizes), max(0, width - 1)), np.int16), 0
        propose(*np.nonzero(column[:-1] < sizes[:, None] - 1))
        while len(rows):
            best = state.argmin(axis=1)
            ranks = state[np.arange(len(rows)), best] >> _ABOVE
            on = ranks < _FAR
            out[rows[~on], : state.shape[1]] = state[~on].astype(np.int32)
            rows, state, best = rows[on], state[on], best[on]
            if not len(rows):
                break
            each = np.arange(len(rows))
            merged = self.by_rank[ranks[on]]
            place = state[each, best] & _PLACE
            steps[rows, turn] = place >> 32 << 6 | self.lengths[merged]
            turn += 1
            state[each, best] = place | merged | _FAR << _ABOVE
            # What comes after a merged pair moves up by one column.
            state = state[np.arange(state.shape[1]) != best[:, None] + 1].reshape(len(rows), state.shape[1] - 1)
            inner, after = best < state.shape[1] - 1, best > 0
            propose(np.concatenate([each[inner], each[after]]), np.concatenate([best[inner], best[after] - 1]))
        there, made = out != -1, steps > 0
        ids, counts = out[there], there.sum(axis=1)
        if (ids < 0).any():
            ids, counts = self._with_bytes(ids, counts)
        return ids, counts, steps[made], made.sum(axis=1)

    def merged(self, words: list[str], dropped: np.ndarray | None = None, keys: np.ndarray | None = None, limit: np.uint64 = np.uint64(0)) -> Iterator[tuple[np.ndarray, ...]]:
        """`merge_many` of words of like length, so that little is padded; the words' numbers come first."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = self.characters[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), 4096):
            rows = order[at : at + 4096]
            yield rows, *self.merge_many(points, begins[rows], sizes[rows], None if dropped is None else dropped[rows], None if keys is None else keys[rows], limit)

    def _with_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the byte ids of characters that are no piece."""
        owner = np.repeat(np.arange(len(counts)), counts)
        odd = np.nonzero(ids < 0)[0]
        kinds, which = np.unique(ids[odd], return_inverse=True)
        coded = [[self.byte_ids[b] for b in chr(-2 - int(c)).encode("utf-8", "surrogatepass")] for c in kinds]
        times = np.ones(len(ids), np.int64)
        times[odd] = np.array([len(c) for c in coded])[which]
        spread = np.repeat(ids, times)
        starts = (np.cumsum(times) - times)[odd]
        for k, c in enumerate(coded):
            for j, b in enumerate(c):
                spread[starts[which == k] + j] = b
        return spread, np.bincount(owner, weights=times, minlength=len(counts)).astype(np.int64)


@cache
def pieces(path: str) -> Pieces:
    """One vocabulary for each Python worker."""
    return Pieces(path)


class _Pool:
    """An array that grows."""

    def __init__(self, kind: type) -> None:
        self._data, self.size = np.zeros(1024, kind), 0

    @property
    def data(self) -> np.ndarray:
        return self._data[: self.size]

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self._data):
            self._data = np.concatenate([self.data, np.zeros(max(end, 2 * len(self._data)) - self.size, self._data.dtype)])
        self._data[self.size : end] = more
        self.size = end


class Paths:
    """Segmentations of short words.  A path is a word and candidates that are skipped: it has the ids that come out,
    and the merges still to be drawn for (those made after the last skipped one, in order)."""

    def __init__(self, vocabulary: Pieces) -> None:
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.roots: dict[str, int] = {}
        self.branches: dict[int, int] = {}  # path << 5 | number of the merge that is skipped: the path without it
        self.words: list[str] = []
        self.skipped: list[tuple[int, ...]] = []
        self.ids, self.merges = _Pool(np.int32), _Pool(np.int16)
        self.first_id, self.n_ids, self.first_merge, self.n_merges, self.n_done = (_Pool(np.int64) for _ in range(5))

    def _add(self, words: list[str], skipped: list[tuple[int, ...]], done: np.ndarray) -> np.ndarray:
        """New paths; `done` merges of each are no longer to be drawn for."""
        first = len(self.words)
        self.words += words
        self.skipped += skipped
        most = max(map(len, skipped), default=0)
        dropped = np.array([[*s, *[-1] * (most - len(s))] for s in skipped], np.int64) if most else None
        places = [np.zeros(len(words), np.int64) for _ in range(4)]
        for rows, ids, n_ids, merges, n_merges in self.vocabulary.merged(words, dropped=dropped):
            for place, what in zip(places, (self.ids.size + np.cumsum(n_ids) - n_ids, n_ids, self.merges.size + np.cumsum(n_merges) - n_merges + done[rows], n_merges - done[rows]), strict=True):
                place[rows] = what
            self.ids.add(ids)
            self.merges.add(merges)
        for pool, place in zip((self.first_id, self.n_ids, self.first_merge, self.n_merges), places, strict=True):
            pool.add(place)
        self.n_done.add(done)
        return np.arange(first, len(self.words))

    def of_words(self, words: list[str]) -> np.ndarray:
        """The paths of distinct words that skip nothing."""
        found = list(map(self.roots.get, words))
        gaps = [k for k, x in enumerate(found) if x is None]
        new = [words[k] for k in gaps]
        made = self._add(new, [()] * len(new), np.zeros(len(new), np.int64)).tolist()
        self.roots.update(zip(new, made, strict=True))
        for k, x in zip(gaps, made, strict=True):
            found[k] = x
        return np.array(found, np.int64)

    def without(self, path: np.ndarray, merge: np.ndarray) -> np.ndarray:
        """For each path the one that skips the merge of this number as well."""
        keys, which = np.unique(path << 5 | merge, return_inverse=True)
        listed = keys.tolist()
        found = list(map(self.branches.get, listed))
        gaps = [k for k, x in enumerate(found) if x is None]
        if gaps:
            path, merge = keys[gaps] >> 5, keys[gaps] & 31
            codes = self.merges.data[self.first_merge.data[path] + merge].tolist()
            before = [self.skipped[p] for p in path.tolist()]
            # Merges made before the skipped one are made again, and were drawn for.
            done = self.n_done.data[path] + merge
            made = self._add([self.words[p] for p in path.tolist()], [(*s, c) for s, c in zip(before, codes, strict=True)], done).tolist()
            for k, x in zip(gaps, made, strict=True):
                found[k] = self.branches[listed[k]] = x
        return np.array(found, np.int64)[which]

    def draw(self, path: np.ndarray, keys: np.ndarray, limit: np.uint64) -> np.ndarray:
        """The paths that occurrences with these keys end at."""
        path, left = path.copy(), np.arange(len(path))
        while len(left := left[self.n_merges.data[path[left]] > 0]):
            hits, which_merge = [], []
            for at in range(0, len(left), TOGETHER):
                part = left[at : at + TOGETHER]
                own = path[part]
                number = self.n_merges.data[own]
                begins = np.cumsum(number) - number
                which = np.repeat(np.arange(len(own)), number)
                code = self.merges.data[np.arange(len(which)) + (self.first_merge.data[own] - begins)[which]]
                hit = np.nonzero(drawn(keys[part][which], code) < limit)[0]
                owner = which[hit]
                first = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(hit)]  # the first merge that is skipped
                hits.append(part[owner[first]])
                which_merge.append((hit - begins[owner])[first])
            left = np.concatenate(hits)
            path[left] = self.without(path[left], np.concatenate(which_merge))
        return path


class Encoder:
    """Encodes texts; paths of words are made once and remembered."""

    def __init__(self, path: str, dropout: float, seed: int) -> None:
        self.vocabulary, self.dropout, self.seed = pieces(path), dropout, seed
        self.paths = Paths(self.vocabulary)

    @staticmethod
    def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of some texts, and how many each text has."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        words, counts = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
        empty = (pc.binary_length(words).to_numpy() == 0).astype(np.int64)
        ends = np.cumsum(counts)
        sums = np.concatenate([[0], np.cumsum(empty)])
        uneven = np.nonzero(sums[ends] > sums[ends - counts])[0]
        if not len(uneven):
            return words, counts
        # Texts with spaces in a row, or at an end, are parted by the pattern, their words with all spaces before them.
        parts, at = [], 0
        for k in uneven.tolist():
            text = texts[k].as_py()
            own = _WORD.findall(" " + text) if text else []
            first = int(ends[k] - counts[k])
            parts += [words.slice(at, first - at), pa.array(own, pa.string())]
            at, counts[k] = int(ends[k]), len(own)
        return pa.concat_arrays([*parts, words.slice(at)]), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls, one after another, and how many each text has."""
        words, counts = self._split(texts)
        coded = words.dictionary_encode()
        # Words come without the space before them, but for those that begin with a space or newline.
        distinct = [w if w[0] in " \n" else " " + w for w in coded.dictionary.to_pylist()]
        which = coded.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(counts)
        keys = self.keys(texts, counts)
        if len(self.paths.words) > REMEMBERED:
            self.paths.forget()
        limit = np.uint64(int(self.dropout * (1 << 32)))
        # 0: one at a time, as it is long; 1: met once here and not remembered, merged with its own draws; 2: by paths.
        kind = np.where(np.bincount(which, minlength=len(distinct)) > 1, 2, 1)
        kind[[k for k in np.nonzero(kind == 1)[0].tolist() if distinct[k] in self.paths.roots]] = 2
        kind[np.fromiter(map(len, distinct), np.int64, len(distinct)) > SHORT] = 0
        path = np.full(len(distinct), -1)
        path[kind == 2] = self.paths.of_words([distinct[k] for k in np.nonzero(kind == 2)[0].tolist()])
        long, once, near = (np.nonzero(kind[which] == k)[0] for k in range(3))
        chosen = path[which[near]]
        if limit:
            chosen = self.paths.draw(chosen, keys[near], limit)
        first, sizes = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        first[near], sizes[near] = self.paths.first_id.data[chosen], self.paths.n_ids.data[chosen]
        data, size = [self.paths.ids.data], self.paths.ids.size
        for rows, ids, n_ids, *_ in self.vocabulary.merged([distinct[k] for k in which[once].tolist()], keys=keys[once] if limit else None, limit=limit):
            first[once[rows]], sizes[once[rows]] = size + np.cumsum(n_ids) - n_ids, n_ids
            data.append(ids)
            size += len(ids)
        for k in long.tolist():
            data.append(np.array(self.vocabulary.segment(distinct[which[k]], self.dropout, int(keys[k])), np.int32))
            first[k], sizes[k] = size, len(data[-1])
            size += len(data[-1])
        place = np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return np.concatenate(data)[place], sums[ends] - sums[ends - counts]

    def keys(self, texts: pa.Array, counts: np.ndarray) -> np.ndarray:
        """A key for every word of texts: its number, keyed by seed and text."""
        own = np.fromiter((xxhash.xxh64_intdigest(t.encode(), self.seed) | 1 for t in texts.to_pylist()), np.uint64, len(texts))
        number = np.arange(1, int(counts.sum()) + 1, dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            mixed = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) * np.repeat(own, counts)
            return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _gathered(data: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of runs of `sizes` that stand one after another in `data`, the chosen ones one after another."""
    width = sizes[chosen]
    begins = (np.cumsum(sizes) - sizes)[chosen]
    return data[np.arange(int(width.sum())) + np.repeat(begins - (np.cumsum(width) - width), width)]


@cache
def encoder(path: str, dropout: float, seed: int) -> Encoder:
    """One for each Python worker, so that what it knows outlasts a task."""
    return Encoder(path, dropout, seed)


def encode(text: Column, model: str, dropout: float = DROPOUT, seed: int = SEED) -> Column:
    """array<int>: piece ids of a text; none for null and empty texts.  `model` is a path every executor can read."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        run = encoder(model, dropout, seed).encode
        found = [run(part) for part in slices(pc.fill_null(texts.cast(pa.string()), ""), SLICE)]
        counts = np.concatenate([np.empty(0, np.int64), *(n for _, n in found)])
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *(x for x, _ in found)])))

    return ids(text)


def decode(ids: Column, model: str) -> Column:
    """The text of piece ids: the pieces' bytes, without the space put in front.  Null ids give an empty text."""

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        ids = ids.cast(pa.list_(pa.int32()))
        counts = pc.fill_null(ids.value_lengths(), 0).to_numpy().astype(np.int64)
        flat, known = ids.flatten().to_numpy(), pieces(model)
        ends = np.cumsum(counts)
        starts, parts, k = ends - counts, [pa.array([], pa.string())], 0
        while k < len(ids):  # some ids at a time, at least one text's
            j = max(k + 1, int(np.searchsorted(ends, starts[k] + SLICE, "right")))
            parts.append(known.texts(flat[starts[k] : ends[j - 1]], counts[k:j]))
            k = j
        return pa.concat_arrays(parts)

    return texts(ids)


def encode_documents(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", **options: float) -> DataFrame:
    """`docs` with the column `ids_col` of piece ids; a column of that name is replaced."""
    return docs.withColumn(ids_col, encode(F.col(text_col), model, **options))
