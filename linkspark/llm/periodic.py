"""Periodic runs of words, found with longest common extensions over a difference cover.

A run is a stretch of words that repeats with a period, twice at least. For a period ``q`` every such stretch holds two
neighbouring points of the grid 0, q, 2q, ...; there are ``n / q`` of them, ``n log n`` for all periods. Where the words at two
neighbouring points are equal, the extensions to the right and to the left tell how far the period reaches.

An extension is answered from few suffixes: those that start at places of a difference cover (modulo ``MODULUS``, the
differences of ``COVER`` are all residues). For any two places a shift below ``MODULUS`` leads both to such suffixes; the
words up to there are compared, and the rest is the least common prefix between two ranks of the sorted suffixes, from
a sparse table. Words are numbered exactly, no hashes are compared. All texts of a slice are handled at once, suffixes of
different texts never meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkspark.llm.tables import small_batches, text_slices

LEAST = 12
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Pairs of grid points looked at together, and runs gathered before equal ones are merged.
PAIRS, GATHERED = 1 << 18, 1 << 20

_IN_COVER = np.full(MODULUS, -1)
_IN_COVER[list(COVER)] = np.arange(len(COVER))
#: Least shift that leads two residues into the cover.
_SHIFT = np.array(
    [[next(k for k in range(MODULUS) if _IN_COVER[(a + k) % MODULUS] >= 0 and _IN_COVER[(b + k) % MODULUS] >= 0) for b in range(MODULUS)] for a in range(MODULUS)]
)

Words = list[bytes]


class Extensions:
    """Longest common extensions to the right within one text of several.

    ``word`` holds the numbers of all words, each text followed by a number of its own; ``text`` tells the text.
    """

    def __init__(self, word: np.ndarray, text: np.ndarray):
        self.word = word
        places = np.arange(len(word))
        sampled = places[_IN_COVER[places % MODULUS] >= 0]
        padded = np.concatenate([word, np.full(MODULUS, -1)])
        n, step = len(sampled), len(COVER)
        # names of the first MODULUS words, tied suffixes are sorted by one word more
        order = np.lexsort((padded[sampled], text[sampled]))
        heads = _changes(text[sampled[order]], padded[sampled[order]])
        rank = np.empty(n, np.int64)
        rank[order] = _group_starts(heads)
        tied = _tied(heads)
        for i in range(1, MODULUS):
            tied = _refine(order, rank, tied, padded[sampled + i])
        # the suffix MODULUS words further on is sampled too: sorted depth doubles
        levels, reach = [rank.copy()], step
        while len(tied):
            further = np.full(n, -1)
            further[: max(0, n - reach)] = rank[reach:]
            tied = _refine(order, rank, tied, further)
            levels.append(rank.copy())
            reach *= 2
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.table = [self._neighbours(order, sampled, text, padded, levels)]
        width = 1
        while 2 * width <= n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _neighbours(order, sampled, text, padded, levels) -> np.ndarray:
        """Words that each sorted suffix has in common with the one before it."""
        n, step = len(order), len(COVER)
        common = np.zeros(n, np.int64)
        live = np.flatnonzero(text[sampled[order[1:]]] == text[sampled[order[:-1]]]) + 1
        a, b = order[live - 1], order[live]
        for t in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < n
            same = np.zeros(len(a), bool)
            same[inside] = levels[t][a[inside]] == levels[t][b[inside]]
            a, b = a + same * (step << t), b + same * (step << t)
            common[live] += same * (MODULUS << t)
        open_ = np.flatnonzero(np.maximum(a, b) < n)
        i, j = sampled[a[open_]], sampled[b[open_]]
        for k in range(MODULUS):
            same = padded[i + k] == padded[j + k]
            open_, i, j = open_[same], i[same], j[same]
            common[live[open_]] += 1
        return common

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, places of the same text, ``i < j``."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for k in range(MODULUS):
            arrived = shift[live] == k
            done = live[arrived]
            if len(done):
                out[done] = k + self._sampled(i[done] + k, j[done] + k)
                live = live[~arrived]
            if not len(live):
                break
            same = self.word[i[live] + k] == self.word[j[live] + k]
            out[live[~same]] = k
            live = live[same]
        return out

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = (self.rank[p // MODULUS * len(COVER) + _IN_COVER[p % MODULUS]] for p in (i, j))
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for t in np.unique(level).tolist():
            at = np.flatnonzero(level == t)
            out[at] = np.minimum(self.table[t][low[at]], self.table[t][high[at] - (1 << t)])
        return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _group_starts(heads: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))


def _tied(heads: np.ndarray) -> np.ndarray:
    """Places in groups of two and more."""
    return np.flatnonzero(~heads | ~np.append(heads[1:], True))


def _refine(order: np.ndarray, rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sort the places ``tied`` of ``order`` within their groups by ``key``; returns the places that are still tied."""
    if not len(tied):
        return tied
    who = order[tied]
    by = np.lexsort((key[who], rank[who]))
    who = who[by]
    heads = _changes(rank[who], key[who])
    order[tied] = who
    rank[who] = tied[_group_starts(heads)]
    return tied[_tied(heads)]


def grid(sizes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points and periods of the grids of all periods; ``sizes`` fall, so the texts of two periods come first."""
    most = int(sizes[0]) // 2 if len(sizes) else 0
    periods = np.arange(1, most + 1)
    reach = offsets[np.searchsorted(-sizes, -2 * periods, side="right")]
    counts = np.maximum(0, -(-(reach - periods) // periods))
    total = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < most:
        end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        q = np.repeat(periods[at:end], counts[at:end])
        yield (np.arange(len(q)) - np.repeat(total[at:end] - total[at], counts[at:end])) * q, q
        at = end


def maximal_runs(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Start, length and smallest period of every run of each text (numbers of words), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    by = np.argsort(-sizes, kind="stable")
    sizes = sizes[by]
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    if not len(sizes) or sizes[0] < least:
        return [np.zeros((0, 3), np.int64) for _ in texts]
    word = np.concatenate([x for k, t in enumerate(by.tolist()) for x in (texts[t], [-2 - k])]).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    right = left = None
    found, pending = [np.zeros((0, 3), np.int64)], 0
    for i, q in grid(sizes, offsets):
        equal = word[i] == word[i + q]
        i, q = i[equal], q[equal]
        j = i + q
        inside = text[i] == text[j]
        i, j, q = i[inside], j[inside], q[inside]
        if not len(i):
            continue
        if right is None:
            right, left = Extensions(word, text), Extensions(np.append(word[::-1], -1), np.append(text[::-1], -1))
        end = j + right(i, j)
        start = i - left(len(word) - 1 - j, len(word) - 1 - i) + 1
        # a grid point before this one, in the same stretch, has found it already
        first = (start > i - q) & (end - start >= np.maximum(least, 2 * q))
        found.append(np.stack([start[first], end[first], q[first]], axis=1))
        pending += len(found[-1])
        if pending > GATHERED:
            found, pending = [_smallest(np.concatenate(found))], 0
    runs = _smallest(np.concatenate(found))
    where = text[runs[:, 0]]
    bounds = np.searchsorted(where, np.arange(len(sizes) + 1))
    out: list = [None] * len(texts)
    for k, t in enumerate(by.tolist()):
        mine = runs[bounds[k] : bounds[k + 1]]
        mine = np.stack([mine[:, 0] - offsets[k], mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)
        out[t] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    return out


def _smallest(runs: np.ndarray) -> np.ndarray:
    """A stretch found with several periods has the smallest; the others are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[_changes(runs[:, 0], runs[:, 1])]


def collapsed(parts: Words, runs: np.ndarray) -> bytes:
    """The words without those that a run repeats."""
    change = np.zeros(len(parts) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] <= 0).tolist()
    return b" ".join([parts[k] for k in kept])


def find(
    docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST, change: Callable[[object, Words], Words] | None = None
) -> DataFrame:
    """Columns ``keep`` of ``docs``, ``n_words``, ``runs`` (array of ``start, length, period`` in words) and ``collapsed``.

    Runs have ``least`` words and two periods at least and stand by start, then period; ``collapsed`` is the text
    without the words that a run repeats, joined by single spaces. ``change`` gets the first column of ``keep`` and the
    words and returns the words to look at. Null, empty and wordless texts have no words and no runs and collapse to
    an empty text. Rows stand for themselves: repeated ids and texts are handled alike, null ids too. A very long text
    is one slice of its own, with about 100 bytes of memory a word. Other columns of ``docs`` play no part; names in
    ``keep`` must differ from the three new ones.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    added = StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    out = StructType([*kept.schema[: len(keep)], *added])
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def words_of(content: bytes, key) -> Words:
        parts = content.split()
        return parts if change is None else change(key, parts)

    def handle(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, end, data, offsets in text_slices(batch.column(len(keep))):
                spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                numbers: dict[bytes, int] = {}
                texts = []
                for row, (a, b) in enumerate(spans, first):
                    parts = words_of(data[a:b].tobytes(), keys[row])
                    texts.append(np.array([numbers.setdefault(w, len(numbers)) for w in parts], np.int64))
                runs = maximal_runs(texts, least)
                rest = [collapsed(words_of(data[a:b].tobytes(), keys[row]), r) for row, ((a, b), r) in enumerate(zip(spans, runs, strict=True), first)]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                every = np.concatenate(runs)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(every.T)], fields=list(run_type)))
                arrays = [batch.column(c).slice(first, end - first) for c in range(len(keep))]
                arrays += [pa.array([len(t) for t in texts], pa.int64()), lists, pa.array(rest, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return kept.mapInArrow(handle, out)


def planted(doc_id, parts: Words) -> Words:
    """Every tenth document, by the checksum of its id, gets a run: from a word on, its words go round with a period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(parts), h // 10
    if h % 10 or not n:
        return parts
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return parts[:a] + [parts[a + i % p] for i in range(n - a)]


def digests(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of runs, the greatest run, and digests of all runs and of the collapsed text, from :func:`find`.

    The greatest run is the longest, then the first, then the one of the smallest period; without runs it is null.
    """
    def order(r: Column) -> Column:
        return F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))

    best = found.withColumn("_best", F.array_max(F.transform("runs", order)))
    length, period = F.col("_best.length"), -F.col("_best.p")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * _best.length div -_best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
