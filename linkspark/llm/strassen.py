"""Hard negatives: exact integer products of anchor and candidate tiles by Strassen's recursion, and mergeable heaps.

Components become whole numbers. Candidates are packed into blocks where they lie, anchors into blocks by their id; every
anchor block meets every candidate block once, as the question asks for the best of all rows. A tile is multiplied by
Strassen's recursion (seven products of half the size in place of eight) on 64-bit integers, padded with zeros to sizes that
halve evenly; sums that wrap round cancel, so the products are exact as long as the scores themselves fit.

The first pass needs only anchors and candidates of the same label; each tile yields a heap of the best positives of
each anchor, and merged heaps give the positives. These fix windows of scores; in the second pass each tile yields, for
every anchor and positive, a heap of the best rows of other labels in the window, and these are merged in turn. A heap is
a few rows, merging keeps the best of several, on the map side first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.tables import stored

#: Components of a packed candidate block, anchors of an anchor block.
CELLS, ANCHORS = 1 << 18, 512
#: Lanes that candidate blocks are dealt over, at least, if there are as many; anchor blocks of a group.
LANES, GROUP = 24, 64
#: Least side of a tile that is split further.
LEAF = 16
SCALE = 256
#: Components beyond count as this; so they and their differences stay exact.
MOST = 1 << 53
_LEAST = np.iinfo(np.int64).min


def _strassen(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    depth -= 1
    out = np.empty((2 * m, 2 * n), np.int64)
    p = _strassen(a11 + a22, b11 + b22, depth)
    q = _strassen(a21 + a22, b11, depth)
    r = _strassen(a11, b12 - b22, depth)
    s = _strassen(a22, b21 - b11, depth)
    t = _strassen(a11 + a12, b22, depth)
    out[:m, :n] = p + s - t + _strassen(a12 - a22, b21 + b22, depth)
    out[:m, n:] = r + t
    out[m:, :n] = q + s
    out[m:, n:] = p - q + r + _strassen(a21 - a11, b11 + b12, depth)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer product of ``a`` (rows by components) and ``b`` (components by rows); scores that do not fit 64 bits are cut to them."""
    common = max(a.shape[1], b.shape[0])
    a = np.pad(a, ((0, 0), (0, common - a.shape[1])))
    b = np.pad(b, ((0, common - b.shape[0]), (0, 0)))
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    if common * _magnitude(a) * _magnitude(b) >= 1 << 63:
        top = (1 << 63) - 1
        return np.clip(a.astype(object) @ b.astype(object), -top, top).astype(np.int64)
    rows, columns = a.shape[0], b.shape[1]
    depth = 0
    while min(rows, common, columns) >> (depth + 1) >= LEAF:
        depth += 1
    unit = 1 << depth
    a = np.pad(a, ((0, -rows % unit), (0, -common % unit)))
    b = np.pad(b, ((0, -common % unit), (0, -columns % unit)))
    return _strassen(a, b, depth)[:rows, :columns]


def _magnitude(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()), 1)


def heap(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``size`` best allowed scores of each row, ties to the smaller id."""
    n = scores.shape[1]
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.empty(n, np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(n)
    if _magnitude(scores) >= (1 << 62) // n:  # too large for one number with the place
        pairs = []
        for row, ok in enumerate(allowed):
            some = np.flatnonzero(ok)
            pairs += [(row, c) for c in some[np.lexsort((place[some], -scores[row, some]))][:size].tolist()]
        return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)
    key = np.where(allowed, scores * n - place, _LEAST)
    best = np.argpartition(key, n - size, axis=1)[:, n - size :] if n > size else np.broadcast_to(np.arange(n), scores.shape)
    row = np.repeat(np.arange(len(best)), best.shape[1])
    best = best.ravel()
    real = key[row, best] != _LEAST
    return row[real], best[real]


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), "anchor")
    return named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))


def packed(rows: DataFrame, most_rows: int | None = None, extra: str | None = None) -> DataFrame:
    """Blocks of ``rows`` (``vec_id``, ``label``, ``vector``) as bytes, sorted by label and id, as they lie in their partitions.

    ``extra`` is a column of lists of scores that goes along.
    """
    names = ["vec_id", "label", "vector", *([extra] if extra else [])]
    schema = "n long, first long, ids binary, labels binary, vectors binary" + (", extra array<array<long>>" if extra else "")

    def block(ids, labels, flat, lengths, lists) -> pa.RecordBatch:
        width = max(int(lengths.max()), 1)
        vectors = np.zeros((len(ids), width), np.int64)
        with np.errstate(over="ignore"):
            vectors[np.arange(width) < lengths[:, None]] = np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64)
        by = np.lexsort((ids, labels))
        kind = np.int32 if _magnitude(vectors) < 1 << 31 else np.int64
        cells = [len(ids), int(ids.min()), ids[by].tobytes(), labels[by].tobytes(), np.append(np.int32(width), np.int32(kind == np.int64)).astype(np.int32).tobytes() + vectors[by].astype(kind).tobytes()]
        arrays = [pa.array([c]) for c in cells]
        if extra:
            arrays.append(pa.array([[lists[i] for i in by.tolist()]], pa.list_(pa.list_(pa.int64()))))
        return pa.RecordBatch.from_arrays(arrays, names=["n", "first", "ids", "labels", "vectors", *(["extra"] if extra else [])])

    def run(batches):
        held, cells = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                vector = batch.column(2).slice(at)
                lengths = np.diff(vector.offsets.to_numpy())
                room = np.searchsorted(np.cumsum(np.maximum(lengths, 1)), CELLS - cells, side="right")
                take = min(int(room), batch.num_rows - at, *([most_rows - sum(len(h[0]) for h in held)] if most_rows else []))
                if take < 1 and not held:
                    take = 1
                if take > 0:
                    part = batch.slice(at, take)
                    held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).flatten().to_numpy(), lengths[:take], part.column(3).to_pylist() if extra else []))
                    cells += int(np.maximum(lengths[:take], 1).sum())
                    at += take
                if at < batch.num_rows:
                    yield block(*joined(held))
                    held, cells = [], 0
        if held:
            yield block(*joined(held))

    def joined(held):
        columns = list(zip(*held, strict=True))
        return [*(np.concatenate(c) for c in columns[:4]), [x for c in columns[4] for x in c]]

    return rows.select(*names).mapInArrow(run, schema)


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[f"{side}_{c}"], np.int64) for c in ("ids", "labels"))
    width, wide = np.frombuffer(row[f"{side}_vectors"], np.int32, 2).tolist()
    vectors = np.frombuffer(row[f"{side}_vectors"], np.int64 if wide else np.int32, offset=8).reshape(-1, width)
    return ids, labels, vectors.astype(np.int64)


def tiles(anchors: DataFrame, candidates: DataFrame, lanes: int, groups: int = 1) -> DataFrame:
    """Every anchor block beside every candidate block.

    Candidate blocks are dealt over lanes, anchor blocks over groups, and each lane meets each group: anchor blocks go to every
    lane, candidate blocks to every group. Both are shuffled, as copies for all lanes are many times the table
    that Spark takes for small; the blocks of a group are held while those of the lane pass.
    """
    place = lambda n: F.pmod(F.xxhash64("first", "n", "ids"), F.lit(n))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], place(groups).alias("group"), every(lanes).alias("lane"))
    c = candidates.select(*[F.col(c).alias(f"c_{c}") for c in candidates.columns], place(lanes).alias("lane"), every(groups).alias("group"))
    return c.join(a.hint("merge"), ["lane", "group"])


def grid(blocks: int, rows: int, anchors: int) -> tuple[int, int]:
    """Lanes and groups for so many candidate blocks, candidates and anchors: lanes' copies of the anchors are as many rows as the candidates, about."""
    lanes = min(blocks, max(LANES, rows // max(1, anchors)))
    return max(1, lanes), max(1, -(-anchors // (ANCHORS * GROUP)))


def _tile_rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}


def best_positives(pairs: DataFrame, size: int) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``positive_score`` and ``slot``: the best other rows of each anchor's label."""

    def run(batches):
        for row in _tile_rows(batches):
            a, al, av = _unpacked(row, "a")
            c, cl, cv = _unpacked(row, "c")
            for label in np.intersect1d(al, cl).tolist():
                mine, theirs = (slice(*np.searchsorted(x, [label, label + 1])) for x in (al, cl))
                scores = product(av[mine], np.ascontiguousarray(cv[theirs].T))
                i, j = heap(scores, c[theirs], a[mine][:, None] != c[theirs][None, :], size)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[mine][i], c[theirs][j], scores[i, j])], names=["anchor_id", "positive_id", "positive_score"])

    heaps = pairs.mapInArrow(run, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return heaps.withColumn("slot", F.row_number().over(best)).where(F.col("slot") <= size)


def best_negatives(pairs: DataFrame, size: int, low: int, high: int) -> DataFrame:
    """The best rows of other labels whose score lies from ``low`` to ``high`` percent of a positive's score."""

    def run(batches):
        for row in _tile_rows(batches):
            a, al, av = _unpacked(row, "a")
            c, cl, cv = _unpacked(row, "c")
            scores = product(av, np.ascontiguousarray(cv.T))
            other = al[:, None] != cl[None, :]
            lists = row["a_extra"]
            for slot in range(max((len(x) for x in lists), default=0)):
                some = np.array([r for r, x in enumerate(lists) if len(x) > slot])
                score = [lists[r][slot] for r in some.tolist()]
                least = np.array([-(-low * s // 100) for s in score])[:, None]
                most = np.array([high * s // 100 for s in score])[:, None]
                inside = scores[some]
                i, j = heap(inside, c, other[some] & (inside >= least) & (inside <= most), size)
                columns = (a[some][i], np.full(len(i), slot + 1, np.int32), c[j], inside[i, j])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor_id", "slot", "negative_id", "negative_score"])

    heaps = pairs.mapInArrow(run, "anchor_id long, slot int, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score`` of ``rows``.

    ``rows`` have ``vec_id``, ``embedding`` and ``label``; other columns play no part, whatever their names. Where
    ``anchor`` holds, a row is an anchor; its positives are the ``positives`` best other rows of its label, and each
    is given the ``negatives`` best rows of other labels whose score lies within ``low`` to ``high`` percent of its own.
    Scores are inner products of whole numbers (``SCALE`` times a component, rounded down), ties go to the smaller id.
    Rows with a null id or label, a null vector, or null or non-finite components take no part; of vectors of
    different lengths the shorter are filled with zeros. Repeated rows each count as candidates, but never for an anchor
    of the same id; a repeated id is one anchor, by its least label and vector. Anchors without positives, and positives
    of negative score, have no negatives; an empty table gives no rows.
    """
    rows = usable(rows.select("vec_id", "embedding", "label", F.coalesce(anchor, F.lit(False)).alias("anchor")))
    candidates = stored(packed(rows))
    once = rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")
    anchors = stored(once)
    n_anchors = anchors.count()
    blocks = max(1, -(-n_anchors // ANCHORS))
    held = candidates.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    lanes, groups = grid(held.blocks, held.rows, n_anchors)
    first = stored(packed(anchors.repartition(blocks, "vec_id"), ANCHORS))
    found = stored(best_positives(tiles(first, candidates, lanes, groups), positives))
    listed = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("best"))
    known = anchors.join(listed, anchors["vec_id"] == listed["anchor_id"]).select("vec_id", "label", "vector", F.col("best.positive_score").alias("scores"))
    second = stored(packed(known.repartition(blocks, "vec_id"), ANCHORS, "scores"))
    ranked = best_negatives(tiles(second, candidates, lanes, groups), negatives, low, high)
    return ranked.join(found, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """SQL for the hard negatives of the table ``embeddings`` as the query asks for them."""
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS vec_id, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
