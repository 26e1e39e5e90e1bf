"""Mixing sources to token targets by entropy balancing.

Documents carry their words as base mass. Of all masses that meet the word target of every source, the balanced ones
stay closest to the base in relative entropy: each is the base mass times ``exp(lambda)`` of the document's source. The
``lambda`` minimise a convex dual, ``sum(mass * exp(lambda)) - sum(target * lambda)``, by Newton iterations over the
table of (source, size) cells. The rates ``exp(lambda)`` are then rounded into copies: the cells of a
source are walked from the largest size to the smallest, and what rounding one cell leaves over is carried to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.tables import stored

# A word, the weights of sources in turn, the share of all words that is mixed, the most copies.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2

#: Documents of one source and size that are ranked together at most, on average.
CELL_DOCS = 4096
#: Newton iterations stop when every source is this close to its target, as a share of it.
CLOSE = 1e-10
ITERATIONS = 60

SOURCE = ["_null", "_src"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` of each source of ``sizes`` (``_null``, ``_src``, ``source_size``).

    Sources by code point, null last, take the weights in turn. Words are dealt by weight up to ``most`` times a
    source's own; sorted by the level at which they are full, the sources before the first that is not full are
    capped and the rest share what remains. The windows run over the table of sources, a row each.
    """
    every = Window.partitionBy()
    turn = F.row_number().over(Window.partitionBy().orderBy(*SOURCE)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    by_level = Window.partitionBy().orderBy(F.col("most") / F.col("weight"), *SOURCE)
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    open_level = F.min(F.when(F.col("most") / F.col("weight") > F.col("level"), F.struct(F.col("most") / F.col("weight"), *SOURCE, "level"))).over(every)
    return rows.select(
        *SOURCE, "source_size", F.coalesce(F.least("most", F.col("weight") * open_level["level"]), F.col("most")).alias("target")
    )


def balance(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``lambda``: Newton iterations on the dual, each one aggregation over the cells.

    The dual of a source is ``f = sum(n * size * exp(lambda)) - target * lambda``; its slope and curvature come from the
    same sum. A source without words or target keeps lambda null.
    """
    state = stored(wanted.withColumn("lambda", F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.lit(0.0))))
    for _ in range(ITERATIONS):
        mass = cells.join(state.select(*SOURCE, "lambda"), SOURCE).groupBy(*SOURCE).agg(F.sum(F.col("n") * F.col("size") * F.exp("lambda")).alias("mass"))
        slope = F.col("mass") - F.col("target")
        moved = state.join(mass, SOURCE, "left").withColumn("_off", F.abs(slope) / F.col("target"))
        state = stored(
            moved.withColumn("lambda", F.when(F.col("_off") > CLOSE, F.col("lambda") - slope / F.col("mass")).otherwise(F.col("lambda"))).drop("mass")
        )
        if (state.agg(F.max("_off")).first()[0] or 0.0) <= CLOSE:
            break
        state = state.drop("_off")
    return state.select(*SOURCE, "source_size", "target", "lambda")


def _round(group):
    """Copies of each cell of one source, largest size first, carrying what is left over."""
    import numpy as np

    group = group.sort_values(["size", "sub"], ascending=[False, True])
    rate = min(float(np.exp(group["lambda"].iloc[0])), float(MOST)) if group["lambda"].notna().iloc[0] else 0.0
    low, high = int(rate), int(np.ceil(rate))
    copies, left = [], 0.0
    for size, n in zip(group["size"].tolist(), group["n"].tolist(), strict=True):
        due = n * size * rate + left
        c = min(max(round(due / size), n * low), n * high) if size else round(n * rate)
        copies.append(c)
        left = due - c * size
    return group.assign(copies=copies)[[*SOURCE, "size", "sub", "n", "source_size", "target", "copies"]]


def mix(docs: DataFrame, keep: list[str], source: str = "source", text: str = "text") -> DataFrame:
    """``keep`` of every row with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` = size times copies.

    A null text has no words, and its document counts as a copy or none by the rate of its source. Null sources are
    one source. Ranks within a cell follow a hash of ``keep``, so reruns agree; equal rows are told apart by nothing.
    Cells with very many documents are split by that hash.
    """
    rows = stored(
        docs.select(
            *keep, F.col(source).isNull().alias("_null"), F.coalesce(F.col(source), F.lit("")).alias("_src"),
            word_count(F.col(text)).alias("size"), F.xxhash64(*[F.col(c) for c in keep]).alias("_hash"),
        )
    )
    cells = stored(rows.groupBy(*SOURCE, "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = cells.groupBy(*SOURCE).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = balance(cells, targets(sizes))
    parts = cells.select(*SOURCE, "size", F.ceil(F.col("n") / CELL_DOCS).alias("_parts"))
    dealt = rows.join(parts, [*SOURCE, "size"]).withColumn("sub", F.pmod(F.col("_hash"), F.col("_parts")))
    subs = dealt.groupBy(*SOURCE, "size", "sub").agg(F.count(F.lit(1)).alias("n"))
    schema = "_null boolean, _src string, size long, sub long, n long, source_size long, target double, copies long"
    # one group is the cells of a source: as many as it has different sizes, besides the parts of large cells
    rounded = subs.join(solved, SOURCE).groupBy(*SOURCE).applyInPandas(_round, schema)
    rank = F.row_number().over(Window.partitionBy(*SOURCE, "size", "sub").orderBy("_hash"))
    out = dealt.join(rounded, [*SOURCE, "size", "sub"]).withColumn("_rank", rank)
    extra = (F.col("_rank") <= F.col("copies") % F.col("n")).cast("long")
    return out.select(
        *keep, "size", "source_size", "target", (F.floor(F.col("copies") / F.col("n")) + extra).alias("copies")
    ).withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as it has copies."""
    key = F.xxhash64(*[F.col(c) for c in docs.columns])
    keyed = docs.withColumn("_key", key)
    copies = mix(keyed, ["_key"], source, text).groupBy("_key").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    # equal rows share their copies
    turn = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    shared = F.floor(F.col("_copies") / F.col("_rows")) + (turn <= F.col("_copies") % F.col("_rows")).cast("long")
    return (
        keyed.join(copies.where("_copies > 0"), "_key")
        .withColumn("_copies", shared)
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .select(*docs.columns)
    )
