"""Exact quantiles of whole columns, and ranks, without gathering a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of one round of selection, and of one level of ranks; powers of two.
BUCKETS, RANK_BUCKETS = 4096, 256
#: Rows of a range above which ranks split it again. It grows with the table, so that there are at most so many ranges
#: that their sizes are a small table.
RANGE_ROWS, MOST_RANGES = 100_000, 65_536

Wanted = dict[str, tuple[Column | str, list[float]]]


def quantile_row(df: DataFrame, wanted: Wanted, also: list[Column] | None = None, rounds: int = 1) -> DataFrame:
    """One row: for each name of ``wanted`` (a column and probabilities) its interpolated quantiles, and aggregates ``also``.

    All columns are selected together. A sketch of every column, made in the pass that computes ``also``, gives the edges
    of ``BUCKETS`` ranges; counts of these tell which ranges hold wanted ranks, and only the values of those go on, first
    merged where equal. Each further round divides the ranges that are left in the same way, so a task sorts the
    different values of one range: about one in ``BUCKETS`` to the power of ``rounds``. The edges steer the work, the
    result is exact. NULLs and NaNs are left out; a column without values has NULL quantiles.
    """
    names = list(wanted)
    values = [(F.col(c) if isinstance(c, str) else c).cast("double") for c, _ in wanted.values()]
    values = [F.when(~F.isnan(v), v) for v in values]
    first = df.agg(F.array(*[_edges(v, BUCKETS) for v in values]).alias("__edges"), *(also or [])).select(F.struct("*").alias("s")).scalar()

    # a row for every column, with the edges of its ranges
    single = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), v.alias("v")) for i, v in enumerate(values)]))
    rows = df.select(single.alias("x")).select("x.*").where("v IS NOT NULL").withColumns(
        {"c": F.lit(1).cast("bigint"), "path": F.lit("").cast("string"), "start": F.lit(0).cast("bigint")}
    )
    located = rows.withColumn("__all", first["__edges"]).withColumn("__e", F.get("__all", F.col("m")))
    located = located.withColumn("b", bucket_of(F.col("__e"), F.col("v"), BUCKETS)).drop("__all", "__e")
    probabilities = F.array(*[F.array(*[F.lit(float(p)) for p in ps]) for _, ps in wanted.values()])
    found = None
    for step in range(rounds):
        if step:
            edges = found.groupBy("m", "path").agg(_edges(F.col("v"), BUCKETS).alias("__e"))
            located = found.join(F.broadcast(edges), ["m", "path"]).withColumn("b", bucket_of(F.col("__e"), F.col("v"), BUCKETS))
        # a bounded table from here to ``holding``
        sizes = located.groupBy("m", "path", "start", "b").agg(F.sum("c").alias("n"))
        ordered = Window.partitionBy("m").orderBy("start", "b")
        before = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if step:
            ordered = Window.partitionBy("m", "path").orderBy("b")
            before = F.col("start") + F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            total = F.col("total")
            sizes = sizes.join(F.broadcast(totals), "m")
        else:
            total = F.sum("n").over(Window.partitionBy("m"))
        starts = sizes.select("m", "path", "b", "n", before.alias("from"), total.alias("total"))
        inside = lambda r: (r >= F.col("from")) & (r < F.col("from") + F.col("n"))
        position = lambda p: p * (F.col("total") - 1)
        asked = F.get(probabilities, F.col("m"))
        holding = starts.where(F.exists(asked, lambda p: inside(F.floor(position(p))) | inside(F.ceil(position(p)))))
        if not step:
            totals = holding.groupBy("m").agg(F.max("total").alias("total"))
        kept = located.select("m", "path", "b", "v", "c").join(F.broadcast(holding.select("m", "path", "b", "from", "total")), ["m", "path", "b"])
        path = F.concat_ws("/", "path", F.col("b").cast("string"))
        found = kept.groupBy("m", path.alias("path"), F.col("from").alias("start"), "total", "v").agg(F.sum("c").alias("c"))

    among = Window.partitionBy("m", "path").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.withColumn("first", F.col("start") + F.coalesce(F.sum("c").over(among), F.lit(0)))
    here = lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("c"))
    picks = []
    for i, name in enumerate(names):
        for j, p in enumerate(wanted[name][1]):
            at = float(p) * (F.col("total") - 1)
            of = F.col("m") == i
            picks += [F.max(F.when(of & here(end), F.col("v"))).alias(f"{side}{i}_{j}") for side, end in (("lo", F.floor(at)), ("hi", F.ceil(at)))]
        picks.append(F.max(F.when(F.col("m") == i, F.col("total"))).alias(f"t{i}"))
    picked = ranked.agg(*picks)

    def quantile(i: int, j: int, p: float) -> Column:
        at = float(p) * (F.col(f"t{i}") - 1)
        return F.col(f"lo{i}_{j}") + (F.col(f"hi{i}_{j}") - F.col(f"lo{i}_{j}")) * (at - F.floor(at))

    arrays = [F.array(*[quantile(i, j, p) for j, p in enumerate(wanted[n][1])]).alias(n) for i, n in enumerate(names)]
    other = df.agg(*also).columns if also else []
    return picked.withColumn("__first", first).select(*[F.col(f"__first.`{c}`").alias(c) for c in other], *arrays)


def exact_quantiles(df: DataFrame, value: Column | str, probabilities: list[float], name: str = "q") -> DataFrame:
    """One row, one array column: linearly interpolated quantiles of one column, NULLs and NaNs left out."""
    return quantile_row(df, {name: (value, probabilities)})


def exact_median(df: DataFrame, value: Column | str) -> Column:
    """Median of a whole column as a scalar subquery."""
    return exact_quantiles(df, value, [0.5]).select(F.col("q")[0].alias("median")).scalar()


def _edges(value: Column, buckets: int) -> Column:
    """``buckets - 1`` ascending values that split a column into ranges of similar size."""
    # one literal: thousands of single ones are slow to plan
    grid = F.split(F.lit(",".join(str(i / buckets) for i in range(1, buckets))), ",").cast("array<double>")
    return F.percentile_approx(value, grid, 4 * buckets)


def bucket_of(edges: Column, value: Column, buckets: int) -> Column:
    """Number of edges not above the value, by halving steps over the sorted edges."""
    steps = F.array(*[F.lit(buckets >> i) for i in range(1, buckets.bit_length())])

    def step(position: Column, size: Column) -> Column:
        higher = position + size
        return F.when(F.get(edges, higher - 1) <= value, higher).otherwise(position)

    return F.aggregate(steps, F.lit(0), step)


def rank_ranges(df: DataFrame, priority: str, key: str) -> DataFrame:
    """``df`` with the range of every row: ``__b1`` and ``__b2`` by value, ``__t`` by the md5 of its key, and what sorts it.

    The first level are ranges of the whole column, the second of those ranges that hold more than ``RANGE_ROWS`` rows
    (or their share of ``MOST_RANGES``). Rows that are equal to the edge of their range are apart and are split by as many
    digits of the md5 as their number asks for.
    """
    value = F.coalesce(F.col(priority).cast("double"), F.lit(float("-inf")))
    plain = df.withColumns({"__v": value, "__h": F.md5(F.col(key).cast("string"))})
    edges = plain.agg(_edges(F.col("__v"), RANK_BUCKETS).alias("e")).scalar()
    level = plain.withColumn("__first", edges).withColumn("__b1", bucket_of(F.col("__first"), F.col("__v"), RANK_BUCKETS))
    level = level.withColumn("__e1", F.get("__first", F.col("__b1") - 1)).drop("__first")
    sizes = level.groupBy("__b1").agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(RANGE_ROWS), sizes.agg(F.ceil(F.sum("n") / MOST_RANGES).alias("most")).scalar())
    large = sizes.where(F.col("n") > most).select("__b1")
    # values on the range's own edge need no second edges
    finer = level.where("__v > __e1 OR __e1 IS NULL").join(F.broadcast(large), "__b1")
    finer = finer.groupBy("__b1").agg(_edges(F.col("__v"), RANK_BUCKETS).alias("__edges"))
    level = level.join(F.broadcast(finer), "__b1", "left")
    level = level.withColumn("__b2", F.when(F.col("__edges").isNotNull(), bucket_of(F.col("__edges"), F.col("__v"), RANK_BUCKETS)).otherwise(0))
    edge = F.when(F.col("__b2") > 0, F.get("__edges", F.col("__b2") - 1)).otherwise(F.col("__e1"))
    level = level.withColumn("__on", F.coalesce(F.col("__v") == edge, F.lit(False))).drop("__edges", "__e1")
    hot = level.where("__on").groupBy("__b1", "__b2").agg(F.count("*").alias("n")).where(F.col("n") > most)
    digits = F.ceil(F.log(16.0, F.col("n") / most)).cast("int") + 1
    hot = hot.select("__b1", "__b2", F.lit(True).alias("__on"), digits.alias("__digits"))
    split = level.join(F.broadcast(hot), ["__b1", "__b2", "__on"], "left")
    digest = F.substring("__h", F.lit(1), F.coalesce("__digits", F.lit(0)))
    # after the other rows of its range: a range's edge is its least value
    return split.withColumn("__t", F.when(F.col("__on"), F.concat(F.lit("e"), digest)).otherwise("")).drop("__on", "__digits")


def global_rank(df: DataFrame, priority: str, key: str) -> DataFrame:
    """1-based position by descending ``priority`` without a global sort; ties in order of the key's md5.

    Sizes of the ranges of :func:`rank_ranges`, a bounded table, give every range its offset, and a window ranks
    inside a range, so positions are exact. Only keys whose md5 begins alike share a range whatever their number.
    """
    split = rank_ranges(df, priority, key)
    keys = ["__b1", "__b2", "__t"]
    sizes = split.groupBy(*keys).agg(F.count("*").alias("__n"))
    # prefix sums over the tree: first inside each range of the first level, then over these
    inner = Window.partitionBy("__b1").orderBy(F.desc("__b2"), "__t").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy(F.desc("__b1")).rowsBetween(Window.unboundedPreceding, -1)
    tops = sizes.groupBy("__b1").agg(F.sum("__n").alias("n")).select("__b1", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("__top"))
    offset = F.col("__top") + F.coalesce(F.sum("__n").over(inner), F.lit(0))
    offsets = sizes.join(F.broadcast(tops), "__b1").select(*keys, offset.alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(F.desc("__v"), "__h", key)
    ranked = split.join(F.broadcast(offsets), keys).withColumn("position", F.col("__offset") + F.row_number().over(inside))
    return ranked.drop(*keys, "__v", "__h", "__offset")
