"""Quality rules: documents whose statistics are robust multivariate outliers of their language and source.

Every whole text gives counts, the counts a vector of transformed shares. For every language and source the
minimum covariance determinant is estimated by concentration steps over all its rows: the covariance of the three
quarters with the smallest Mahalanobis distances, starting from medians and deviations, until its determinant stays.
A step is two aggregations, so no group is ever in one task. Groups with few rows share one estimate per language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm import words
from linkspark.llm.tables import small_batches, stored, text_slices

# Signs that count, base rules.
SIGNS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

#: Share of a group's rows that the estimate rests on, steps at most, and the change of the determinant's logarithm
#: below which a group is settled.
CORE, STEPS, SETTLED = 0.75, 8, 1e-3
#: Rows that a language and source needs for an estimate of its own.
LEAST_ROWS = 200
#: Words of usual prose that are added to every text, so that shares of short texts stay near it.
PRIOR = 20.0
#: Standard deviation that every transformed share has at least, and the squared distance of the farthest kept row.
FLOOR, FARTHEST = (0.04, 0.08, 0.10, 0.10, 0.06), 50.0
#: Median of the squared distance of a normal vector with as many parts.
NORMAL_MEDIAN = 4.351
SHARES = ["word_length", "signs", "dup_lines", "repeats", "capitals"]

_SIGN = np.zeros(256, np.int64)
_SIGN[list(SIGNS)] = 1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def count_slice(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The numbers named by ``COUNTS`` of each text of a slice."""
    n = len(offsets) - 1
    at = words.split_words(data, offsets)
    per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offsets])
    chars = per_text(~at.space & ((data & 0xC0) != 0x80))
    total = words.running(data)
    hashes = words.span_hashes(total, at.starts, at.ends)
    text = at.text_of()

    repeats = np.bincount(text[words.repeated(at, hashes, WINDOW)], minlength=n)

    ends = np.unique(np.concatenate([np.flatnonzero(data == 0x0A), offsets[1:]]))
    starts = np.concatenate([[0], ends[:-1] + (data[np.minimum(ends[:-1], max(0, len(data) - 1))] == 0x0A)]) if len(ends) else ends
    starts = np.minimum(starts, ends)
    # a line end that is the first byte of the next text belongs to that text
    owner = np.searchsorted(offsets, starts, side="right") - 1
    with_word = np.searchsorted(at.starts, ends) > np.searchsorted(at.starts, starts)
    starts, ends, owner = starts[with_word], ends[with_word], owner[with_word]
    lines = np.bincount(owner, minlength=n)
    first = np.unique(words.keyed(words.span_hashes(total, starts, ends), owner), return_index=True)[1]
    different = np.bincount(owner[first], minlength=n)
    capitals = per_text((data >= 0x41) & (data <= 0x5A))
    return [at.counts, chars, per_text(_SIGN[data]), lines - different, repeats, lines, capitals]


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``COUNTS`` of every whole text; a null text has none of anything."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, text)

    def run(batches):
        for batch in batches:
            parts = [count_slice(d, o) for _, _, d, o in text_slices(batch.column(len(keep)))]
            if parts:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *columns], names=[*keep, *COUNTS])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)]]
    return kept.mapInArrow(run, ", ".join([*types, *[f"{c} long" for c in COUNTS]]))


def shares() -> dict[str, Column]:
    """Transformed shares; ``PRIOR`` words of five letters and three capitals are added to a text."""
    n = F.col("n_words") + PRIOR
    return {
        "word_length": F.log((F.col("word_chars") + 5 * PRIOR) / n),
        "signs": F.sqrt(F.col("n_symbols") / n),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "capitals": F.sqrt((F.col("n_capitals") + 3) / n),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _estimates(batches):
    """Mean and inverse covariance of each group from its sums."""
    p = len(SHARES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for frame in batches:
        mean = np.stack([frame[f"s{i}"] / frame["n"] for i in range(p)], axis=1)
        cov = np.zeros((len(frame), p, p))
        for i, j in pairs:
            cov[:, i, j] = cov[:, j, i] = frame[f"s{i}_{j}"] / frame["n"] - mean[:, i] * mean[:, j]
        if "scale" in frame:
            cov *= frame["scale"].to_numpy()[:, None, None]
        cov += np.diag(np.square(FLOOR))
        frame = frame[["group"]].assign(
            mean=list(mean), precision=list(np.linalg.inv(cov).reshape(len(frame), -1)), spread=np.linalg.slogdet(cov)[1]
        )
        yield frame


def distance() -> Column:
    """Squared Mahalanobis distance of the row's shares from the row's ``mean`` by its ``precision``."""
    p = len(SHARES)
    off = [F.col(c) - F.col("mean")[i] for i, c in enumerate(SHARES)]
    terms = [off[i] * off[j] * F.col("precision")[i * p + j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def fit(rows: DataFrame) -> DataFrame:
    """``group``, ``mean`` and ``precision`` by minimum covariance determinant over rows with ``group`` and ``SHARES``."""
    p = len(SHARES)
    near = lambda part: F.percentile_approx(part, CORE, 10_000)
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(SHARES)]]
    sums += [F.sum(F.col(SHARES[i]) * F.col(SHARES[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    schema = "group string, mean array<double>, precision array<double>, spread double"
    middle = rows.groupBy("group").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in SHARES])
    flat = lambda c, k: (F.lit(1.0) / (F.pow((F.col(c)[2] - F.col(c)[0]) / 1.349, 2) + FLOOR[k] ** 2))
    diagonal = [flat(SHARES[i], i) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]
    state = stored(middle.select("group", F.array(*[F.col(c)[1] for c in SHARES]).alias("mean"), F.array(*diagonal).alias("precision"), F.lit(1e9).alias("spread")))
    settled = None
    for _ in range(STEPS):
        # groups whose determinant stays are not measured again
        placed = rows.join(state.drop("spread"), "group").withColumn("_d", distance())
        limits = placed.groupBy("group").agg(near("_d").alias("_limit"))
        moments = placed.join(limits, "group").where("_d <= _limit").groupBy("group").agg(*sums)
        after = stored(moments.mapInPandas(_estimates, schema).join(state.select("group", F.col("spread").alias("_before")), "group"))
        still = F.abs(F.col("spread") - F.col("_before")) < SETTLED
        done = after.where(still).drop("_before")
        settled = done if settled is None else settled.union(done)
        state = after.where(~still).drop("_before")
        if not state.take(1):
            break
    state = state if settled is None else settled.union(state)
    # consistency: the median of the squared distances is that of a normal vector
    placed = rows.join(state, "group").withColumn("_d", distance())
    scale = placed.groupBy("group").agg((F.percentile_approx("_d", 0.5, 1000) / NORMAL_MEDIAN).alias("_scale"))
    return stored(state.join(scale, "group").select("group", "mean", "precision", F.greatest("_scale", F.lit(1.0)).alias("_scale")))


def judge(docs: DataFrame, keep: list[str], lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``distance`` (squared, null if base rules fail) and ``kept``.

    Null and empty texts have no words and fail. Null languages and sources are groups like others. Groups with fewer than
    ``LEAST_ROWS`` rows share the estimate of the small groups of their language. Repeated rows give repeated rows.
    """
    named = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    names = [f"_k{i}" for i in range(len(keep))]
    rows = stored(counted(named, [*names, "_lang", "_source"], "_text").withColumn("base_failed", base_failed()))
    part = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c)))
    own, small = F.to_json(F.array(part("_lang"), part("_source"))), F.to_json(F.array(part("_lang")))
    good = rows.where(~F.col("base_failed")).withColumns(shares()).withColumns({"_own": own, "_small": small})
    size = good.groupBy("_own").agg((F.count(F.lit(1)) >= LEAST_ROWS).alias("_large"))
    good = good.join(size, "_own").withColumn("group", F.when(F.col("_large"), F.col("_own")).otherwise(F.col("_small")))
    estimates = fit(good.select("group", *SHARES))
    judged = good.join(estimates, "group", "left").withColumn("distance", distance() / F.col("_scale"))
    columns = [*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *COUNTS, "base_failed"]
    kept = judged.select(*columns, "distance", F.coalesce(F.col("distance") <= FARTHEST, F.lit(True)).alias("kept"))
    failed = rows.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return kept.unionByName(failed)
