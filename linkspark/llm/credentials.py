"""Secret scanning with linking of credentials that are spread over several parts.

Strong parts (assignments, access identifiers, hexadecimal strings) are reported wherever they occur. Weak ones
(short or unnamed values, user names, addresses) are reported only where a complementary part stands in
the same scope, a block of text without a blank line, at most ``REACH`` code points away. The search for those is an
interval join over bins of ``REACH`` code points: a part meets the first and last part of every role in its own and
the neighbouring bins, never every pair. Only built-in SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.tables import stored

#: Code points between the starts of two parts that belong together.
REACH = 300
#: Characters of the value of a weak assignment.
WEAK_VALUE = 8

# Patterns and lengths of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

# Weak parts.
NAMED = r"""(?i:(client_?id|account_?id|key_?id|username|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})"""
OPAQUE = r"[A-Za-z0-9+/]{40}"
ADDRESS = r"(?i:https?|jdbc|postgres|mysql|mongodb|amqp|redis)://[^\s\"'<>]+"
BLANK = r"\n[\x20\t]*\n"

#: Order of kinds that start at the same place.
KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
SPAN = "array<struct<start:int,order:int,kind:string,`end`:int>>"
ROLES = {"assign": "key", "hex": "key", "key": "key", "access": "id", "id": "id", "endpoint": "endpoint"}


def found(text: Column, pattern: str) -> Column:
    """``(start, end, value)`` of all matches, leftmost first and without overlap, in code points.

    The pieces between matches give the positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start:int,`end`:int,value:string>>)")

    def add(state, pair):
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        item = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(item)).alias("found"))

    pairs = F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda p: p["hit"].isNotNull())
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("found")), add)["found"]
    return F.when(F.size(hits) > 0, walked).otherwise(empty)


def spans_of(hits: Column, kind: str) -> Column:
    order = F.lit(KINDS.index(kind))
    return F.transform(
        hits, lambda h: F.struct(h["start"].alias("start"), order.alias("order"), F.lit(kind).alias("kind"), h["end"].alias("end"))
    )


def as_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def parts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, a key of the row, its strong spans, weak spans and the places of its blank lines."""
    whole = F.coalesce(F.col(text), F.lit(""))
    value = lambda h: F.length(F.regexp_extract(h["value"], ASSIGN, 2))
    mixed = lambda h: h["value"].rlike("[0-9]") & h["value"].rlike("[A-Z]") & h["value"].rlike("[a-z]")
    rows = docs.select(
        *keep,
        F.xxhash64(*[F.col(c) for c in keep], text).alias("_row"),
        found(whole, ASSIGN).alias("_assign"),
        found(whole, ACCESS).alias("_access"),
        found(whole, HEX).alias("_hex"),
        found(whole, NAMED).alias("_named"),
        F.filter(found(whole, OPAQUE), mixed).alias("_opaque"),
        found(whole, ADDRESS).alias("_address"),
        found(whole, BLANK).alias("_blank"),
    )
    strong_assign = F.filter("_assign", lambda h: value(h) >= ASSIGN_LENGTH)
    strong_access = F.filter("_access", lambda h: h["end"] - h["start"] >= ACCESS_LENGTH)
    rows = rows.withColumns({"_strong_assign": strong_assign, "_strong_access": strong_access})
    free = lambda h: ~F.exists("_strong_assign", lambda a: (a["start"] < h["end"]) & (h["start"] < a["end"]))
    weak_assign = F.filter(
        "_assign", lambda h: (value(h) >= WEAK_VALUE) & (value(h) < ASSIGN_LENGTH) & F.regexp_extract(h["value"], ASSIGN, 2).rlike("[0-9]")
    )
    weak_access = F.filter("_access", lambda h: h["end"] - h["start"] < ACCESS_LENGTH)
    return rows.select(
        *keep,
        "_row",
        F.concat(spans_of(F.col("_strong_assign"), "assign"), spans_of(F.col("_strong_access"), "access"), spans_of(F.col("_hex"), "hex"))
        .cast(SPAN)
        .alias("_strong"),
        F.concat(
            spans_of(F.concat(F.filter("_named", free), weak_access), "id"),
            spans_of(F.concat(weak_assign, F.filter("_opaque", free)), "key"),
            spans_of(F.filter("_address", free), "endpoint"),
        )
        .cast(SPAN)
        .alias("_weak"),
        F.transform("_blank", lambda b: b["start"]).alias("_blanks"),
    )


def linked(rows: DataFrame) -> DataFrame:
    """Weak spans that have their complement, as an array for each ``_row``."""
    some = rows.where((F.size("_weak") > 0) & (F.size("_weak") + F.size("_strong") > 1))
    breaks = F.transform("_blanks", lambda b: F.struct(b.alias("start"), F.lit(-1).alias("order"), F.lit("").alias("kind"), b.alias("end")))
    one = (
        some.select("_row", F.explode(F.array_distinct(F.concat(F.col("_strong"), F.col("_weak"), breaks.cast(SPAN)))).alias("s"))
        .select("_row", "s.*")
        .distinct()
    )
    # the scope is the number of blank lines before a part
    before = Window.partitionBy("_row").orderBy("start", "order")
    role = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in ROLES.items()])
    placed = (
        one.withColumn("scope", F.sum(F.when(F.col("order") < 0, 1).otherwise(0)).over(before))
        .where(F.col("order") >= 0)
        .withColumns({"role": role, "bin": F.floor(F.col("start") / REACH)})
    )
    edges = placed.groupBy("_row", "scope", "bin", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = placed.where(F.col("order") >= KINDS.index("id")).select(
        "_row", "scope", "start", "order", "kind", "end", F.col("role").alias("own"), F.col("bin").alias("home"),
        F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"),
    )
    near = (
        (F.col("bin") == F.col("home"))
        | ((F.col("bin") < F.col("home")) & (F.col("start") - F.col("last") <= REACH))
        | ((F.col("bin") > F.col("home")) & (F.col("first") - F.col("start") <= REACH))
    )
    met = weak.join(edges, ["_row", "scope", "bin"]).where(near & (F.col("role") != F.col("own")))
    has = lambda r: F.max(F.col("role") == r)
    kept = (
        met.groupBy("_row", "start", "order", "kind", "end")
        .agg(has("id").alias("id"), has("key").alias("secret"), has("endpoint").alias("at"))
        .where(
            F.when(F.col("kind") == "key", F.col("id") | F.col("at"))
            .when(F.col("kind") == "id", F.col("secret"))
            .otherwise(F.col("id") & F.col("secret"))
        )
    )
    return kept.groupBy("_row").agg(F.collect_list(F.struct("start", "order", "kind", "end")).alias("_linked"))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``strong`` and ``linked``, the spans of secrets of each whole text.

    A null text is empty and has none. Rows that are equal in ``keep`` and text have equal results. A span
    is ``(start, order, kind, end)`` in code points, end exclusive.
    """
    rows = stored(parts(docs, keep, text))
    none = F.expr(f"cast(array() as {SPAN})")
    return rows.join(linked(rows), "_row", "left").select(
        *keep, "_row", F.col("_strong").alias("strong"), F.coalesce("_linked", none).alias("linked")
    )


def report(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    n = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, keep, text).select(
        *keep, n("assign"), n("access"), n("hex"),
        F.sha2(as_text(F.col("strong")), 256).alias("base_sha256"),
        as_text(F.concat("strong", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def masked(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``; spans that overlap become one mark."""
    empty = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def cut(state, s):
        gap = F.when(s["start"] + 1 >= state["at"], F.concat(state["out"], F.substring(text, state["at"], s["start"] + 1 - state["at"]), F.lit(mark)))
        return F.struct(F.greatest(state["at"], s["end"] + 1).alias("at"), F.coalesce(gap, state["out"]).alias("out"))

    done = F.aggregate(F.array_sort(spans), empty, cut)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"], F.length(text)))).otherwise(text)


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of the text replaced by ``mark``; null texts stay null.

    Only the linked spans, of few documents, are joined to the texts; strong ones are found again in place.
    """
    keep = [c for c in docs.columns if c != text]
    found = linked(stored(parts(docs, keep, text)))
    spots = parts(docs.withColumn("_text", F.col(text)), [*keep, "_text"], "_text").drop("_row", "_weak", "_blanks")
    row = F.xxhash64(*[F.col(c) for c in keep], "_text").alias("_row")
    joined = spots.select("*", row).join(found, "_row", "left")
    spans = F.concat("_strong", F.coalesce("_linked", F.expr(f"cast(array() as {SPAN})")))
    return joined.withColumn(text, masked(F.col("_text"), spans, mark)).select(*docs.columns)
