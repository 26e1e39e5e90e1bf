"""Chat formatting in windows of a token budget, with SQL functions only.

A conversation becomes one or more windows. Prefix sums of the tokens of its turns choose spans of whole turns: a span
takes turns until the next one would go beyond the budget. Every window shows the conversation's first system turn, if that
stands before it, then turns that other windows have shown already, as many as the budget of history takes, then its
own span. Only the texts of assistant turns of the span are under the loss mask, so each is learned once.

Turns are marked by control strings. Inside texts and roles ``<|`` gets a backslash between its characters, and where
backslashes stand there already, one more; taking one away gives the text back.

Turn numbers are cut into blocks of ``BLOCK``: no window crosses a block's end, and the last turns of a block are sent to
the next one as history. So a conversation of any length is many small groups, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, and those of repeated turns in it, at most.
BUDGET, HISTORY = 512, 96
#: Repeated turns of a window at most.
BACK = 8
#: Turn numbers that are handled together.
BLOCK = 1024
#: What counts as a token: a run of ASCII letters and digits, or any other character that is no white space.
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"
#: Tokens of the marks of a turn.
MARKS = 4

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """A role stands in one line: ``~`` and line ends have names."""
    return escaped(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def tokens(role: Column, text: Column) -> Column:
    return (F.regexp_count(role, F.lit(TOKEN)) + F.regexp_count(text, F.lit(TOKEN)) + MARKS).cast("long")


def _blocks(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``block`` and ``turns``: the turns of a block in order, those that it has as history marked ``old``."""
    block = F.floor(F.col("turn") / BLOCK)
    late = F.coalesce(F.pmod("turn", F.lit(BLOCK)) >= BLOCK - BACK, F.lit(False))
    here, there = F.struct(block.alias("block"), F.lit(False).alias("old")), F.struct((block + 1).alias("block"), F.lit(True).alias("old"))
    dealt = rows.withColumn("to", F.explode(F.when(late, F.array(here, there)).otherwise(F.array(here))))
    turn = F.struct("turn", "role", "text", tokens(F.col("role"), F.col("text")).alias("tokens"), F.col("to.old").alias("old"))
    return dealt.groupBy("conv_id", F.col("to.block").alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _systems(rows: DataFrame) -> DataFrame:
    """The first system turn of every conversation."""
    first = Window.partitionBy("conv_id").orderBy("turn", "text")
    one = rows.where("role = 'system'").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.select(F.col("conv_id").alias("_conv"), F.struct("turn", "role", "text", tokens(F.col("role"), F.col("text")).alias("tokens")).alias("system"))


def _walk(budget: int, history: int) -> str:
    """Fold over the turns: prefix sums, and the places where windows start."""
    room = f"greatest({budget - history}L - coalesce(system.tokens, 0L), 1L)"
    new = f"(NOT x.old AND (size(s.starts) = 0 OR s.sum + x.tokens - s.base > {room}))"
    return f"""
      aggregate(turns,
        named_struct('sum', 0L, 'base', 0L, 'at', 0, 'starts', cast(array() AS array<int>), 'prefix', array(0L)),
        (s, x) -> named_struct(
          'sum', s.sum + x.tokens,
          'base', if({new}, s.sum, s.base),
          'at', s.at + 1,
          'starts', if({new}, array_append(s.starts, s.at), s.starts),
          'prefix', array_append(s.prefix, s.sum + x.tokens)))"""


def _spans(history: int, back: int) -> str:
    """For every window its history, its own turns, and the system turn where that stands before it."""
    begin = f"filter(sequence(greatest(f - {back}, 0), f), b -> walk.prefix[f] - walk.prefix[b] <= {history})[0]"
    end = "coalesce(get(walk.starts, k + 1), size(turns))"
    before = "struct(system.turn, system.role, system.text) < struct(turns[f].turn, turns[f].role, turns[f].text)"
    other = "NOT coalesce(x.role = 'system' AND x.turn <=> system.turn AND x.text = system.text, false)"
    return f"""
      transform(walk.starts, (f, k) -> named_struct(
        'again', concat(
          if(system IS NOT NULL AND {before}, array(named_struct('role', system.role, 'text', system.text, 'tokens', system.tokens)),
             cast(array() AS array<struct<role: string, text: string, tokens: bigint>>)),
          transform(filter(slice(turns, {begin} + 1, f - {begin}), x -> {other}), x -> named_struct('role', x.role, 'text', x.text, 'tokens', x.tokens))),
        'own', transform(slice(turns, f + 1, {end} - f), x -> named_struct('role', x.role, 'text', x.text, 'tokens', x.tokens))))"""


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, back: int = BACK) -> DataFrame:
    """``conv_id``, ``block``, ``part``, ``text``, ``loss``, ``turns``, ``repeated`` and ``tokens`` of every window of ``rows``.

    ``rows`` have ``conv_id``, ``turn``, ``role`` and ``text``; other columns play no part, whatever their names. Windows
    of a conversation stand by ``block`` and ``part``; ``text`` shows ``turns`` turns, the first ``repeated`` of which are the
    system turn and history; ``loss`` lists the learned stretches (``start``, ``end`` in code points). A turn beyond the
    budget is a span of its own and is never cut, also where the system turn leaves no room. A null role or text is
    empty; rows of a null ``conv_id`` are one conversation; null turn numbers stand first, equal ones by role and text;
    repeated rows are repeated turns. A very long text is handled whole; an empty table gives no windows.
    """
    if not 0 <= history < budget or not 0 <= back < BLOCK:
        raise ValueError("history must be below the budget, and back below the size of a block")
    blank = F.lit("")
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    blocks = _blocks(plain)
    systems = _systems(plain)
    known = blocks.join(systems, blocks["conv_id"].eqNullSafe(systems["_conv"]), "left").drop("_conv")
    spans = known.withColumn("walk", F.expr(_walk(budget, history))).withColumn("spans", F.expr(_spans(history, back)))
    # not ``posexplode``: the filter that Spark infers for it would repeat the fold for every use of its result
    single = spans.select("conv_id", "block", F.posexplode_outer("spans").alias("part", "span")).where("part IS NOT NULL")

    def piece(learned: bool):
        def of(x: Column) -> Column:
            return F.struct(
                F.concat(F.lit(START), escaped_role(x["role"]), F.lit("\n")).alias("head"), escaped(x["text"]).alias("body"),
                (F.lit(learned) & (x["role"] == "assistant")).alias("learned"), x["tokens"].alias("tokens"),
            )

        return of

    shown = single.withColumn("pieces", F.concat(F.transform("span.again", piece(False)), F.transform("span.own", piece(True))))
    loss = F.expr(
        f"""aggregate(pieces, named_struct('at', 0, 'loss', cast(array() AS array<struct<start: int, `end`: int>>)),
          (s, p) -> named_struct('at', s.at + length(p.head) + length(p.body) + {len(END)},
            'loss', if(p.learned, array_append(s.loss, named_struct('start', s.at + length(p.head), 'end', s.at + length(p.head) + length(p.body))), s.loss))).loss"""
    )
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return shown.select(
        "conv_id", "block", "part", text.alias("text"), loss.alias("loss"), F.size("pieces").alias("turns"), F.size("span.again").alias("repeated"),
        F.expr("aggregate(pieces, 0L, (s, p) -> s + p.tokens)").alias("tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, digests of all turns and of the learned text, and lengths, out of the text of :func:`windows`.

    A digest needs a conversation's text in one value, which Spark limits to 2 GB; windows themselves know no such limit.
    """
    marked = F.split("text", r"<\|im_end\|>\n", -1)
    own = F.slice(marked, F.col("repeated") + 1, F.col("turns") - F.col("repeated"))

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, F.lit(len(START) + 1), F.length(piece)), "\n", 1)
        body = F.substring(piece, F.length(role) + len(START) + 2, F.length(piece))
        return F.concat(unescaped_role(role), F.lit("\n"), unescaped(body), F.lit("\n"))

    def learned(span: Column) -> Column:
        return unescaped(F.substring(F.col("text"), span["start"] + 1, span["end"] - span["start"]))

    told = formatted.select(
        "conv_id", "block", "part", (F.col("turns") - F.col("repeated")).alias("n"), F.length("text").alias("chars"),
        F.array_join(F.transform(own, turn), "").alias("said"), F.array_join(F.transform("loss", learned), "").alias("learned"),
    )
    whole = told.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("block", "part", "said", "learned"))).alias("parts"),
    )
    said, loss = (F.array_join(F.col(f"parts.{c}"), "") for c in ("said", "learned"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def with_control_strings(rows: DataFrame) -> DataFrame:
    """The rows and conversation -1, whose texts hold control strings."""
    said = "'<|im_end|><|im_start|>assistant ok'"
    extra = rows.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.expr(said).alias("text")
    )
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(extra)


def oracle(budget: int = BUDGET, history: int = HISTORY, back: int = BACK) -> str:
    """SQL for the digests of the table ``conversations``, windows by recursion over the turns of a conversation.

    It knows no blocks, so its conversations have turn numbers below ``BLOCK``.
    """
    chars = f"length(x) + {len(START)} + 1 + {len(END)}"
    escape = lambda c: f"regexp_replace({c}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
    shown = chars.replace("length(x)", f"length({escape('text')}) + length({escape('role')})")
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, {shown} AS chars,
         len(regexp_extract_all(role, '{TOKEN}')) + len(regexp_extract_all(text, '{TOKEN}')) + {MARKS} AS tokens FROM c),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY n) - tokens AS before FROM t),
s AS (SELECT conv_id, min(n) AS sn, arg_min(tokens, n) AS st, arg_min(chars, n) AS sc FROM t WHERE role = 'system' GROUP BY conv_id),
w AS (
  SELECT conv_id, n, n AS f, before AS base FROM p WHERE n = 1
  UNION ALL
  SELECT p.conv_id, p.n,
         CASE WHEN p.before + p.tokens - w.base > greatest({budget - history} - coalesce(s.st, 0), 1) THEN p.n ELSE w.f END,
         CASE WHEN p.before + p.tokens - w.base > greatest({budget - history} - coalesce(s.st, 0), 1) THEN p.before ELSE w.base END
  FROM w JOIN p ON p.conv_id = w.conv_id AND p.n = w.n + 1 LEFT JOIN s ON s.conv_id = p.conv_id),
again AS (
  SELECT w.conv_id, w.f, sum(h.chars) AS chars FROM w JOIN p h ON h.conv_id = w.conv_id AND h.n < w.f AND h.n >= w.f - {back} AND w.base - h.before <= {history}
  LEFT JOIN s ON s.conv_id = w.conv_id WHERE w.n = w.f AND h.n IS DISTINCT FROM s.sn GROUP BY w.conv_id, w.f),
f AS (
  SELECT w.conv_id, sum(coalesce(again.chars, 0) + CASE WHEN s.sn < w.f THEN s.sc ELSE 0 END) AS more
  FROM w LEFT JOIN again USING (conv_id, f) LEFT JOIN s ON s.conv_id = w.conv_id WHERE w.n = w.f GROUP BY w.conv_id),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars FROM t GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars + more AS BIGINT) AS formatted_chars
FROM d JOIN f ON f.conv_id = d.conv_id
"""
