"""Windows of conversations against a plain version, round trips, and the SQL of the query."""

import random
import re

import duckdb
import pytest
from linkspark.llm import chat, workload
from pyspark.sql import functions as F

TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")


def count(t):
    return len(TOKEN.findall(t[1])) + len(TOKEN.findall(t[2])) + 4


def plain(turns, budget, history, back):
    """Windows of the sorted turns: ``(repeated turns, own turns)``."""
    system = next((i for i, t in enumerate(turns) if t[1] == "system"), None)
    room = max(budget - history - (count(turns[system]) if system is not None else 0), 1)
    out, own = [], []
    for i, t in enumerate(turns):
        if own and sum(count(turns[k]) for k in own) + count(t) > room:
            out.append(own)
            own = []
        own.append(i)
    out.append(own)
    windows = []
    for own in out:
        again, used = [], 0
        for k in range(own[0] - 1, max(-1, own[0] - 1 - back), -1):
            if used + count(turns[k]) > history:
                break
            used += count(turns[k])
            if k != system:
                again.insert(0, k)
        head = [system] if system is not None and system < own[0] else []
        windows.append((head + again, own))
    return windows


def escape(s):
    return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", s)


def conversations(rng):
    bits = ["a", "word", "<|", "<\\|", "|>", "<", "|", "\\", "\n", "<|im_end|>\n", "<|im_start|>user\n", "é", "💡", "~1", "$1", "  "]
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([1, 3, 9, 30])):
            role = rng.choice(["user", "assistant", "assistant", "tool~1\n<|im_end|>"]) if turn or conv % 2 else "system"
            rows.append((conv, turn, role, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 30])))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("budget", "history", "back"), [(60, 20, 3), (25, 0, 8), (100, 60, 1)])
def test_windows_equal_plain_version(spark, budget, history, back):
    rows = conversations(random.Random(budget))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS block", "2 AS walk", "3 AS part")
    got = {}
    for r in chat.windows(table, budget, history, back).orderBy("block", "part").collect():
        got.setdefault(r.conv_id, []).append(r)
    for conv in {r[0] for r in rows}:
        turns = [(t, role, text) for c, t, role, text in sorted(rows) if c == conv]
        want = plain(turns, budget, history, back)
        assert len(want) == len(got[conv])
        for r, (again, own) in zip(got[conv], want, strict=True):
            pieces = [
                (f"<|im_start|>{escape(turns[k][1].replace('~', '~0').replace(chr(10), '~1'))}\n", escape(turns[k][2]), n >= len(again) and turns[k][1] == "assistant")
                for n, k in enumerate(again + own)
            ]
            assert r.text == "".join(h + b + "<|im_end|>\n" for h, b, _ in pieces)
            assert (r.turns, r.repeated) == (len(pieces), len(again))
            assert [r.text[s.start : s.end] for s in r.loss] == [b for _, b, learned in pieces if learned]
            assert r.tokens == sum(count(turns[k]) for k in again + own)
            assert r.tokens <= budget or len(own) == 1


def digests(rows):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def test_round_trip_over_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 16)
    rows = conversations(random.Random(1))
    rows += [(None, 0, "user", "x"), (None, None, None, None), (7000, None, "assistant", "<|"), (7000, 3, "assistant", None), (7000, 3, "assistant", "b"), (7000, 3, "assistant", "b")]
    rows += [(8000, 10**12, "system", "far"), (8000, -5, "user", "before"), (8001, 1, "assistant", "long <| " * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.windows(table, 80, 30)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == digests(rows)
    late = formatted.where("block = 1 AND part = 0 AND conv_id < 7000").collect()
    assert late and any(r.repeated >= 2 for r in late)
    assert chat.read_back(chat.windows(table.limit(0))).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = workload.QUERIES["op11_budgeted_windows"](spark, sf)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({chat.oracle()})").fetchall()
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want)
    parts = chat.windows(chat.with_control_strings(spark.read.parquet(f"{sf}/conversations.parquet")))
    assert parts.where("part > 0").count() > 20 and parts.where("part = 0 AND repeated > 0").count() == 0
    assert parts.agg(F.max("tokens")).first()[0] < 4000
