"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_float_dtype(out[c]):
            out[c] = out[c].map(lambda x: "NULL" if pd.isna(x) else repr(float(x) + 0.0))
        elif pd.api.types.is_datetime64_any_dtype(out[c]):
            out[c] = out[c].map(lambda x: "NULL" if pd.isna(x) else pd.Timestamp(x).isoformat())
        else:
            out[c] = out[c].map(_text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def _text(x) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
        return "NULL"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else repr(x)
    if isinstance(x, pd.Timestamp) or hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    return str(x)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(t) for c, t in df.dtypes.items()}


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if a.equals(b):
        return None
    bad = (a != b).any(axis=1)
    cols = [c for c in a.columns if (a[c] != b[c]).any()]
    return f"{int(bad.sum())} rows differ in {cols}\n{a[bad][cols].head(4)}\n{b[bad][cols].head(4)}"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    failed = []
    for name in names:
        start = time.time()
        try:
            out = queries[name](spark, sf_dir)
            got = out.toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            diff = difference(got, want)
            if diff is None:
                types = {c: (kinds(got)[c], kinds(want)[c]) for c in got.columns if kinds(got)[c] != kinds(want)[c]}
                empty = " EMPTY" if not len(got) else ""
                print(f"ok    {name} {len(got)} {took:.1f}s{empty} {types or ''}", flush=True)
            else:
                failed.append(name)
                print(f"DIFF  {name} {took:.1f}s {diff}", flush=True)
        except Exception as exc:  # noqa: BLE001
            failed.append(name)
            print(f"ERROR {name} {str(exc)[:1500]}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} good; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
