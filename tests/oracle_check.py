"""Run registered queries against their SQL in DuckDB: python tests/oracle_check.py DIR [name…]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
            df[c] = df[c].astype(object).where(df[c].notna(), None)
        elif df[c].dtype == bool:
            df[c] = df[c].astype(object).map(str)
        else:
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canon(got), canon(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            bad = a.index[~same]
            return f"{len(bad)} values differ in {c}: {a.loc[bad[0]].to_dict()} != {b.loc[bad[0]].to_dict()}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from formatpulse.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), []
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sqls:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            diff = difference(got, con.execute(sqls[name]).df())
        except Exception as exc:  # report and go on with the next query
            diff, took = f"{type(exc).__name__}: {str(exc)[:700]}", time.time() - start
        print(f"{'FAIL' if diff else 'ok'}    {name} {took:.1f}s {diff or len(got)}", flush=True)
        if diff:
            bad.append(name)
    print("failed:", bad)
