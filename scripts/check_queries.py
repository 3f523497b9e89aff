"""Run registered queries against their SQL counterparts in DuckDB and report differences.

usage: python scripts/check_queries.py <data folder> [name prefix ...]
"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from ledgerscope.plans import registry  # noqa: E402
from ledgerscope.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: float(v) if type(v).__name__ == "Decimal" else v)
            df[c] = df[c].map(lambda v: None if v is None or v != v else v)
    return df.sort_values(list(df.columns), key=lambda s: s.map(lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v))).reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"COLUMNS {sorted(a.columns)} / {sorted(b.columns)}"
    if len(a) != len(b):
        return f"ROWS {len(a)} / {len(b)}"
    a, b = tidy(a), tidy(b)
    exact, notes = True, []
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if same.all():
            continue
        exact = False
        try:
            fx, fy = x.astype(float), y.astype(float)
            near = ((fx - fy).abs() <= 1e-9 * (1 + fy.abs())) | (fx.isna() & fy.isna())
        except (TypeError, ValueError):
            near = same
        if not near.all():
            i = (~near).idxmax()
            notes.append(f"{c}: {(~near).sum()} differ, e.g. {x[i]!r} / {y[i]!r}")
        else:
            notes.append(f"{c}: float noise in {(~same).sum()}")
    return "ok" if exact else "; ".join(notes)


def main() -> None:
    folder, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    plans, statements = registry.plans(), registry.statements()
    failed = 0
    for name, plan in plans.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            got = plan(spark, folder).toPandas()
            t1 = time.time()
            if name not in statements:
                print(f"{name:45s} rows={len(got)} (no SQL) {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(statements[name]).fetch_df() if hasattr(con, "fetch_df") else con.execute(statements[name]).df()
            verdict = compare(got, want)
        except Exception as exc:  # report and go on with the next query
            verdict, got, t1 = f"FAILED {type(exc).__name__}: {str(exc)[:600]}", [], time.time()
        failed += verdict != "ok"
        print(f"{name:45s} rows={len(got)} {verdict} spark={t1 - t0:.1f}s sql={time.time() - t1:.1f}s", flush=True)
    print("not ok:", failed)


if __name__ == "__main__":
    main()
