"""Runs queries next to their SQL: python -m tests.oracle_check [sf_dir] [query ...]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def differences(left: pd.DataFrame, right: pd.DataFrame) -> list[str]:
    """What differs between two results whose order does not matter."""
    if sorted(left.columns) != sorted(right.columns):
        return [f"columns {sorted(left.columns)} and {sorted(right.columns)}"]
    if len(left) != len(right):
        return [f"{len(left)} and {len(right)} rows"]
    columns = sorted(left.columns)
    a, b = (_text(df, columns) for df in (left, right))
    out = [f"{c}: {left[c].dtype} and {right[c].dtype}" for c in columns if left[c].dtype != right[c].dtype and not _alike(left[c], right[c])]
    if not a.equals(b):
        wrong = [c for c in columns if not a[c].equals(b[c])]
        at = (a != b).any(axis=1)
        out.append(f"{int(at.sum())} rows differ in {wrong}:\n{a[at].head(4).to_string()}\n{b[at].head(4).to_string()}")
    return out


def _alike(a: pd.Series, b: pd.Series) -> bool:
    return {a.dtype.kind, b.dtype.kind} <= {"O", "M", "b"} or {a.dtype.kind, b.dtype.kind} <= {"f"} and a.isna().any()


def _text(df: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    def cell(value: object) -> str:
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "NULL"
        if isinstance(value, float):
            return repr(value + 0.0)
        if isinstance(value, pd.Timestamp):
            return value.isoformat().replace("T00:00:00", "")
        return str(value)

    shown = pd.DataFrame({c: [cell(v) for v in df[c].tolist()] for c in columns})
    return shown.sort_values(columns).reset_index(drop=True)


def main(argv: list[str]) -> int:
    from tidegauge.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(queries())
    spark, con = local_session(8), connect(sf_dir)
    failed = 0
    for name in wanted:
        started = time.time()
        try:
            found = queries()[name](spark, sf_dir).toPandas()
            took = time.time() - started
            sql = oracle_sql().get(name)
            problems = differences(found, con.execute(sql).df()) if sql else []
            verdict = "FAIL" if problems else ("ok" if sql else "rows only")
        except Exception as error:  # noqa: BLE001
            problems, verdict, took = [f"{type(error).__name__}: {str(error)[:1500]}"], "ERROR", time.time() - started
        failed += verdict in ("FAIL", "ERROR")
        print(f"{verdict:9} {name:28} {took:6.1f}s {'' if problems else len(found)}", *problems, sep="\n   " if problems else " ", flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
