"""Run registered queries against their SQL in DuckDB: ``python tests/oracle.py SF [name ..]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normalized(frame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name; integers and floats alike."""
    columns = sorted(frame.columns)

    def cell(v):
        if v is None or pd.isna(v):
            return "NULL"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return str(bool(v))
        return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> str:
    got = fn(spark, sf_dir).toPandas()
    if sql is None:
        return f"rows only ({len(got)})" if len(got) else "EMPTY"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = normalized(got), normalized(want)
    if a == b:
        return f"ok ({len(a)})" if a else "EMPTY"
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"DIFFERENT {len(a)}/{len(b)} rows; spark only {only_a}; sql only {only_b}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from conftest import make_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark, con = make_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            outcome = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            outcome = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        failed += not outcome.startswith(("ok", "rows only"))
        print(f"{name:28s} {time.time() - start:6.2f}s  {outcome}", flush=True)
    print(f"failed: {failed}")
