"""Run queries and their SQL twins on the same tables and compare the rows.

    python -m workload.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from workload import all_queries, all_sql

_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and the SQL's, None where nothing does."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    wanted = {f.name: _TYPES.get(f.dataType.simpleString(), "?") for f in df.schema.fields}
    if wanted != types:
        return f"types {wanted} and {types}"
    order = sorted(names)
    places = [names.index(n) for n in order]
    theirs = sorted((tuple(r[i] for i in places) for r in result.fetchall()), key=_key)
    ours = sorted((tuple(r) for r in df.select(*order).collect()), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    for a, b in zip(ours, theirs):
        if not all(map(_same, a, b)):
            return f"row {str(a)[:300]} and {str(b)[:300]}"
    return None


def main(sf: str, *only: str) -> int:
    from voxmill.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf), all_sql(), 0
    for name, run in all_queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            if name in sql:
                verdict = difference(df, con, sql[name]) or f"same {df.count()}"
            else:
                verdict = f"rows only {df.count()}"
        except Exception as error:  # report every query, then fail
            verdict = f"error {type(error).__name__} {str(error)[:600]}"
        failed += not verdict.startswith(("same", "rows only"))
        print(f"{name:28} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
