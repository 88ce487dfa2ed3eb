"""Run a query and its SQL check side by side."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import types as T

from threadlens.suite.fixtures import TABLES

_KINDS = {
    T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.IntegerType: "INTEGER",
    T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def plain(v):
        return None if v is None or v != v else v

    rows = [tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(df, con, sql: str) -> list[str]:
    rel = con.sql(sql)
    found = []
    mine = {f.name: _KINDS.get(type(f.dataType), f.dataType.simpleString()) for f in df.schema}
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if mine != theirs:
        found.append(f"schema {mine} != {theirs}")
    if set(mine) != set(theirs):
        return found
    columns = sorted(mine)
    a = pd.DataFrame([tuple(r) for r in df.select(*columns).collect()], columns=columns, dtype=object)
    b = pd.DataFrame(con.execute(sql).fetchall(), columns=rel.columns, dtype=object)
    x, y = _rows(a, columns), _rows(b, columns)
    if len(x) != len(y):
        found.append(f"rows {len(x)} != {len(y)}")
    if x != y:
        bad = [(p, r) for p, r in zip(x, y) if p != r]
        found.append(f"{len(bad)} differing rows, first: {bad[:1]}")
    return found
