"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Mirrors the contract of ``__spark_entry__``: same row count, same column
names, same column types (after mapping Arrow types), and the same
multiset of rows (columns sorted by name, rows sorted).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb
import pyarrow as pa

from storeflow.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(v + 0.0))
    if isinstance(v, decimal.Decimal):
        return (1, str(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return (1, v.isoformat())
    return (1, repr(v))


def _type_name(t: pa.DataType) -> str:
    if pa.types.is_decimal(t):
        return f"decimal({t.precision},{t.scale})"
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    return str(t)


def rows_of(tbl: pa.Table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(tbl.column_names)
    tbl = tbl.select(names)
    types = [_type_name(tbl.schema.field(n).type) for n in names]
    cols = [tbl.column(n).to_pylist() for n in names]
    rows = sorted(tuple(_norm(c[i]) for c in cols) for i in range(tbl.num_rows))
    return names, types, rows


def compare(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> dict:
    s_tbl = spark_df.toArrow()
    d_tbl = con.sql(sql).to_arrow_table()
    s_names, s_types, s_rows = rows_of(s_tbl)
    d_names, d_types, d_rows = rows_of(d_tbl)
    out = {
        "rows_spark": len(s_rows),
        "rows_oracle": len(d_rows),
        "names_match": s_names == d_names,
        "types_match": s_types == d_types,
        "values_match": s_rows == d_rows,
    }
    out["ok"] = all(out[k] for k in ("names_match", "types_match", "values_match")) and (
        out["rows_spark"] == out["rows_oracle"]
    )
    if not out["ok"]:
        out["spark_schema"] = list(zip(s_names, s_types))
        out["oracle_schema"] = list(zip(d_names, d_types))
        diff_s = [r for r in s_rows if r not in set(d_rows)][:3]
        diff_d = [r for r in d_rows if r not in set(s_rows)][:3]
        out["only_spark"] = diff_s
        out["only_oracle"] = diff_d
    return out
