"""Order-insensitive comparison of a Spark result with a DuckDB SQL result.

Mirrors the correctness gate: same row count, same column names, same
multiset of rows after normalising floats (rounded) and temporal values
(ISO text). Runs on small fixtures only (results are collected).
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        r = round(f, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return str(v)


def normalise(columns, rows, digits=6):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted((tuple(_norm(r[i], digits) for i in order) for r in rows), key=repr)
    return cols, out


def digest(cols, rows) -> str:
    h = hashlib.sha256()
    h.update(repr(cols).encode())
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()[:16]


_SPARK_TYPES = {"int": "int32", "bigint": "int64", "double": "double", "string": "string",
                "boolean": "bool", "date": "date", "timestamp_ntz": "timestamp", "float": "float"}
_DUCK_TYPES = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double", "VARCHAR": "string",
               "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "timestamp", "FLOAT": "float"}


def spark_types(df) -> dict:
    return {f.name: _SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields}


def duck_types(con, sql: str) -> dict:
    rel = con.sql(sql)
    out = {}
    for c, t in zip(rel.columns, rel.types):
        s = str(t)
        out[c] = _DUCK_TYPES.get(s, s)
    return out


def _array_free(types: dict) -> dict:
    return {k: v for k, v in types.items() if "[" not in v and "array" not in v}


def compare(spark_df, con, sql: str, digits: int = 6) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    s_types, d_types = _array_free(spark_types(spark_df)), _array_free(duck_types(con, sql))
    sc, sr = normalise(s_cols, s_rows, digits)
    dc, dr = normalise(d_cols, d_rows, digits)
    out = {"spark_rows": len(sr), "oracle_rows": len(dr), "columns_match": sc == dc,
           "types_match": s_types == d_types,
           "rows_match": len(sr) == len(dr), "values_match": sr == dr and sc == dc}
    if not out["types_match"]:
        out["type_diff"] = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                            if s_types.get(c) != d_types.get(c)}
    if not out["values_match"]:
        out["spark_cols"], out["oracle_cols"] = sc, dc
        diff_s = [r for r in sr if r not in set(dr)][:3] if len(sr) < 200000 else []
        diff_d = [r for r in dr if r not in set(sr)][:3] if len(dr) < 200000 else []
        out["only_spark"], out["only_oracle"] = diff_s, diff_d
    return out
