"""Run registered queries in Spark and their SQL in DuckDB and compare the results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_value(x) for x in v) + "]"
    return str(v)


def _kind(t: str) -> str:
    t = t.lower()
    for kind, words in {
        "int": ("tinyint", "smallint", "integer", "int"),
        "bigint": ("bigint", "hugeint"),
        "double": ("double", "float"),
        "string": ("varchar", "string"),
    }.items():
        if t in words:
            return kind
    return t


def compare(df, con, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {n: _kind(t) for n, t in zip(names, [str(d[1]) for d in rel.description])}
    right = rel.fetchall()
    left = [tuple(row) for row in df.collect()]
    cols = df.columns
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} != {sorted(names)}"
    spark_kinds = {n: _kind(t) for n, t in df.dtypes}
    order = sorted(cols)
    a = sorted([tuple(_value(row[cols.index(c)]) for c in order) for row in left])
    b = sorted([tuple(_value(row[names.index(c)]) for c in order) for row in right])
    note = {c: (spark_kinds[c], kinds[c]) for c in order if spark_kinds[c] != kinds[c] and "[" not in kinds[c] and "array" not in spark_kinds[c]}
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; {a[:2]} vs {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ on {order}, e.g. {bad[0]}"
    if note:
        return f"types {note}"
    return ""


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("margrid")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def main(names: list[str]) -> None:
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    from catalog import ORACLES, QUERIES

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in names or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLES:
                out = compare(df, con, ORACLES[name]) or "ok"
                out += f" ({df.count()} rows)" if os.environ.get("COUNT") else ""
            else:
                rows = df.collect()
                out = f"rows {len(rows)} {rows[0] if rows else ''}"
        except Exception as e:  # noqa: BLE001
            out = "ERROR " + " ".join(str(e).split())[:300]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{name:34s} {time.time() - start:6.2f}s  {out}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
