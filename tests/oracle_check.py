"""Run the catalog against DuckDB: python tests/oracle_check.py [sf_dir] [name prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    return v


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark, con, name, fn, sql, d):
    df = fn(spark, d)
    cols = sorted(df.columns)
    rows = [tuple(canon(r[c]) for c in cols) for r in df.select(*cols).collect()]
    if sql is None:
        return f"rows-only {len(rows)}", bool(rows)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    types = {c[0]: str(c[1]) for c in rel.description}
    want = [tuple(canon(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall()] if sorted(names) == cols else None
    if want is None:
        return f"columns {cols} vs {sorted(names)}", False
    if len(rows) != len(want):
        return f"rows {len(rows)} vs {len(want)}", False
    spark_types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    odd = [(c, t, types[c]) for c, t in df.dtypes if spark_types.get(t, t.upper()) != types[c]]
    a, b = sorted(rows, key=key), sorted(want, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]} cols {cols}", False
    return f"{len(rows)} rows" + (f" TYPES {odd}" if odd else ""), not odd


def main(d, wanted):
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    if os.environ.get("BLOCK_ROWS"):
        spark.conf.set("spark.halfseen.blockRows", os.environ["BLOCK_ROWS"])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    sqls, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            note, ok = compare(spark, con, name, fn, sqls.get(name), d)
        except Exception as exc:  # noqa: BLE001
            note, ok = f"{type(exc).__name__}: {str(exc)[:600]}", False
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    sys.exit(bool(main(folder, [a for a in args if not os.path.isdir(a)])))
