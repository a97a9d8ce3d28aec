"""Local stand-in for the driver's correctness gate.

Runs ``queries()[name]`` on Spark and ``oracle_sql()[name]`` on DuckDB over
the same parquet directory and compares row count, column names and an
order-insensitive multiset of rows (columns sorted by name).

    python tests/oracle_check.py [sf_dir] [name ...]
"""
import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def spark_family(t) -> str:
    n = t.simpleString()
    return {"int": "int32", "bigint": "int64", "smallint": "int16", "tinyint": "int8", "string": "string",
            "boolean": "bool", "double": "double", "float": "float", "timestamp_ntz": "timestamp",
            "timestamp": "timestamptz", "date": "date"}.get(n, "array" if n.startswith("array") else
                                                              "struct" if n.startswith("struct") else n)


def duck_family(t: str) -> str:
    t = str(t).upper()
    if t.endswith("[]"):
        return "array"
    if t.startswith("STRUCT"):
        return "struct"
    return {"INTEGER": "int32", "BIGINT": "int64", "SMALLINT": "int16", "TINYINT": "int8", "VARCHAR": "string",
            "BOOLEAN": "bool", "DOUBLE": "double", "FLOAT": "float", "TIMESTAMP": "timestamp",
            "TIMESTAMP WITH TIME ZONE": "timestamptz", "DATE": "date", "HUGEINT": "int128"}.get(t, t)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    import __spark_entry__ as E
    from webloom.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, osql = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = sorted(df.columns)
            srows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in osql:
            print(f"rows {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(osql[name])
            dcols = [d[0] for d in res.description]
            drows_raw = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        idx = {c: i for i, c in enumerate(dcols)}
        if sorted(dcols) != cols:
            print(f"FAIL {name}: columns spark={cols} duck={sorted(dcols)}")
            bad += 1
            continue
        sf_types = {f.name: spark_family(f.dataType) for f in df.schema.fields}
        df_types = {d[0]: duck_family(d[1]) for d in res.description}
        tmis = [(c, sf_types[c], df_types[c]) for c in cols if sf_types[c] != df_types[c]]
        if tmis:
            print(f"TYPE {name}: {tmis}")
        drows = [tuple(norm(r[idx[c]]) for c in cols) for r in drows_raw]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        if sorted(srows, key=key) == sorted(drows, key=key):
            print(f"ok   {name}: {len(srows)} rows {ts:.1f}s")
        else:
            bad += 1
            sset, dset = sorted(srows, key=key), sorted(drows, key=key)
            diff_s = [r for r in sset if r not in dset][:3]
            diff_d = [r for r in dset if r not in sset][:3]
            print(f"FAIL {name}: spark {len(srows)} rows vs duck {len(drows)}; cols={cols}\n"
                  f"  spark-only {str(diff_s)[:800]}\n  duck-only {str(diff_d)[:800]}")
    print("bad:", bad)


if __name__ == "__main__":
    main()
