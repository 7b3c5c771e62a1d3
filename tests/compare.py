"""Run registered queries and compare them with their SQL twins: compare.py <sf_dir> [name …]."""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main(sf_dir, names, limit=None):
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    oracles, bad, begin = entry.oracle_sql(), [], time.time()
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        if limit and time.time() - begin > limit:
            print("STOP at", name)
            break
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:
            bad.append(name)
            print("FAIL", name, round(time.time() - t, 1), str(e)[:600].replace("\n", " | "), flush=True)
            continue
        took = round(time.time() - t, 1)
        if name not in oracles:
            print("rows", name, len(got), took, flush=True)
            continue
        try:
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            want = rows_of(cols, cur.fetchall())
        except Exception as e:
            bad.append(name)
            print("ORACLE", name, str(e)[:500].replace("\n", " | "), flush=True)
            continue
        ok = sorted(cols) == sorted(df.columns) and got == want
        print("ok  " if ok else "DIFF", name, len(got), len(want), took, flush=True)
        if not ok:
            bad.append(name)
            print("   ", sorted(df.columns), sorted(cols))
            a, b = set(map(repr, got)), set(map(repr, want))
            for x in list(a - b)[:2]:
                print("    spark:", x[:400])
            for x in list(b - a)[:2]:
                print("    sql  :", x[:400])
    print("bad:", bad, "total", round(time.time() - begin))
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], set(sys.argv[2:]), limit=float(os.environ.get("LIMIT", "0")) or None)))
