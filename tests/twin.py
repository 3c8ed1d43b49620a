"""Compare registered queries with their SQL twins: ``python tests/twin.py [folder] [name prefix ...]``."""
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: str = "8"):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(folder: str):
    import duckdb
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if v != v:
            return "NaN"
        return "F" + repr(v + 0.0 if v else 0.0)
    if type(v).__name__ == "Decimal":
        return "D" + str(v)
    return type(v).__name__[0] + str(v)


def compare(df, rel) -> str:
    """Empty when equal: same column names, same bag of exactly equal values."""
    cols = sorted(df.columns)
    rcols = [d[0] for d in rel.description]
    if sorted(rcols) != cols:
        return f"columns {cols} vs {sorted(rcols)}"
    mine = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    order = [rcols.index(c) for c in cols]
    twin = sorted(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    if mine == twin:
        return ""
    a, b = set(mine) - set(twin), set(twin) - set(mine)
    return f"rows {len(mine)} vs {len(twin)}, differing {len(a)}/{len(b)}; spark {sorted(a)[:2]} sql {sorted(b)[:2]} cols {cols}"


def main(argv):
    import __spark_entry__ as entry
    folder = argv[0] if argv and "/" in argv[0] else "/root/testdata/sf0.01"
    want = [a for a in argv if "/" not in a]
    spark, con = session(), duck(folder)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in sql:
                t1 = time.time()
                rel = con.execute(sql[name])
                msg = compare(df, rel)
            else:
                msg, t1 = f"rows only {df.count()}", time.time()
                msg = "" if not msg.endswith(" 0") else msg
        except Exception as e:
            msg = "ERROR " + str(e)[:700]
        if msg:
            bad += 1
        print(f"{'ok ' if not msg else 'BAD'} {name} {time.time() - t0:.1f}s {msg[:900]}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    main(sys.argv[1:])
