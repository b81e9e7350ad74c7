"""Compare registered queries with their SQL; usable as a script.

    python tests/check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    res = con.execute(sql)
    return [d[0] for d in res.description], res.fetchall()


def _key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")), round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b and type(a) is type(b)


def compare(df, names, rows):
    """Empty string if equal, else the first difference."""
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    mine = sorted((tuple(r[c] for c in order) for r in df.select(*[f"`{c}`" for c in order]).collect()), key=_key)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(r[i] for i in at) for r in rows), key=_key)
    if len(mine) != len(theirs):
        only = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
        return f"rows {len(mine)} vs {len(theirs)}; only here/there: {only}"
    for x, y in zip(mine, theirs):
        if not all(_same(p, q) for p, q in zip(x, y)):
            return f"{order}: {str(x)[:300]} vs {str(y)[:300]}"
    return ""


def session(cores: str = "8"):
    import tempfile

    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]").appName("themeloom")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="themeloom-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    spark = session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                result = compare(df, *oracle_rows(sf_dir, oracles[name]))
            else:
                result = f"(rows only: {df.count()})"
        except Exception as e:  # noqa: BLE001
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += bool(result) and not result.startswith("(")
        print(f"{time.time() - t:6.1f}s {name}: {result or 'ok'}", flush=True)
    print("failed", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
