"""Compare every registered query with its SQL oracle: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + ":" + os.environ.get("PYTHONPATH", "")


def compare(spark, con, run, sql, sf_dir: str) -> str:
    got, want = run(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    cols = sorted(got.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    g, w = ([r.replace("np.float64(", "").replace("np.int64(", "").replace(")", "") for r in rows(d)] for d in (got, want))
    kinds = [c for c in cols if str(got[c].dtype) != str(want[c].dtype)]
    if len(g) != len(w):
        return f"rows {len(g)} {len(w)}"
    bad = [(x, y) for x, y in zip(g, w, strict=True) if x != y]
    return f"differ {len(bad)} of {len(g)}: {bad[0]}" if bad and not all(x.replace(".0,", ",") == y.replace(".0,", ",") for x, y in bad) else f"ok {len(g)} rows" + (f" (types {[(c, str(got[c].dtype), str(want[c].dtype)) for c in kinds]})" if kinds else "")


def main() -> None:
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}{'/*.parquet' if os.path.isdir(f'{sf}/{f}') else ''}'")
    sql = e.oracle_sql()
    for name, run in e.queries().items():
        if (sys.argv[2:] and name not in sys.argv[2:]) or name not in sql:
            continue
        t = time.time()
        try:
            said = compare(spark, con, run, sql[name], sf)
        except Exception as x:  # noqa: BLE001
            said = "ERROR " + str(x)[:600]
        print(f"{name}: {said} {time.time() - t:.1f}s", flush=True)


if __name__ == "__main__":
    main()
