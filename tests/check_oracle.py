"""Run all or the named queries against their SQL: check_oracle.py SF_DIR [QUERY ...]"""

from __future__ import annotations

import sys
import time

import __spark_entry__ as entry
from roadlake.session import build_session
from tests.compare import connect, differences


def main(sf_dir: str, *names: str) -> None:
    settings = {"spark.master": "local[8]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    spark = build_session("check", **settings, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, sql in entry.oracle_sql().items():
        if names and name not in names:
            continue
        start = time.time()
        found = differences(spark, con, entry.queries()[name], sql, sf_dir)
        bad += found is not None
        print(name, f"{time.time() - start:.1f}s", "ok" if found is None else f"DIFFERS {found[:900]}", flush=True)
    print("differing:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
