"""Runs registered queries against SQL: python tests/check_queries.py FOLDER [name part ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from compare import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from lotledger import build_session  # noqa: E402


def main(folder: str, parts: list[str]) -> int:
    spark = build_session(
        master="local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("OFF")
    sql, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                problems = compare(spark, name, build, sql[name], folder)
            else:
                problems = [] if build(spark, folder).count() >= 0 else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        mark = "ok " if not problems else "BAD"
        print(f"{mark} {time.time() - start:6.2f}s {name}{'' if name in sql else ' (no sql)'}", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
