"""Run all registered queries against their SQL: python tests/check_oracles.py [folder] [keys]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    sqls = oracle_sql()
    for key, query in queries().items():
        if wanted and key not in wanted:
            continue
        start = time.time()
        try:
            if key in sqls:
                difference = compare(query(spark, sf_dir), con, sqls[key])
            else:  # no SQL can express it
                print(f"{key:24} {query(spark, sf_dir).count()} rows, no SQL", flush=True)
                continue
        except Exception as error:  # report every query, also after a failing one
            difference = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(difference)
        print(f"{key:24} {time.time() - start:6.2f}s {difference or 'ok'}", flush=True)
    print(f"{bad} queries differ")


if __name__ == "__main__":
    main()
