"""python tests/verify.py SF_DIR [PREFIX...]: every registered query against its SQL."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from oracle import differences  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
    .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
queries, oracles = entry.queries(), entry.oracle_sql()
bad = 0
for name, f in queries.items():
    if sys.argv[2:] and not any(name.startswith(p) for p in sys.argv[2:]):
        continue
    t = time.time()
    try:
        said = differences(spark, f, oracles[name], sys.argv[1]) if name in oracles else f"rows only: {f(spark, sys.argv[1]).count()}"
    except Exception as e:
        said = f"ERROR {str(e)[:700]}"
    bad += bool(said) and not said.startswith("rows only")
    print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
print("differing:", bad)
