"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is computed in full and its rows are discarded; one warm-up run, then the median of REPEATS.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
QUERIES = [
    "j14_supplier_cosupply",
    "j14_parts_together",
    "j9_chain",
    "t1_attention",
    "t2_batched_scores",
    "t7_block_attention",
    "m1_matmul_sat_u32",
    "m8_symbolic_nnz",
    "g1_power",
    "g4_strong_components",
    "g5_weak_components",
    "b1_add",
    "r3_break_even",
]
LATTICE_SIDE, LATTICE_POWERS = 30, (2, 3, 4, 5, 6, 7)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = f"{here}:{os.environ.get('PYTHONPATH', '')}"
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tensorframe import queries as core
    from tensorframe.operators import graph
    from tensorframe.operators.einsum import multiply_count
    from tensorframe.sources import constructors as make
    from tensorframe.sources.storage import written
    from tensorframe.tensor import Tensor

    took: dict[str, float] = {}

    def measure(name, build) -> None:
        times = []
        for _ in range(REPEATS + 1):
            start = time.time()
            run(build())
            times.append(time.time() - start)
        took[name] = round(median(times[1:]), 3)

    for name in QUERIES:
        measure(name, lambda f=core.QUERIES[name]: f(spark, SF_DIR))
    a = make.thin(make.lattice(spark, (LATTICE_SIDE,) * 3, torus=True), make.hashed_share(0.115, 1))
    a = Tensor(written(a.df, "lattice"), a.shape)
    before = a
    for k in LATTICE_POWERS:  # A^(k-1) * A, as one step
        if k > LATTICE_POWERS[0]:
            before = Tensor(written(graph.matmul(before, a).df, "power"), a.shape)
        measure(f"lattice_a{k}", lambda x=before: graph.matmul(x, a).df)
    e = core.sp(spark, SF_DIR)
    macs = multiply_count("ab,cb->ac", e, e)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "sum of median query times", "value": total, "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rpartition("/")[2], "cosupply_macs_per_sec": round(macs / took["j14_supplier_cosupply"])}))


if __name__ == "__main__":
    main()
