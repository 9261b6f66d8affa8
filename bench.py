"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], and folds of longer molecules; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from strandspark import queries as own
from strandspark.operators import fold, observables
from strandspark.sources.params import packaged

HEADLINE = ("q_strand_parse", "q_pair_candidates", "q_partition_z", "q_bpp", "q_logderiv", "q_mfe", "q_stochastic", "q_score_structure", "q_defects")
#: Letters a molecule, and how many molecules of that length are folded.
LONGER = {12: 2000, 40: 160, 76: 32}


def timed(df: DataFrame) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, rates = {}, {}
    for name in HEADLINE:
        began = time.time()
        own.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    p = packaged("v0.31")
    for n, count in LONGER.items():
        path = tempfile.mkdtemp(prefix="spark-") + "/molecules"
        own.sequences(spark, sf_dir, n).filter(f"length(sequence) = {n}").orderBy("sequence").limit(count).write.parquet(path)
        mols = fold.linear(spark.read.parquet(path)).repartition(int(cpus) * 2)
        rates[f"z_{n}"] = round(count / timed(fold.partition(mols, p, simple=True)), 2)
        rates[f"bpp_{n}"] = round(count / timed(observables.bpp(fold.fill(mols, p, full=True), p)), 2)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "molecules_a_second": rates, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
