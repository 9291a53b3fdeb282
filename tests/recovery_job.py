"""Run the adaptation twice in one session that allows task retries: once
on clean input, once on input whose tasks fail on their first attempt
(a stand-in for lost executors).  Prints SAME when the metrics agree."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


def flaky(batches):
    from pyspark import TaskContext
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("simulated loss of the executor running this task")
    yield from batches


def main(sf: str) -> None:
    from prefspark.operators import adapt as ad
    from prefspark.plans import fixtures as fx
    from prefspark.session import ensure_checkpoint_dir, ship_library

    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(spark)
    ship_library(spark)
    pairs = ad.attach_category(fx.vec_pairs(spark, sf), fx.SECTION_MAP)
    heads = fx.heads(spark, sf)
    out = []
    for src in (pairs, pairs.mapInPandas(flaky, pairs.schema)):
        a = ad.adapt_from_vectors(src, heads, 15, [0, 1, 2], keep=("subset",))
        board = ad.tta_section_scores(a.agg, fx.SECTION_MAP, fx.EXAMPLE_COUNTS)
        out.append(sorted((r.seed, r.metric, r.value) for r in board.collect()))
    print("SAME" if out[0] == out[1] and out[0] else "DIFFERENT")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
