"""What steps leave on disk while later ones run."""

import os
import time

from pyspark.sql import functions as F

from lexigrain import queries
from lexigrain.plans import grids
from lexigrain.storage import CLEANUP, dropped, written


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """The shuffles that made a table are deleted beside what follows, the table itself by dropped()."""
    before = shuffles(spark)
    out = written(spark.range(10_000).groupBy((F.col("id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n")), "kept")
    until = time.time() + 20
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert spark.conf.get(CLEANUP) == "false" and {r["n"] for r in out.collect()} == {1000}
    path = out._written.removeprefix("file://")
    assert os.path.isdir(path)
    dropped(out)
    assert not os.path.exists(path)


def test_shuffles_by_term_and_by_document_are_not_there_at_once(spark, monkeypatch):
    """Each statement that writes n-grams has one of the two shuffles, so the first is deleted before the second begins."""
    plans = []

    def noted(write):
        def f(df, name, *more):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(term"), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc")))
            return write(df, name, *more)

        return f

    for module in (grids, queries):
        monkeypatch.setattr(module, "written", noted(module.written))
    rows = spark.createDataFrame([(1, "train", "p", "a b a"), (2, "train", "n", "a c"), (3, "val", "p", "b a z")], "doc long, split string, label string, text string")
    assert grids.wide_tables(rows).count() == 10
    assert [p[0] for p in plans] == ["known", "features"] and plans[1][1] == 0
    plans.clear()
    queries._weights(spark, "/root/testdata/sf0.001")
    assert [p[0] for p in plans] == ["known", "weights"] and plans[1][1] == 0
