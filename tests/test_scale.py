"""What keeps large jobs within their limits: shuffle files let go, code that the JVM compiles."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from runledger import lineage
from runledger.projection import project
from runledger.session import JIT_BYTES

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_shuffle_files_of_a_long_write_are_let_go(spark, monkeypatch):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f.getName() for f in (all_files.apply(i) for all_files in [files.getAllFiles()] for i in range(all_files.size())) if f.getName().startswith("shuffle_")}

    monkeypatch.setattr(lineage, "LONG_WRITE_S", -1.0)
    before = shuffles()
    out = lineage.cut(spark.range(10_000).groupBy(F.col("id") % 100).count(), "let-go")
    until = time.time() + 30
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and out.count() == 100


def test_projection_bounds_fused_code_and_keeps_a_given_bound(spark, tmp_path):
    given = spark.conf.get(LIMIT, None)
    try:
        spark.conf.unset(LIMIT)
        project(spark, str(tmp_path))
        assert spark.conf.get(LIMIT) == str(JIT_BYTES)
        spark.conf.set(LIMIT, "20000")
        project(spark, str(tmp_path))
        assert spark.conf.get(LIMIT) == "20000"
    finally:
        spark.conf.set(LIMIT, given or str(JIT_BYTES))
