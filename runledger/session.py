"""Session defaults used by tests, the bench and examples; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "runledger", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # column call sites are only for error messages and slow plan building several times
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytecode of a method beyond which the JVM interprets it and never compiles it.
JIT_BYTES = 8000


def compile_small(spark: SparkSession) -> None:
    """Let Spark generate code per operator where the fused code of a stage gets too long for the JVM's compiler.

    Many columns made by expressions, read several times in a stage, easily get there; rows then take several times as long.
    A limit that the session was given stays.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", None) is None:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_BYTES))
