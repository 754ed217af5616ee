"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE sizes shuffles at run time; the first count only has to be large enough for the largest stage.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("larder")
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def compiled(spark: SparkSession) -> SparkSession:
    """A session of the same application for long rule sets; ``spark`` stays as it is.

    Java compiles no method of more than 8000 bytes.  Where whole-stage code has
    one, Spark here runs the plan by its separate projections, whose code is split.
    """
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.codegen.hugeMethodLimit", DEFAULTS["spark.sql.codegen.hugeMethodLimit"])
    return own
