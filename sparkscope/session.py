"""Sessions, and making this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp()), "sparkscope_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a folder of our own; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        try:
            found = spark.conf.get("spark.checkpoint.dir")
        except Exception as error:  # the setting is unknown to this version or has no value
            if "spark.checkpoint.dir" not in str(error):
                raise
    if not found:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/sparkscope-shared"
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, for what a plan reads several times: it is worked out once, and a lost
    executor costs a rerun of reading tasks only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkscope/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session(name: str = "sparkscope", **settings: str) -> SparkSession:
    """A session with what this package relies on; the cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
