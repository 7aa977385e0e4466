"""Session helpers: building one for tests, and finding the shared work folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app="quizlens", master=None, **conf):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark):
    """The folder of ``spark.checkpoint.dir``, the storage every executor can see.

    Where it is unset, a session that runs in one process (a test, a laptop) gets a temporary
    folder; on a cluster that would be invisible to executors, so there it must be named.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="quizlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_folder(spark, name):
    """A fresh folder for written intermediates and stream checkpoints."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
