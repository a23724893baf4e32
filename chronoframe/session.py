"""The session that the engine expects: UTC, adaptive plans, a state store for streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


#: The fresh folder of each application that names none, in local mode.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names for checkpoints, or a fresh one in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="chronoframe-")
    return _OWN[app]


def drop_tables(spark: SparkSession) -> None:
    """Deletes the tables that this application's operators have written to the shared folder, whose results aren't needed any more."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tables/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; on a cluster leave `master` and `shuffle_partitions` to the submitter."""
    builder = SparkSession.builder.appName("chronoframe")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (own | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
