"""Tables staged in the folder that driver and executors share, to end lineage in iterations."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """This session's folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and the master is this machine, as in tests, a folder of our own is made:
    on a cluster each executor would write to a disk of its own."""
    sc = spark.sparkContext
    known = getattr(sc, "_pagewarden_scratch", None)
    if known is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="pagewarden-")
            sc.setCheckpointDir(base)
        known = sc._pagewarden_scratch = f"{base.rstrip('/')}/pagewarden-{uuid.uuid4().hex}"
        atexit.register(sweep, spark)
    return known


def sweep(spark: SparkSession) -> None:
    """Deletes this session's staged tables."""
    try:
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._pagewarden_scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone at interpreter exit; the folder is then left to its owner
        pass


def fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns it read back: lineage ends here,
    and the loss of an executor costs no recomputation."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """The same, dealt by a key into as many buckets as shuffles have partitions, so that joins and aggregates by
    that key move none of its rows; and the name of the table, to be dropped after its last use."""
    spark, table = df.sparkSession, f"pagewarden_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", fresh(spark, name)).saveAsTable(table)
    return spark.table(table), table
