"""Session helpers: reliable checkpoints and the session's shuffle width."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables of at most this many rows may be sent to every executor.
BROADCAST_ROWS = 500_000


def shuffle_width(spark: SparkSession) -> int:
    """Shuffle partitions of the session: hot groups are cut into this many pieces."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a scratch folder is made only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="margrid-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder, so lost executors cost no replay."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage through files in the checkpoint folder, for small tables that loops come back to.

    A checkpoint keeps the constraints of the plan it came from, and each round of a loop multiplies them until planning
    takes longer than all jobs; files keep none.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Mark a side for broadcast when its row bound, known from domain sizes, is small.

    Beyond the bound the join is left to the optimizer, which shuffles and splits skewed keys.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
