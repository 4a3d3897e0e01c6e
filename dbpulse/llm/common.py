"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read by Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's ``spark.checkpoint.dir`` says.

    Only where that is unset on a local master (tests, one machine) a temporary folder is used.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: what the cluster is sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_column: str, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, is ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def aside_names(columns: list[str], added: tuple[str, ...]) -> dict[str, str]:
    """What each column is called after ``set_aside``: names in ``added``, in any case, get ``_given`` until they are free."""
    wanted = {a.lower() for a in added}
    taken, out = {c.lower() for c in columns} | wanted, {}
    for column in columns:
        out[column] = column
        while out[column].lower() in wanted or (out[column] != column and out[column].lower() in taken):
            out[column] += "_given"
        taken.add(out[column].lower())
    return out


def set_aside(docs: DataFrame, *added: str) -> DataFrame:
    """``docs`` with those columns renamed whose names an operator is about to add."""
    names = aside_names(docs.columns, added)
    return docs if all(a == b for a, b in names.items()) else docs.toDF(*names.values())


def put_back(result: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The given columns of ``result``, under the names they had before ``set_aside``."""
    return result.select(*[F.col(f"`{new}`").alias(old) for old, new in aside_names(columns, added).items()])
