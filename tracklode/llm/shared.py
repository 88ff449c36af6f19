"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Tables that this session has staged and not yet cleared.
STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session,
    whose driver and executors are one process, may fall back to a temporary
    folder.
    """
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if folder := spark.conf.get("spark.tracklode.local.dir", None):
        return folder
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tracklode-")
    spark.conf.set("spark.tracklode.local.dir", folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables staged after the first ``since``, but for the last ``keep``, once the results that read them are written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = STAGED[since : len(STAGED) - keep]
    del STAGED[since : len(STAGED) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def strip_ascii_space(text: F.Column) -> F.Column:
    """``text`` without any character of [\x20\x09-\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in ASCII_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def fits(df: DataFrame, max_bytes: int) -> bool:
    """Whether the rows of ``df``, counted now, take at most ``max_bytes``.

    Counts 16 bytes a row and 8 a column besides the text of string columns; an array
    counts 48 bytes an element.
    """
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    texts += [F.greatest(F.size(c), F.lit(0)) * 48 for c, kind in df.dtypes if kind.startswith("array")]
    size = sum(texts, F.lit(0)) + 16 + 8 * len(df.columns)
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= max_bytes
