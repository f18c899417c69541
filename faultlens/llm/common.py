"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a join side up to which it may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: a temporary one, but only if all runs on one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="faultlens-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


class Stored:
    """A DataFrame written as Parquet in the shared folder, so that lost executors cost no recomputation."""

    #: What this process has written and not dropped yet, in order.
    made: list[Stored] = []

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/faultlens/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        Stored.made.append(self)

    def drop(self) -> None:
        Stored.made.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def store(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def small_side(df: DataFrame, row_bytes: int, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to stay within ``limit``; else as it is.

    row_bytes: of a row without its strings and binaries, whose lengths are summed unless ``rows`` is given.
    """
    if rows is None:
        texts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
        long = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in quoted(texts)), F.lit(0).cast("long"))
        size = df.agg((F.count("*") * row_bytes + F.coalesce(F.sum(long), F.lit(0))).alias("b")).first()["b"]
    else:
        size = rows * row_bytes
    return F.broadcast(df) if size <= limit else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def removed(c: Column, characters: str) -> Column:
    """A text without the ``characters``; one plain replacement each is faster than a translation."""
    for x in characters:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def words_of(c: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WORD_GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value made once: a lambda's expressions are otherwise made anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(c: Column, n: int) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % n


def quoted(names) -> list[Column]:
    """Columns by exact name, whatever characters it has."""
    return [F.col("`{}`".format(n.replace("`", "``"))) for n in names]


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that have one of ``names`` (compared without case): an operator's own columns win."""
    own = {n.lower() for n in names}
    return df.select(*quoted(c for c in df.columns if c.lower() not in own))


ROW = "__row"


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The whole row as one struct beside the ``needed`` columns, so that no name of it can clash."""
    return df.select(F.struct(*quoted(df.columns)).alias(ROW), *quoted(needed))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")
