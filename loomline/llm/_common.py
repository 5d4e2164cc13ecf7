"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the operators' contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a folder under the warehouse is used.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loomline"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: lost executors cost a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the largest bitmap that tells members of a table of keys: 4 MB.
MOST_BITS = 1 << 25


def marked(keys: DataFrame, *cols: str) -> Column:
    """A test of columns ``cols``: false only for rows whose values are not among ``keys``.

    ``keys`` is a written table that has these columns. Its bits, sixteen for each of its
    rows up to MOST_BITS, are a scalar array of longs. A full bitmap passes more rows, so
    whoever asks joins exactly afterwards.
    """
    spark = keys.sparkSession
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    bit = F.pmod(F.xxhash64(*cols), F.lit(bits))
    word, one = F.shiftright(bit, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(cols)}), {bits}) & 63 as int))")
    zeros = spark.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    dense = keys.select(word.alias("w"), one.alias("v")).unionByName(zeros).groupBy("w").agg(F.bit_or("v").alias("v"))
    bitmap = dense.agg(F.expr("transform(array_sort(collect_list(struct(w, v))), x -> x.v)").alias("m")).scalar()
    return F.element_at(bitmap, (word + 1).cast("int")).bitwiseAND(one) != F.lit(0)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files
    of plans that nothing refers to."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


#: Rows of an Arrow batch of texts, and Spark's default, which it replaces.
TEXT_ROWS, _DEFAULT_ROWS = 2000, 10_000


def text_batches(spark: SparkSession) -> None:
    """Have texts go to Python in smaller batches, unless the session says how large they are.

    Spark reads the setting when it plans a query, so it stays set. A batch is held by the
    executor and by the worker, each with room to grow: ten thousand texts are some 100 MB.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, str(_DEFAULT_ROWS))) == _DEFAULT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def tidy() -> None:
    """Give the memory of a worker's finished task back to the system: workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_or_empty(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def one_space(col: str | Column) -> Column:
    """The text with every run of white space replaced by one space; null is empty."""
    return F.regexp_replace(text_or_empty(col), SPACE, " ")


def hash60(*parts: Column) -> Column:
    """A non-negative 60-bit integer from the md5 of the parts joined by colons.

    Other SQL engines can compute the same number.
    """
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")
