"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words.
GAPS = r"[\x20\x09-\x0D]+"
#: Rows up to which a measured table of short rows may be broadcast.
BROADCAST_ROWS = 100_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole(df: DataFrame) -> Column:
    """All columns in one struct, where their names clash with none of an operator's."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def _fs(spark: SparkSession, out: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; it goes when the application ends.

    Only with a local master may that setting be missing, as in tests: a local folder is made and set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="sparkgauge-")
        spark.conf.set("spark.checkpoint.dir", top)
    out = f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"
    fs, path = _fs(spark, out)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/t"
    df.write.parquet(out)
    table = spark.read.schema(df.schema).parquet(out)
    table.written_to = out
    return table


def released(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        fs, path = _fs(t.sparkSession, t.written_to)
        fs.delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its counted rows are within ``rows``; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of one key that a task of ``spread`` joins at least.
HOT_ROWS = 128


def spread(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``key``, whose hot keys in ``left`` are dealt over several tasks by the hash ``by``.

    ``right`` has few rows a key, which are repeated for each part. Keys are hot beyond ``HOT_ROWS`` rows, and beyond so
    many that ``BROADCAST_ROWS`` keys of that many rows would make up all of ``left``: so what is broadcast is bounded.
    ``counts`` (key, _rows) are the rows of each key where they are known.
    """
    rows = left.count()
    if rows <= 32 * HOT_ROWS:  # any one task can take them all
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count("*").alias("_rows")) if counts is None else counts
    per = max(HOT_ROWS, rows // BROADCAST_ROWS + 1)
    hot = written(counts.where(F.col("_rows") > per).select(F.col(key).alias("_key"), F.ceil(F.col("_rows") / per).cast("int").alias("_parts")))
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    dealt = left.join(hot, F.col(key) == F.col("_key"), "left").withColumn("_salt", F.coalesce(F.pmod(by, F.col("_parts")), F.lit(0)).cast("int")).drop("_key", "_parts")
    repeated = right.join(hot, F.col(key) == F.col("_key"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_key", "_parts")
    return dealt.join(repeated, [key, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: log2 of the bits of a bitmap at most: 8 MB, as a table of 2**20 rows.
BITMAP_BITS = 26


def bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """A table (word, bits) of the bits that the 64-bit ``hashes`` set, of a size bounded by ``BITMAP_BITS``.

    Where hashes are more than it can tell apart, ``maybe`` lets more rows through; what follows it must be exact.
    """
    n = max(1, hashes.count())
    bits = max(10, min(BITMAP_BITS, (16 * n).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(2**bits - 1))
    one = F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")
    return written(hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one).alias("bits")).withColumn("mask", F.lit(2**bits - 1)))


def maybe(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """``df`` with a boolean ``maybe``: false only where ``column`` is none of the bitmap's hashes. Map-side."""
    first = bits.select("mask").first()
    mask = first[0] if first else 0
    at = F.col(column).bitwiseAND(F.lit(mask))
    out = df.join(F.broadcast(bits.select("word", "bits")), F.shiftright(at, 6) == F.col("word"), "left")
    found = F.expr(f"(shiftright(bits, CAST({column} & 63 AS INT)) & 1) = 1")
    return out.withColumn("maybe", F.coalesce(found, F.lit(False))).drop("word", "bits")
