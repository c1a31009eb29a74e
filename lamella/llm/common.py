"""What the training-data operators share: tables, the shared folder, staged tables, files on executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as everywhere in this subpackage: a run of characters other than ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset (local tests) a temporary one is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="lamella-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def small_batches(df: DataFrame, rows: int = 2000, size: int = 4 << 20) -> DataFrame:
    """df, with its session's Arrow batches held to so many rows and bytes: texts can be long, and a Python worker has little memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(df.sparkSession.conf.get(key).rstrip("b"))  # a size is given back in bytes
        if now <= 0 or now > most:
            df.sparkSession.conf.set(key, str(most))
    return df


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: later steps neither compute it again nor depend on an executor."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    gc.collect()  # shuffle files that only the written plan needed go when the driver's objects go
    df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Slots of a sieve: 131,072 rows of 64, whatever it is made of.
SLOTS = 1 << 23


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def sieve(df: DataFrame, ids: DataFrame, key: str = "doc_id", flag: str = "maybe") -> DataFrame:
    """df with a column `flag`: false only where its key is surely not in ids (of one column). A bitmap of fixed size is
    broadcast; the more ids it holds the more rows are true, which costs but changes nothing for who looks closer."""
    s, v, w, bits = fresh(df, "slot", "word", "of_word", "bits")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    held = ids.select(slot(F.col(ids.columns[0])).alias(s)).groupBy(F.shiftright(s, 6).alias(w)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({s} & 63 as int))")).alias(bits))
    found = df.withColumn(s, slot(F.col(key))).withColumn(v, F.shiftright(s, 6)).join(F.broadcast(held), F.col(v) == F.col(w), "left")
    return found.withColumn(flag, F.coalesce(F.expr(f"shiftrightunsigned({bits}, cast({s} & 63 as int)) & 1 = 1"), F.lit(False))).select(*df.columns, flag)


def without(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of df whose key is not in ids; a null key only goes if ids has null. Only rows that may go are shuffled."""
    other, flag = fresh(df, "other", "maybe")
    ids = ids.select(F.col(ids.columns[0]).alias(other)).distinct()
    marked = sieve(df, ids, key, flag)
    rest = marked.filter(F.col(flag)).join(ids, F.col(key).eqNullSafe(F.col(other)), "left_anti")
    return marked.filter(~F.col(flag)).unionByName(rest).select(*df.columns)


#: Keys with a HOT-th of all rows or more, so HOT at most, are broadcast by met().
HOT = 1000


def met(df: DataFrame, of: DataFrame, key: str, total: int) -> DataFrame:
    """df joined (inner) with `of`, which has each key once and in `rows` how many rows of df have it, total the rows of all keys. No
    key's rows meet in one task: keys with many are few, and are broadcast."""
    hot = of.filter(F.col("rows") > max(1, total // HOT))
    many = df.join(F.broadcast(hot.drop("rows")), key)
    rest = df.join(F.broadcast(hot.select(key)), key, "left_anti").join(of.drop("rows"), key)
    return many.unionByName(rest)


def words(text: Column) -> Column:
    """The words of a text as an array; of null, an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or an absolute path; used by tasks on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, a null as empty, one at a time (a whole batch as Python objects would take several times its size)."""
    column = batch.column(name).cast(pa.large_binary())
    for v in column:
        yield v.as_py() or b""
