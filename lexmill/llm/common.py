"""Helpers that the operators share: tables in the shared folder, bounded Arrow batches, skew-safe small joins."""

from __future__ import annotations

import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to a Python worker; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows of a lookup table up to which a broadcast is allowed (a row is about 100 bytes).
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set here only where it is unset (local runs, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lexmill-')}")
    return context.getCheckpointDir().get()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, gives real sizes.

    The table goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator in the shared folder, which go as soon as nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        self.paths[id(out)] = out, out.inputFiles()[0].rpartition("/")[0] if out.inputFiles() else ""
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in tables:
            _, path = self.paths.pop(id(df))
            if path:
                spark = df.sparkSession
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop_all(self) -> None:
        self.drop(*[df for df, _ in self.paths.values()])


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per context, so that a job needs no install on the executors."""
    context = spark.sparkContext
    if getattr(context, "_lexmill_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lexmill-')}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(made)
    context._lexmill_shipped = True


def give_back() -> None:
    """Returns freed memory to the system, so that a process holds little between two tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether df has at most `bound` rows; looks at no more than bound + 1 of them."""
    return df.limit(bound + 1).count() <= bound


def join_lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 32, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a small table to a big one without shuffling a hot key into one task.

    Up to `bound` rows, counted first, the small side is broadcast. Beyond that its rows are copied once per
    salt and the big side is dealt by (keys, salt). Keys compare null-safe.
    """
    renamed = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = [big[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys]
    if rows_at_most(small, bound):
        out = big.join(F.broadcast(renamed), same, how)
        return out.drop(*[f"__k_{k}" for k in keys])
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)))
    copies = renamed.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = [salted[k].eqNullSafe(copies[f"__k_{k}"]) for k in keys]
    return salted.join(copies, [*same, F.col("__salt") == F.col("__salt2")], how).drop("__salt", "__salt2", *[f"__k_{k}" for k in keys])


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
