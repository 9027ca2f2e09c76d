"""What the operators of this subpackage share: scratch tables, Arrow passes and tokenizer files."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: a worker holds a few batches at a time, whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: Spark's setting to remove the shuffle files of a job at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Into how many shares the rows of a hot key are cut.
SALTS = 1024
#: Bytes of input for which a table gets a file.
FILE_BYTES = 16 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir, or on a local master without it a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def files_for(source: DataFrame) -> int:
    """How many files a table made from source is worth: one for each FILE_BYTES that its scans read, in whole rounds of the cores.

    Rows of an RDD, whose size is not known, count as many, so that their tables keep their partitions."""
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    cores = max(1, source.sparkSession.sparkContext.defaultParallelism)
    return min(max(1, -(-size // (FILE_BYTES * cores))) * cores, 1 << 20)


def write_table(df: DataFrame, name: str, files: int | None = None) -> str:
    """Write a table under the shared folder, in at most `files` files; its path.

    Later steps restart from it when an executor is lost, so the shuffle files of the job that wrote it go at once. A file costs
    more than a few rows do: on a local file system Hadoop starts chmod several times for each one, and each start shows the JVM's
    memory twice for a moment. `files` must not be given where rows hold the number of their task, for a task then works off
    several partitions and would give a number twice."""
    spark = df.sparkSession
    path, old = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(files) if files else df).write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)
    return path


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a table once and read it again. It is removed when the Python process ends."""
    path = write_table(df, name, files)
    atexit.register(_remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one run of an operator, each under a name of its own: writing a name again removes its older table.

    All that is left goes when the block ends, so nothing returned from it may read them. A table has at most `files` files,
    except one that is put as `numbered`, whose rows hold the number of their task."""

    def __init__(self, spark: SparkSession, files: int | None = None) -> None:
        self.spark, self.paths, self.files = spark, {}, files

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*list(self.paths))

    def put(self, name: str, df: DataFrame, numbered: bool = False) -> DataFrame:
        path, old = write_table(df, name, None if numbered else self.files), self.paths.get(name)
        self.paths[name] = path
        if old:
            _remove(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, self.paths.pop(name))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).delete(jvm.org.apache.hadoop.fs.Path(path), True)
    except Exception:  # the JVM is gone: the folder's owner clears it
        pass


#: What modules keep in a worker between tasks, as functions that let go of it.
HELD: dict[str, Callable[[], None]] = {}


def let_go(module: str) -> None:
    """Free what other modules keep in this worker: a worker is used again by tasks of later stages, and holds the memory of one of them."""
    for name, free in HELD.items():
        if name != module:
            free()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded in rows and, where Spark has the setting, in bytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(module)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def look_up(rows: DataFrame, by: str, values: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows (a written table) with the columns of `values`, which has one row for each `on`.

    A key may hold any share of the rows: they are cut by a hash of `by`, and a value goes once to each share that its key has."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    shares = salted.select(*on, "salt").distinct().join(values, on)
    return salted.join(shares, [*on, "salt"], how).drop("salt")


def texts(df: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text, null as empty."""
    return df.select(*columns, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def no_clash(key: str, *added: str) -> None:
    if key in added:
        raise ValueError(f"the key column may not be called {key}: the operator returns a column of that name")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with `_` put before it until df has no such column."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


def tokenizer_text(path: str) -> str:
    """The content of a tokenizer file (a few MB), read on the driver and sent to the executors with the task."""
    return Path(path).read_text(encoding="utf-8")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
