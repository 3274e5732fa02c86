"""What the operators of this subpackage share: tables, the shared folder, batch bounds."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut at this many bytes, so that a run of very long texts does not fill a Python worker.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of our own only where the session names none and runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = f"file://{tempfile.mkdtemp(prefix='marginalia-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a materialised table that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows: the same bounds for every operator here, as the session holds them when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """A smaller bound on Arrow batches for the jobs run inside, and the former one after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Names of a row's key.
ROW = ["__marginalia_a", "__marginalia_b"]


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns: rows share them when they are the same in every column."""
    # maps have no hash of their own: their entries in order do
    flat = {f.name: F.to_json(F.array_sort(F.map_entries(f"`{f.name}`"))) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema}
    told = [x for c in flat.values() for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(seed), *told).alias(name) for seed, name in zip((1, 2), ROW)]


def one_of_each(docs: DataFrame, chosen: DataFrame, rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The rows of docs whose key is in chosen (ROW, each once, and carry), each key once, with all columns of docs and carry. rows: the keys of all rows of docs.

    Rows that are alone with their key, as a rule all, pass by a join; only those that repeat in every column are made distinct.
    The join is by merge: chosen grows with docs.
    """
    names = [F.col(f"`{c}`") for c in [*docs.columns, *carry]]
    repeated = materialise(rows.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*ROW), "repeated")
    kept = docs.select("*", *row_key(docs)).join(chosen.select(*ROW, *carry).hint("merge"), ROW)
    if repeated.isEmpty():
        return kept.select(*names)
    single = kept.join(repeated.hint("merge"), ROW, "left_anti")
    several = kept.join(repeated.hint("merge"), ROW, "left_semi").dropDuplicates(ROW)
    return single.unionByName(several).select(*names)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
