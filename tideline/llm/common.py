"""What the operators share: scratch tables in the cluster's shared folder, tokenisation, batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine, but only
    if driver and executors are one process (tests); a cluster has to name its folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or "file:///tmp/checkpoints/tideline").rstrip("/")


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet (with options) to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes the files of tables made by materialize() that nothing reads any more (what was made of them is written itself)."""
    for table in tables:
        if (path := getattr(table, "_scratch", None)) is not None:
            _delete(table.sparkSession, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While it holds, a query's shuffle files go when the query has ended, not when the driver happens to collect its garbage. For
    queries whose results are written or collected; a DataFrame made meanwhile should not be run twice."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all that materialize() has written in this application."""
    _delete(spark, f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod modulus is the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case. bytes.split() splits at exactly the six characters of WORD."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def rows_in(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes, so that long texts don't pile up in a Python worker."""
    for batch in batches:
        n = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def sampled(df: DataFrame, key: str, share: Column, seed: int) -> DataFrame:
    """Rows whose seeded hash of key falls below share (0 to 1): the same rows however the data is dealt."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))


def bounded(df: DataFrame, most: int, seed: int) -> DataFrame:
    """df, a sample of about `most` rows by sampled(), as a written table of that many rows at most: equal rows count once (a key that
    repeats adds no more), and beyond `most` those of least hash of all columns stay."""
    marked = df.withColumn("_h", F.xxhash64(F.lit(seed), *df.columns)).dropDuplicates(["_h"])
    out = materialize(marked, "sample")
    if out.count() > most:
        last = out.select("_h").orderBy("_h").limit(most).agg(F.max("_h")).first()[0]
        out = out.where(F.col("_h") <= last)
    return out.drop("_h")


def map_text(df: DataFrame, text: str, added: str, make, keep=None) -> DataFrame:
    """Adds columns computed from whole texts, a batch at a time.

    make: maps a list of texts (None for null) to a list of tuples, in the order of `added` (a DDL schema).
    keep: takes such a tuple; rows for which it is false are left out. Columns of df whose names clash (in any case)
    with an added one are replaced; all others pass through as they are.
    """
    new = StructType.fromDDL(added)
    taken = {x.name.lower() for x in new.fields}
    old = [c for c in df.columns if c.lower() not in taken]
    position = df.columns.index(text)
    kept_at = [i for i, c in enumerate(df.columns) if c.lower() not in taken]
    arrow = to_arrow_schema(new)

    def run(batches):
        for whole in batches:
            for batch in rows_in(iter([whole])):
                made = make(batch.column(position).to_pylist())
                names = [*old, *arrow.names]
                columns = [batch.column(i) for i in kept_at]
                columns += [pa.array([row[i] for row in made], type=arrow.field(i).type) for i in range(len(arrow.names))]
                out = pa.RecordBatch.from_arrays(columns, names=names)
                yield out if keep is None else out.filter(pa.array([bool(keep(row)) for row in made], type=pa.bool_()))

    return df.mapInArrow(run, StructType([df.schema[c] for c in old] + new.fields))


def few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint for a table in the shared folder of at most so many (thin) rows; otherwise Spark shuffles as it sees fit."""
    return F.broadcast(df) if df.count() <= rows else df
