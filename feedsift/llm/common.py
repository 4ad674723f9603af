"""What the operators share: reading tables, stored intermediate tables, hash buckets of documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that holds the bucket of a document while texts and what is known of a bucket meet.
BUCKET = "__bucket"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="feedsift-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to a table in the shared folder and read from there: no later step computes it again, even when
    executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(rows: DataFrame, groups: DataFrame, keys: Sequence[str], hot: Column) -> DataFrame:
    """The rows with the columns of their group, of which there is one for each keys. Groups that are `hot` (a condition that
    few can meet, as to hold a thousandth of all rows) come by broadcast, so that their rows stay where they are; the others are
    met by a shuffle, on which none weighs much."""
    keys, few = list(keys), F.broadcast(groups.filter(hot))
    return rows.join(few, keys).unionByName(rows.join(few, keys, "left_anti").join(groups.filter(~hot), keys))


def small_batches(df: DataFrame, size: str = "4m") -> DataFrame:
    """df, after its session was told to hand rows to Python in batches of about size bytes: long texts then cost a task little
    memory. What the session was told by its user stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":  # Spark's default
        conf.set(name, size)
    return df


def whole_text(text: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def buckets(docs: DataFrame, text: str, target_bytes: int) -> int:
    """How many hash buckets of about target_bytes of text the documents fill."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(1, -(-int(total) // target_bytes))


def bucket_of(n: int, *columns: str) -> Column:
    """A bucket by a hash of the columns. With the text among them, an id that many rows share, or that is null, weighs on
    no bucket."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def scattered(n: int) -> Column:
    """A bucket by the row's place, so that rows which are equal throughout are dealt like any others. For use in one plan:
    another reading may deal otherwise."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str], least_rows: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups, of least_rows rows or more but for the last, from batches sorted by the integer keys."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(waiting)
        same = np.ones(table.num_rows, dtype=bool)
        for key in keys:
            values = table.column(key).to_numpy()
            same &= values == values[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        waiting = table.slice(cut).combine_chunks().to_batches()
        rows = table.num_rows - cut
    if waiting:
        yield pa.Table.from_batches(waiting)
