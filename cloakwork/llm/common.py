"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and lost executors cost nothing.

    The folder belongs to the application and may be removed when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores behind it as long as a column of the input, in any case, has that name."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


HOT_ROWS, HOT_SHARE = 512, 256  # a key is hot beyond this many rows and this part of all rows, so fewer than HOT_SHARE keys are


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], spread: str, total: int) -> DataFrame:
    """Inner join of `rows` with `facts`, which has one row for each key `on` and, as `n`, how many rows the key has.

    Keys that hold more than HOT_ROWS rows and more than 1/HOT_SHARE of all `total` rows can't be many, so their facts are
    broadcast, whatever the data; their rows then pass the shuffle dealt by the column `spread`, so that no task gets a whole
    hot key. The facts of all other keys meet their rows in a plain join. `n` itself is dropped."""
    limit = max(HOT_ROWS, total // HOT_SHARE)
    fact = F.struct(*(c for c in facts.columns if c not in (*on, "n")), F.lit(True).alias("_there"))
    hot = facts.where(F.col("n") > limit).select(*on, fact.alias("_hot"))
    cold = facts.where(F.col("n") <= limit).select(*on, fact.alias("_cold"), F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("_deal"))  # always 0, but a literal would be no key of the join
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_deal", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread)))
    met = dealt.join(cold, [*on, "_deal"], "left").withColumn("_fact", F.coalesce("_hot", "_cold")).where("_fact is not null")
    return met.select(*rows.columns, *(f"_fact.{c}" for c in facts.columns if c not in (*on, "n")))


def blocks(batches: Iterable[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[tuple[list, list]]:
    """(keys, texts as UTF-8 bytes or None) of the first two columns, cut after about `limit` bytes; further columns join the key in a tuple."""
    keys: list = []
    texts: list = []
    size = 0
    for batch in batches:
        own = batch.column(0).to_pylist()
        if batch.num_columns > 2:
            own = list(zip(own, *(batch.column(i).to_pylist() for i in range(2, batch.num_columns)), strict=True))
        for key, text in zip(own, batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text or b"")
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of `lengths` consecutive values; empty runs give 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.cumsum(lengths) - lengths
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=out.dtype)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
