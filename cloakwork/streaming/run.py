"""Run a stream over all that is there now, through the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_stream(rows: DataFrame, folder: str) -> DataFrame:
    """A table as a stream of files."""
    rows.write.parquet(f"{folder}/in")
    return rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in")


#: Streams with state of their own keep it in this store, which holds more than the memory of an executor.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: All its stores in an executor share one limit of memory (Spark's 500 MB, or what the session says); else each partition of each stream has its own.
STATE_MEMORY = ("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """While a stream is started, the session names STATE_STORE and STATE_MEMORY; the stream keeps them, the session gets back what it had."""
    before = [(key, spark.conf.get(key, None)) for key, _ in (STATE_STORE, STATE_MEMORY)]
    for setting in (STATE_STORE, STATE_MEMORY):
        spark.conf.set(*setting)
    try:
        yield
    finally:
        for key, old in before:
            spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """All rows that a stream gives now; its state and progress are below `folder`, so that a run that broke off goes on."""
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def latest(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The last row of each key that a stream in update mode gives now; a batch's rows have a folder of their own, which the
    same batch once more writes over."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with state_store(stream.sparkSession):
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
