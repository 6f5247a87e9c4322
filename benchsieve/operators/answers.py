"""A log of what a labeller has answered, chunk by chunk, so that no chunk is asked for twice."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from benchsieve.functions.durable import new_folder
from benchsieve.streaming.store import UpdateStore

Labeller = Callable[[pd.DataFrame], pd.DataFrame]


class AnswerLog:
    """Answers of ``schema`` to chunks of rows, committed wave by wave under ``path``.

    A run asks only for chunks without a committed answer. A chunk whose labeller raises an
    error is kept apart with the error's text, and its wave goes on; the next run asks for it
    again. What is lost with a driver is the wave that was not committed, what is lost with
    an executor is run again by Spark.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, chunks_per_wave: int = 10_000):
        self.columns = StructType.fromDDL(schema)
        stored = StructType.fromDDL("chunk bigint, error string")
        for f in self.columns:
            stored = stored.add(f)
        self.store = UpdateStore(spark, path, stored)
        self.chunks_per_wave = chunks_per_wave

    def answered(self) -> DataFrame:
        return self.store.read().where(F.col("error").isNull())

    def answers(self) -> DataFrame:
        """The answers of all chunks that have them."""
        return self.answered().select(*self.columns.fieldNames())

    def failures(self) -> DataFrame:
        """(chunk, error) of every failed call."""
        return self.store.read().where(F.col("error").isNotNull()).select("chunk", "error").distinct()

    def pending(self, chunked: DataFrame) -> DataFrame:
        """Rows of the chunks without a committed answer."""
        return chunked.join(self.answered().select("chunk").distinct(), "chunk", "left_anti")

    def run(self, chunked: DataFrame, labeller: Labeller) -> None:
        """Ask ``labeller`` for each pending chunk of ``chunked`` (chunk, ...), in waves.

        ``labeller`` takes the rows of one chunk and returns rows of the schema; a chunk is a
        request, so it has few rows. What is pending is written by wave first: a wave then reads
        its own rows alone, and none of the store's files that a merge of later waves removes.
        """
        names = self.columns.fieldNames()

        def ask(rows: pd.DataFrame) -> pd.DataFrame:
            chunk = rows["chunk"].iloc[0]
            try:
                found = labeller(rows)[names].assign(chunk=chunk, error=None)
            except Exception as error:  # noqa: BLE001  what a labeller raises is its own
                text = f"{type(error).__name__}: {error}"
                found = pd.DataFrame([{"chunk": chunk, "error": text} | dict.fromkeys(names)])
            return found[["chunk", "error", *names]]

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.store.schema)
        left = self.pending(chunked)
        count = left.select("chunk").distinct().count()
        waves = -(-count // self.chunks_per_wave)
        if not waves:
            return
        path = new_folder(left.sparkSession)
        numbered = left.withColumn("_wave", F.pmod(F.xxhash64("chunk"), F.lit(waves)))
        # Sorted by range, so a task writes to few waves and a large wave is in several files.
        numbered.repartitionByRange("_wave", "chunk").write.partitionBy("_wave").parquet(path)
        stored = left.sparkSession.read.schema(numbered.schema).parquet(path)
        for wave in range(waves):
            mine = stored.where(F.col("_wave") == wave).drop("_wave")
            rows = mine.groupBy("chunk").applyInPandas(ask, schema)
            self.store.append(rows, self.store.manifest().batch + 1)
