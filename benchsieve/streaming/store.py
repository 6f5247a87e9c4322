"""Tables that a stream updates batch by batch: a snapshot, ordered deltas and a manifest.

A batch is a folder, and counts once a new manifest names it, so a reader sees whole batches
only. A batch number that is already in the manifest is not written again: a batch that runs
twice changes nothing. When the deltas outgrow a share of the snapshot they are merged into a
new one, so a read takes the snapshot and a bounded share of it, however long the stream runs.
Files that neither the newest nor the manifest before it names are removed.

A store has one writer at a time, the stream with its checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH = "_batch"


@dataclass
class Delta:
    batch: int
    folder: str
    size: int


@dataclass
class Manifest:
    version: int = 0
    batch: int = -1
    snapshot: str | None = None
    snapshot_size: int = 0
    deltas: list[Delta] = field(default_factory=list)

    def folders(self) -> set[str]:
        return {d.folder for d in self.deltas} | ({self.snapshot} if self.snapshot else set())


class UpdateStore:
    """Rows of ``schema`` under ``path``; with ``keys``, the newest batch's row of each key.

    ``share`` and ``least`` say when deltas are merged: at more than that share of the
    snapshot's bytes and more than ``least`` bytes. ``expired`` tells rows of a merged
    snapshot that are left out of it, by a condition made from the store's rows.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: StructType,
        keys: list[str] | None = None,
        share: float = 0.5,
        least: int = 1 << 20,
        expired: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = StructType(list(schema.fields))
        self.share, self.least, self.expired = share, least, expired
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self._path(f"{self.path}/{name}")

    def _versions(self) -> list[int]:
        folder = self._of("_manifest")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or an empty one."""
        versions = self._versions() if version is None else [version]
        if not versions:
            return Manifest()
        stream = self._files.open(self._of(f"_manifest/{versions[-1]:012}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Manifest(**held | {"deltas": [Delta(**d) for d in held["deltas"]]})

    def _commit(self, manifest: Manifest) -> None:
        name = f"_manifest/{manifest.version:012}.json"
        # The name of a file in the making does not end as a manifest's does.
        making = self._of(f"{name}.{uuid.uuid4().hex}")
        out = self._files.create(making, False)
        try:
            out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            out.close()
        if not self._files.rename(making, self._of(name)):
            raise RuntimeError(f"{self.path} has another writer: {name} is there")

    def _write(self, rows: DataFrame, kind: str, number: int) -> tuple[str, int]:
        folder = f"{kind}-{number}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder, self._files.getContentSummary(self._of(folder)).getLength()

    def _rows(self, manifest: Manifest) -> DataFrame:
        """The rows that a manifest names, with the number of their batch."""
        schema = StructType(list(self.schema.fields)).add(BATCH, "long")
        folders = [f"{self.path}/{f}" for f in sorted(manifest.folders())]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*folders)
        if self.keys is None:
            return rows
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), BATCH).alias("row"))
        return newest.select("row.*")

    def append(self, batch: DataFrame, number: int) -> bool:
        """Store a batch; returns whether it was new."""
        before = self.manifest()
        if number <= before.batch:
            return False
        rows = batch.select(*self.schema.fieldNames(), F.lit(number).cast("long").alias(BATCH))
        folder, size = self._write(rows, "delta", number)
        after = Manifest(
            before.version + 1, number, before.snapshot, before.snapshot_size, [*before.deltas, Delta(number, folder, size)]
        )
        if sum(d.size for d in after.deltas) > max(self.least, self.share * after.snapshot_size):
            rows = self._rows(after)
            rows = self.expired(rows) if self.expired else rows
            after.snapshot, after.snapshot_size = self._write(rows, "snapshot", number)
            after.deltas = []
        self._commit(after)
        self._remove_unnamed(after, before)
        return True

    def _remove_unnamed(self, newest: Manifest, before: Manifest) -> None:
        kept = newest.folders() | before.folders()
        for status in self._files.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith(("delta-", "snapshot-")) and name not in kept:
                self._files.delete(status.getPath(), True)
        for version in self._versions()[:-2]:
            self._files.delete(self._of(f"_manifest/{version:012}.json"), False)

    def read(self) -> DataFrame:
        """The rows of all committed batches, as of now."""
        return self._rows(self.manifest()).drop(BATCH)

    def write_stream(
        self,
        stream: DataFrame,
        checkpoint: str,
        mode: str = "update",
        change: Callable[[DataFrame], DataFrame] = lambda batch: batch,
        **trigger,
    ) -> list[dict]:
        """Store each batch of ``stream``, wait for the end, and return what it reports of its batches.

        ``change`` makes a batch's rows into the store's, for example by joining a response log.
        """

        def store(batch: DataFrame, number: int) -> None:
            self.append(change(batch), number)

        run = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(store)
            .start()
        )
        run.awaitTermination()
        return [json.loads(p.json) for p in run.recentProgress]
