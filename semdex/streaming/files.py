"""A stream of changed files, chunked and embedded as they come.

Each micro-batch of (repo, file_path, mtime, content) replaces what was indexed of its files before.
The latest version of a file in a batch counts; versions older than what is indexed are dropped. A
batch only adds its own chunks, and a row for each of its files; which batch has a file's latest
version is worked out when the chunks are read. A batch counts once the pointer names it, and batches
of an id that was written are skipped, so a batch that is run again after a failure leaves the same
table. ``compact`` writes what counts as one batch.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import Parser, chunk_files
from ..operators.embed import Provider, embed_column
from ..sources.files import Folder

SOURCE = "repo string, file_path string, mtime double, content string"
_KEY = ("repo", "file_path")
_POINTER = "CURRENT"


class StreamedIndex:
    """Chunks with vectors, as Parquet batches in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str | Path, provider: Provider, parser: Parser | None = None):
        self.spark, self.provider, self.parser = spark, provider, parser
        self._folder = Folder(spark, str(folder))

    def _state(self) -> dict:
        return json.loads(self._folder.read(_POINTER) or '{"batch": -1, "parts": []}')

    def _read(self, kind: str, parts: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self._folder.uri}/{p}/{kind}" for p in parts]) if parts else None

    def _latest(self, parts: list[str]) -> DataFrame | None:
        """(repo, file_path, mtime, batch): where each file's chunks are."""
        rows = self._read("files", parts)
        return None if rows is None else rows.groupBy(*_KEY).agg(F.max(F.struct("mtime", "batch")).alias("_l")).select(*_KEY, "_l.*")

    def chunks(self) -> DataFrame | None:
        parts = self._state()["parts"]
        latest = self._latest(parts)
        return None if latest is None else self._read("chunks", parts).join(latest.select(*_KEY, "batch"), [*_KEY, "batch"], "left_semi").drop("batch")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        state = self._state()
        if batch_id <= state["batch"]:
            return
        rows = batch.groupBy(*_KEY).agg(F.max_by(F.struct("mtime", "content"), "mtime").alias("_f")).select(*_KEY, "_f.*")
        seen = self._latest(state["parts"])
        if seen is not None:
            seen = seen.select(*_KEY, F.col("mtime").alias("_seen"))
            rows = rows.join(seen, list(_KEY), "left").filter(F.col("_seen").isNull() | (F.col("mtime") > F.col("_seen"))).drop("_seen")
        part = f"batch-{batch_id}-{uuid.uuid4().hex[:8]}"
        tag = F.lit(batch_id).cast("long").alias("batch")
        embed_column(chunk_files(rows, self.parser), self.provider).select("*", tag).write.parquet(f"{self._folder.uri}/{part}/chunks")
        rows.select(*_KEY, "mtime", tag).write.parquet(f"{self._folder.uri}/{part}/files")
        self._folder.write(_POINTER, json.dumps({"batch": batch_id, "parts": [*state["parts"], part]}))

    def compact(self) -> None:
        """Write what counts as one part; not while a stream runs."""
        state = self._state()
        latest = self._latest(state["parts"])
        if latest is None or len(state["parts"]) < 2:
            return
        part = f"compact-{state['batch']}-{uuid.uuid4().hex[:8]}"
        self._read("chunks", state["parts"]).join(latest.select(*_KEY, "batch"), [*_KEY, "batch"], "left_semi").write.parquet(f"{self._folder.uri}/{part}/chunks")
        latest.write.parquet(f"{self._folder.uri}/{part}/files")
        self._folder.write(_POINTER, json.dumps({"batch": state["batch"], "parts": [part]}))
        for old in state["parts"]:
            self._folder.remove(old)

    def start(self, source: str | Path, checkpoint: str | Path, available_now: bool = True) -> StreamingQuery:
        """Follow a folder of JSON files of the source's columns."""
        rows = self.spark.readStream.schema(SOURCE).json(str(source))
        out = rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", str(checkpoint))
        return (out.trigger(availableNow=True) if available_now else out).start()
