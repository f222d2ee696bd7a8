"""The index as Parquet parts that are never changed, and a manifest that says which of them count.

The chunks, vectors and bands of a repository are a part each, so what is done to one repository
neither reads nor writes the others. A change writes new parts and then puts one small manifest in
the place of the old, so readers see all of a change or nothing of it. Parts stay until the second
change after the one that replaced them: what a reader has planned on the manifest before still runs.
Ids are never given twice: meta keeps the highest.
"""

from __future__ import annotations

import base64
import json
import uuid
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import DimensionMismatchError, StoreError
from ..operators.diff import indexed_files, repo_stats
from ..operators.lsh import SimHash
from .files import Folder

#: Tables that have a part for each repository.
PARTED = {"chunks": schemas.CHUNKS, "vectors": schemas.VECTORS, "bands": schemas.BANDS}
_MANIFEST, _FORMAT = "MANIFEST.json", "2"


class Store:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark = spark
        text = str(folder)
        self._folder = Folder(spark, text if "://" in text else str(Path(text).expanduser()))

    # --- parts and manifests ----------------------------------------------------------------

    def _manifest(self) -> dict[str, Any]:
        empty = {"format": _FORMAT, "meta": {}, "repos": None, "parts": {}, "before": []}
        try:
            text = self._folder.read(_MANIFEST)
            found = empty if text is None else json.loads(text)
            return {k: found[k] for k in empty}
        except Exception as e:  # whatever a file system or a broken file fails with
            raise StoreError(f"the index can't be read: {e}") from e

    def _read(self, names: list[str], schema: Any) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(schema).parquet(*[f"{self._folder.uri}/{n}" for n in names])
        except PySparkException as e:
            raise StoreError(f"the index can't be read: {e}") from e

    def table(self, name: str, repo_id: int | None = None) -> DataFrame:
        """A table, or one repository's part of it."""
        held = self._manifest()
        if name == "repos":
            return self._read([held["repos"]] if held["repos"] else [], schemas.REPOS)
        parts = held["parts"].values() if repo_id is None else [held["parts"].get(str(repo_id), {})]
        return self._read([p[name] for p in parts if name in p], PARTED[name])

    def _written(self, name: str, df: DataFrame, schema: Any) -> str:
        at = f"{name}-{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{self._folder.uri}/{at}")
        return at

    def commit(self, meta: dict[str, str] | None = None, repos: DataFrame | None = None, parts: dict[int, dict[str, DataFrame]] | None = None, gone: tuple[int, ...] = ()) -> None:
        """Put these meta entries, registry and parts in the place of the old; ``gone``: repositories without parts from now on."""
        old = self._manifest()
        held = {k: dict(v) for k, v in old["parts"].items()}
        made: list[str] = []
        try:
            registry = old["repos"]
            if repos is not None:
                registry = self._written("repos", repos, schemas.REPOS)
                made.append(registry)
            for repo_id, tables in (parts or {}).items():
                for name, df in tables.items():
                    held.setdefault(str(repo_id), {})[name] = self._written(name, df, PARTED[name])
                    made.append(held[str(repo_id)][name])
            for repo_id in gone:
                held.pop(str(repo_id), None)
            new = {"format": _FORMAT, "meta": old["meta"] | (meta or {}), "repos": registry, "parts": held, "before": sorted(self._named(old))}
            self._folder.write(_MANIFEST, json.dumps(new))
        except BaseException:
            for name in made:
                self._folder.remove(name)
            raise
        used = self._named(new) | set(new["before"]) | {_MANIFEST}
        for name in self._folder.names():
            if name not in used and not name.startswith("."):
                self._folder.remove(name)

    @staticmethod
    def _named(manifest: dict[str, Any]) -> set[str]:
        return {n for p in manifest["parts"].values() for n in p.values()} | ({manifest["repos"]} if manifest["repos"] else set())

    def size(self) -> int:
        return self._folder.size()

    # --- meta -------------------------------------------------------------------------------

    def all_meta(self) -> dict[str, str]:
        return self._manifest()["meta"]

    def get_meta(self, key: str) -> str | None:
        return self.all_meta().get(key)

    def set_meta(self, key: str, value: str) -> None:
        self.commit({key: value})

    def dimensions(self) -> int | None:
        value = self.get_meta("dimensions")
        return None if value is None else int(value)

    def check_dimensions(self, width: int) -> None:
        held = self.dimensions()
        if held is not None and held != width and not self.table("vectors").isEmpty():
            raise DimensionMismatchError(f"the index holds vectors of width {held}, the provider gives {width}; re-index in full")

    def lsh(self, width: int | None = None) -> SimHash | None:
        """The stored planes; for another width, or without any, new ones if a width is given."""
        meta = self.all_meta()
        if "planes" in meta and (width is None or int(meta["dimensions"]) == width):
            planes = SimHash.planes_from(base64.b64decode(meta["planes"]))
            return SimHash(int(meta["num_bands"]), int(meta["band_width"]), planes.shape[1], planes=np.asarray(planes))
        return None if width is None else SimHash(dim=width)

    @staticmethod
    def lsh_meta(lsh: SimHash) -> dict[str, str]:
        return {"planes": base64.b64encode(lsh.to_bytes()).decode(), "num_bands": str(lsh.num_bands), "band_width": str(lsh.band_width), "dimensions": str(lsh.dim)}

    # --- repositories -----------------------------------------------------------------------

    def repos(self) -> DataFrame:
        """id, name, path, indexed_at, file_count, chunk_count, by name; counts come from the chunks."""
        stats = repo_stats(self.table("chunks")).withColumnRenamed("repo_id", "id")
        rows = self.table("repos").join(stats, "id", "left").fillna(0, ["file_count", "chunk_count"])
        return rows.orderBy("name")

    def add_repo(self, name: str, path: str) -> int:
        known = self.table("repos").filter((F.col("name") == name) | (F.col("path") == path))
        if not known.isEmpty():
            raise StoreError(f'a repository of the name "{name}" or the path {path} is registered already')
        new = int(self.get_meta("highest_repo") or 0) + 1
        row = self.spark.createDataFrame([(new, name, path, None)], schemas.REPOS)
        self.commit({"highest_repo": str(new)}, self.table("repos").union(row))
        return new

    def find_repo(self, name_or_path: str) -> dict | None:
        text = name_or_path.strip()
        path = str(Path(text).expanduser().resolve())
        row = self.repos().filter((F.col("name") == text) | (F.col("path") == path)).first()
        return None if row is None else row.asDict()

    def remove_repo(self, name_or_path: str) -> int:
        """Remove a repo with all that is indexed of it; the number of its chunks, 0 if there is none."""
        repo = self.find_repo(name_or_path)
        if repo is None:
            return 0
        self.commit(None, self.table("repos").filter(F.col("id") != repo["id"]), gone=(repo["id"],))
        return repo["chunk_count"]

    def indexed_files(self, repo_id: int) -> DataFrame:
        return indexed_files(self.table("chunks", repo_id))

    def file_paths(self, repo_id: int) -> DataFrame:
        return self.table("chunks", repo_id).select("file_path").distinct().orderBy("file_path")

    def clear_bands(self) -> None:
        """Drop all signatures; duplicates need a full index afterwards."""
        empty = self.table("bands").limit(0)
        self.commit(None, parts={int(r): {"bands": empty} for r in self._manifest()["parts"]})

    def has_bands(self) -> bool:
        return not self.table("bands").isEmpty()

    def places(self) -> DataFrame:
        """Chunks with their repo's name, without texts: what searches filter and order by."""
        repos = self.table("repos").select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
        return self.table("chunks").drop("content", "file_mtime").join(F.broadcast(repos), "repo_id")  # a row for each registered repository

    def texts(self) -> DataFrame:
        return self.table("chunks").select("id", "content")

    def vectors(self) -> DataFrame:
        return self.table("vectors").select(F.col("chunk_id").alias("id"), "embedding")

    def signed(self) -> DataFrame:
        """(chunk_id, bands) as stored."""
        rows = self.table("bands").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("band_idx", "band_hash"))).alias("_b"))
        return rows.select("chunk_id", F.col("_b.band_hash").alias("bands"))
