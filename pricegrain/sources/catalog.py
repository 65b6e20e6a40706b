"""Several relations that change together: versions named by manifests.

A version lists the folders of each relation's Parquet files. A commit writes new folders first and then one manifest, which
names them and the old ones that stay. Readers go by a manifest alone, so they see all of a commit or nothing of it; a commit
that fails leaves folders that no manifest names, which clean() deletes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES, schema
from .tables import Store, complete

MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Catalog:
    """The relations in `folder`, which the driver and all executors share."""

    spark: SparkSession
    folder: str

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder.rstrip("/"), *parts)))

    def _files(self, path):  # noqa: ANN001, ANN202
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        files = self._files(path)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def versions(self) -> list[int]:
        """All versions, the newest last."""
        return [int(n[:-5]) for n in self._names(MANIFESTS) if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """version, and the folders of each relation; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}}
        path = self._path(MANIFESTS, f"{version:09}.json")
        stream = self._files(path).open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def read(self, version: int | None = None) -> Store:
        """The relations of a version, the newest if none is asked for; those without files are empty."""
        tables = self.manifest(version)["tables"]

        def one(name: str) -> DataFrame:
            if not tables.get(name):
                return self.spark.createDataFrame([], schema(name))
            return self.spark.read.schema(schema(name)).parquet(*(f"{self.folder.rstrip('/')}/{f}" for f in tables[name]))

        return Store(**{name: one(name) for name in TABLES})

    def commit(self, base: int, added: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None) -> int:
        """Makes the version after `base`, which the rows were computed from: with more rows of some relations, and others wholly anew.

        Only new rows are written. Conflict: there is such a version already; the caller reads it and computes anew.
        """
        tables, new = dict(self.manifest(base)["tables"]), {}
        for anew, frames in ((False, added or {}), (True, replaced or {})):
            for name, frame in frames.items():
                folder = f"{name}/v-{uuid.uuid4().hex}"
                complete(frame, name).write.parquet(f"{self.folder.rstrip('/')}/{folder}")
                new[name] = [*([] if anew else new.get(name, tables.get(name, []))), folder]
        version = base + 1
        text = json.dumps({"version": version, "tables": tables | new}, sort_keys=True, indent=1)
        draft, path = self._path(MANIFESTS, f"draft-{uuid.uuid4().hex}"), self._path(MANIFESTS, f"{version:09}.json")
        self._files(draft).mkdirs(self._path(MANIFESTS))
        stream = self._files(draft).create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # A rename that doesn't replace: of writers that start from one version a single one gets the next.
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files(draft).getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, path, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as error:
            self._files(draft).delete(draft, False)
            if version in self.versions():
                raise Conflict(f"version {version} is there already") from error
            raise
        return version

    def clean(self, keep: int = 2) -> list[str]:
        """Deletes manifests before the last `keep` versions, and folders that the rest doesn't name; not while a commit runs."""
        versions = self.versions()
        stay = versions[-keep:]
        named = {f for v in stay for fs in self.manifest(v)["tables"].values() for f in fs}
        gone = [f"{t}/{n}" for t in TABLES for n in self._names(t) if f"{t}/{n}" not in named]
        gone += [f"{MANIFESTS}/{n}" for n in self._names(MANIFESTS) if n not in {f"{v:09}.json" for v in stay}]
        for name in gone:
            path = self._path(*name.split("/"))
            self._files(path).delete(path, True)
        return gone
