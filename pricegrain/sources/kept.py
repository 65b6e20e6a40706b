"""Answers that are kept with their age: shown at once, renewed when they are old or their inputs have changed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Answer:
    """Rows, when they were computed (milliseconds since 1970), and the version of the catalog that they come from."""

    rows: DataFrame
    at: int
    version: int
    #: Whether it is older than asked for, or its inputs have a newer version.
    stale: bool = False
    #: Whether computing it anew has failed, so that it is an old one.
    offline: bool = False


def clock() -> int:
    return int(time.time() * 1000)


@dataclass(frozen=True)
class Kept:
    """Answers by name in `folder`, which the driver and all executors share.

    A folder's name tells the time and the version, and it counts once its job has marked it as whole; so a failed or
    unfinished answer is never shown, and readers of an older one go on with it.
    """

    spark: SparkSession
    folder: str

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder.rstrip("/"), *parts)))

    def _whole(self, name: str) -> list[str]:
        """Finished answers of a name, the oldest first."""
        path = self._path(name)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(n for n in found if n.startswith("a-") and files.exists(self._path(name, n, "_SUCCESS")))

    def last(self, name: str, version: int | None = None, most_age: int | None = None, now: int | None = None) -> Answer | None:
        """The newest answer, none if there isn't any; stale if it is of another version or over most_age milliseconds old."""
        if not (whole := self._whole(name)):
            return None
        _, at, made, _ = whole[-1].split("-")
        old = most_age is not None and (clock() if now is None else now) - int(at) > most_age
        return Answer(self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}/{whole[-1]}"), int(at), int(made), old or version not in (None, int(made)))

    def keep(self, name: str, rows: DataFrame, version: int = 0, now: int | None = None) -> Answer:
        """Writes the rows as the newest answer."""
        at = clock() if now is None else now
        folder = f"a-{at:015}-{version:09}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder.rstrip('/')}/{name}/{folder}")
        return Answer(self.spark.read.schema(rows.schema).parquet(f"{self.folder.rstrip('/')}/{name}/{folder}"), at, version)

    def serve(self, name: str, compute: Callable[[], DataFrame], version: int = 0, most_age: int | None = None, now: int | None = None) -> Answer:
        """What is kept, at once, even if it is stale; computed only where nothing is kept. A caller that sees `stale` renews it after."""
        return self.last(name, version, most_age, now) or self.keep(name, compute(), version, now)

    def renew(self, name: str, compute: Callable[[], DataFrame], version: int = 0, now: int | None = None) -> Answer:
        """The answer computed anew. If Spark or the file system fails, what is kept stays and is shown as `offline`; without any, the error is raised."""
        try:
            return self.keep(name, compute(), version, now)
        except (PySparkException, OSError):
            if (kept := self.last(name)) is None:
                raise
            return Answer(kept.rows, kept.at, kept.version, stale=True, offline=True)

    def clean(self, name: str, keep: int = 2) -> list[str]:
        """Deletes all but the last `keep` answers of a name, and unfinished ones; not while one is computed."""
        path = self._path(name)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stay = set(self._whole(name)[-keep:])
        gone = sorted(n for s in files.listStatus(path) if (n := s.getPath().getName()) not in stay) if files.exists(path) else []
        for n in gone:
            files.delete(self._path(name, n), True)
        return gone
