"""Versioned Parquet tables: a write never touches what is being read.

Each table is a folder of versions and of numbered pointer files, each of which
names a version. A write adds a version, then the next pointer, which must not
be there yet: of two writers one fails. An empty pointer, left by a crash, does
not count, so the version before stays. The last ``KEPT`` versions are kept for
those who read them.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.operators.incremental import delete_by, delete_by_either, upsert
from simweave.operators.units import UNIT_DDL

TABLES = {
    "units": (UNIT_DDL, ["id"]),
    "files": ("file_path string, checksum string, mtime double", ["file_path"]),
    "verdicts": ("pair_key string, verdict string, left_file string, right_file string, created_at long", ["pair_key"]),
    "pairs": ("left_id string, right_id string, unit_type string, similarity double, left_file string, right_file string, left_label string, right_label string, pair_key string", ["left_id", "right_id"]),
    "reports": ("run_id string, generated_at timestamp, threshold double, grade string, score double, document string", ["run_id"]),
    "findings": ("run_id string, id string, unit_type string, similarity double, left struct<id: string, name: string, file_path: string, start_line: int, end_line: int, code: string, unit_type: string>, right struct<id: string, name: string, file_path: string, start_line: int, end_line: int, code: string, unit_type: string>, short_id string, exclusion string", ["run_id", "id"]),
}
KEPT = 2
#: Seconds after which a lock counts as left behind.
STALE = 6 * 3600
_RUNNING = threading.Lock()


class Store:
    """Tables below ``root``, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Write a small file that must not be there yet."""
        fs, p = self._fs(path)
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            return False
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def _pointers(self, name: str) -> list[tuple[int, str]]:
        """(number, version) of the table's pointers, the newest first."""
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        files = [s.getPath().getName() for s in fs.listStatus(p)]
        numbers = sorted((int(f[3:]) for f in files if f.startswith("at-")), reverse=True)
        return [(n, self._read(f"{self.root}/{name}/at-{n}")) for n in numbers]

    def _current(self, name: str) -> str | None:
        return next((v for _, v in self._pointers(name) if v), None)

    @contextmanager
    def alone(self) -> Iterator[None]:
        """One run at a time: a second one in this process waits, one elsewhere raises RuntimeError."""
        with _RUNNING:
            path = f"{self.root}/LOCK"
            fs, p = self._fs(path)
            if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > STALE:
                fs.delete(p, False)
            if not self._create(path, uuid.uuid4().hex):
                raise RuntimeError(f"another run is writing: {path} exists")
            try:
                yield
            finally:
                fs.delete(p, False)

    def read(self, name: str) -> DataFrame:
        schema, _ = TABLES[name]
        version = self._current(name)
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{version}")

    def replace(self, name: str, rows: DataFrame) -> None:
        schema = self.spark.createDataFrame([], TABLES[name][0]).schema
        known, version = self._pointers(name), uuid.uuid4().hex
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{self.root}/{name}/{version}")
        if not self._create(f"{self.root}/{name}/at-{known[0][0] + 1 if known else 1}", version):
            raise RuntimeError(f"another run has written {name}")
        for n, old in known[KEPT - 1 :]:
            for gone in filter(None, (f"at-{n}", old)):
                fs, p = self._fs(f"{self.root}/{name}/{gone}")
                fs.delete(p, True)

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.replace(name, upsert(self.read(name), rows.select(self.read(name).columns), TABLES[name][1]))

    def delete_paths(self, name: str, gone: DataFrame) -> None:
        """Rows of files in ``gone`` (file_path); of verdicts, those with either side in it."""
        rows = self.read(name)
        self.replace(name, delete_by_either(rows, gone, "left_file", "right_file") if name == "verdicts" else delete_by(rows, gone, "file_path"))

    def get(self, name: str, key: str) -> DataFrame:
        """Point lookup by the table's key, pushed to the scan."""
        return self.read(name).where(F.col(TABLES[name][1][0]) == key)
