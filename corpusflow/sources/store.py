"""Tables of one source as Parquet snapshots on any Hadoop file system.

State tables (manifest, sitemaps, prepared and export state) are written as a new snapshot folder and made current by
renaming a pointer file, so a reader sees the old table or the new one and a failed run leaves the old. History tables
(raw versions, events, runs) are appended to, by run.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENT, MANIFEST, RAW, RUN, SITEMAP, STATE

STATE_TABLES = {"manifest": MANIFEST, "sitemaps": SITEMAP, "prepared": STATE, "export": "what string, target string, sha256 string"}
HISTORY_TABLES = {"raw": (RAW, "run"), "events": (EVENT, "run_id"), "runs": (RUN, "run_id"), "removed": ("profile string, run_id string, url string", "run_id")}


class Store:
    def __init__(self, spark: SparkSession, root: str, source: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{source}"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._hadoop.Path(f"{self.root}/{name}")
        return path.getFileSystem(self._conf), path

    def exists(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def read_text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        fs, path = self._path(name)
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Whole or not at all: written beside, then renamed."""
        fs, path = self._path(name)
        temporary = self._path(f"{name}.{uuid.uuid4().hex}.tmp")[1]
        out = fs.create(temporary)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(path, False)
        if not fs.rename(temporary, path):
            raise OSError(f"can't replace {name}")

    def delete(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def list(self, name: str) -> list[str]:
        """Files below a folder, sorted, without temporary ones."""
        fs, path = self._path(name)
        if not fs.exists(path):
            return []
        found, files = [], fs.listFiles(path, True)
        whole = fs.makeQualified(path).toString()
        while files.hasNext():
            file = files.next().getPath().toString()
            if not file.endswith((".tmp", ".crc")):
                found.append(name + file[len(whole) :])
        return sorted(found)

    # State tables
    def load(self, table: str) -> DataFrame:
        schema, current = STATE_TABLES[table], self.read_text(f"{table}/_CURRENT")
        if current is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{json.loads(current)['snapshot']}")

    def save(self, table: str, rows: DataFrame, keep: int = 2) -> DataFrame:
        """Makes rows (which may come from the table itself) current; older snapshots but `keep` are deleted."""
        schema = self.spark.createDataFrame([], STATE_TABLES[table]).schema
        before = json.loads(self.read_text(f"{table}/_CURRENT") or '{"snapshot": null, "older": []}')
        name = f"s-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{self.root}/{table}/{name}")
        older = [x for x in [before["snapshot"], *before["older"]] if x]
        self.write_text(f"{table}/_CURRENT", json.dumps({"snapshot": name, "older": older[: keep - 1]}))
        for x in older[keep - 1 :]:
            self.delete(f"{table}/{x}")
        return self.load(table)

    # History tables
    def append(self, table: str, run_id: str, rows: DataFrame, more: bool = False) -> None:
        """Adds a run's rows; doing it again for the same run replaces them, with `more` adds to them."""
        schema = self.spark.createDataFrame([], HISTORY_TABLES[table][0]).schema
        part = HISTORY_TABLES[table][1]
        body = [F.col(f.name).cast(f.dataType) for f in schema if f.name != part]
        rows.select(*body).write.mode("append" if more else "overwrite").parquet(f"{self.root}/{table}/{part}={run_id}")

    def history(self, table: str) -> DataFrame:
        schema, part = HISTORY_TABLES[table]
        full = self.spark.createDataFrame([], schema if part in schema.split() else f"{schema}, {part} string")
        if not self.exists(table):
            return full
        return self.spark.read.schema(full.schema).option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}").select(full.columns)

    def raw_versions(self, url: str) -> DataFrame:
        return self.history("raw").where(F.col("url") == url).drop("body").orderBy("version")

    def add_run(self, run_id: str, started, mode: str, counts: dict[str, int]) -> None:
        self.append("runs", run_id, self.spark.createDataFrame([(run_id, started, mode, counts)], RUN))
