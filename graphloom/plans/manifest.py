"""Manifest of a resumable run: one small JSON file for each finished step, committed by rename.

A step counts as finished only once its file has its final name, so a driver that dies while it writes leaves a step to
be done again, never half a step.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifest:
    """Finished steps of a run in the folder ``root/manifest`` of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._folder = f"{root}/manifest"
        self.done: dict[str, dict] = self._load()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def _load(self) -> dict[str, dict]:
        folder, files = self._at(self._folder)
        if not files.exists(folder):
            return {}
        done = {}
        for found in files.listStatus(folder):
            step, ending = found.getPath().getName().rsplit(".", 1)
            if ending == "json":
                stream = files.open(found.getPath())
                try:
                    done[step] = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return done

    def commit(self, step: str, facts: dict) -> None:
        """Mark ``step`` as finished, with what it has found."""
        part, files = self._at(f"{self._folder}/{step}.part")
        stream = files.create(part, True)
        try:
            stream.write(bytearray(json.dumps(facts).encode()))
        finally:
            stream.close()
        final, _ = self._at(f"{self._folder}/{step}.json")
        if not files.rename(part, final):
            raise OSError(f"another run has finished {final.toString()}")
        self.done[step] = facts

    def exists(self, path: str) -> bool:
        where, files = self._at(path)
        return files.exists(where)
