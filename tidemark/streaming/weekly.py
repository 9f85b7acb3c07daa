"""A weekly driver: stages with a manifest, skipped when done, resumed when broken.

Each stage turns input paths into one table.  Its fingerprint covers the stage's
version, the files of its inputs (path, length, time) and the fingerprints of the
stages it reads.  A finished stage is recorded in the manifest with its fingerprint
and the folder of its table; a run skips stages whose fingerprint has not changed.

A table is written to a folder of its own and swapped in whole: readers look the
folder up in the manifest, whose entry is replaced by a rename.  A run that breaks
leaves the finished stages recorded and the old table of the broken one in place.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


class Weekly:
    """Stages below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.ran: list[str] = []
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifest ---

    def _entry(self, stage: str) -> str:
        return f"{self.root}/manifest/{stage}.json"

    def entry(self, stage: str) -> dict | None:
        """The recorded state of a stage: fingerprint and folder."""
        path = self._path(self._entry(stage))
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(b & 0xFF for b in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _record(self, stage: str, value: dict) -> None:
        temp, final = self._path(f"{self._entry(stage)}.{uuid.uuid4().hex}"), self._path(self._entry(stage))
        out = self._fs.create(temp)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.exists(final):
            self._fs.delete(final, False)
        if not self._fs.rename(temp, final):
            raise OSError(f"could not record {stage}")

    # --- stages ---

    def fingerprint(self, version: str, inputs: Sequence[str], after: Sequence[str]) -> str:
        """Digest of all that a stage's result depends on."""
        digest = hashlib.sha256(version.encode())
        for path in inputs:
            files, found = self._fs.listFiles(self._path(path), True), []
            while files.hasNext():
                f = files.next()
                name = f.getPath().getName()
                if not name.startswith(("_", ".")):
                    found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
            digest.update("\n".join([path, *sorted(found)]).encode())
        for stage in after:
            entry = self.entry(stage)
            if entry is None:
                raise ValueError(f"stage {stage} has not run")
            digest.update(entry["fingerprint"].encode())
        return digest.hexdigest()

    def stage(self, name: str, build: Callable[..., DataFrame], inputs: Sequence[str] = (), after: Sequence[str] = (), version: str = "1") -> DataFrame:
        """The table of a stage, built unless it is up to date.

        ``build`` gets the tables of the stages in ``after``; the landed files in
        ``inputs`` it reads by itself."""
        mark = self.fingerprint(version, inputs, after)
        entry = self.entry(name)
        if entry is None or entry["fingerprint"] != mark or not self._fs.exists(self._path(f"{entry['folder']}/_SUCCESS")):
            folder = f"{self.root}/tables/{name}-{uuid.uuid4().hex}"
            build(*[self.table(s) for s in after]).write.parquet(folder)
            self._record(name, {"fingerprint": mark, "folder": folder, "before": entry and entry["folder"]})
            # The table before last has no readers left.
            if entry and entry.get("before"):
                self._fs.delete(self._path(entry["before"]), True)
            self.ran.append(name)
        return self.table(name)

    def table(self, stage: str) -> DataFrame:
        entry = self.entry(stage)
        if entry is None:
            raise ValueError(f"stage {stage} has not run")
        return self.spark.read.parquet(entry["folder"])
