"""Several tables published together: all of them or none.

Tables are written to a staging folder beside the published ones, read back and validated. A journal then names what is to
be moved; old tables go to a backup folder and staged ones take their places, each by a rename of Hadoop's FileSystem, and
the manifest comes last. A failure puts the old set back; a driver that died leaves the journal, from which recover does
the same. Renames of folders are atomic on a file system such as HDFS; on an object store a table is moved file by file,
and the journal is what makes the set whole again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from waymark.operators.checks import signature, table_digest

MANIFEST, JOURNAL = "manifest.json", "publishing.json"


class Store:
    """Files below a root that Hadoop's FileSystem reaches, local or shared."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._base = self._path(self.root)
        self._fs = self._base.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        """The whole path of a name below the root; an error if it leads out of it."""
        if name.startswith("/") or ":" in name or ".." in name.split("/"):
            raise ValueError(f"{name} leads out of {self.root}")
        return f"{self.root}/{name}"

    def _at(self, name: str) -> Any:
        return self._path(self.path(name))

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._at(name)))

    def move(self, source: str, target: str) -> None:
        place = self._at(target)
        self._fs.mkdirs(place.getParent())
        if not self._fs.rename(self._at(source), place):
            raise OSError(f"{source} could not be moved to {target}")

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def write(self, name: str, value: object) -> None:
        """Replace a JSON file: written beside its place and renamed, so a reader sees no half of it."""
        own = f"{name}.{uuid.uuid4().hex}"
        self._fs.mkdirs(self._at(own).getParent())
        out = self._fs.create(self._at(own), True)
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
        out.close()
        if self.exists(name):
            self.drop(name)
        self.move(own, name)

    def read(self, name: str) -> Any:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
        finally:
            stream.close()


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], validate: Callable[[dict[str, DataFrame]], object], about: dict[str, object]) -> dict[str, Any]:
    """Replace the tables of these names below root; returns the manifest.

    validate is given the staged tables and fails by an exception, before anything is moved; what it returns goes into
    the manifest with about, the digest of every table and the name of the backup. Tables of other names stay.
    """
    store, run = Store(spark, root), uuid.uuid4().hex
    recover(spark, root)
    stage, backup = f"_staging/{run}", f"_backups/{run}"
    try:
        for name, df in tables.items():
            df.write.parquet(store.path(f"{stage}/{name}"))
        staged = {name: spark.read.parquet(store.path(f"{stage}/{name}")) for name in tables}
        result = validate(staged)
        digests = {name: table_digest(df) for name, df in staged.items()}
        old = store.read(MANIFEST) if store.exists(MANIFEST) else None
        store.write(JOURNAL, {"run": run, "tables": list(tables), "stage": stage, "backup": backup, "old": [n for n in tables if store.exists(n)], "manifest": old})
        for name in tables:
            if store.exists(name):
                store.move(name, f"{backup}/{name}")
            store.move(f"{stage}/{name}", name)
        held = (old or {}).get("tables", {})
        manifest: dict[str, Any] = {"run": run, "about": about, "tables": held | digests, "validation": result, "backup": backup}
        manifest["signature"] = signature(manifest)
        store.write(MANIFEST, manifest)
        store.drop(JOURNAL)
        return manifest
    except BaseException:
        recover(spark, root)
        raise
    finally:
        store.drop(stage)


def recover(spark: SparkSession, root: str) -> bool:
    """Undo a publication that did not end; whether there was one. It may be repeated, also after it failed itself."""
    store = Store(spark, root)
    if not store.exists(JOURNAL):
        return False
    note = store.read(JOURNAL)
    if not (store.exists(MANIFEST) and store.read(MANIFEST).get("run") == note["run"]):
        for name in note["tables"]:
            kept = f"{note['backup']}/{name}"
            if name not in note["old"]:
                store.drop(name)
            elif store.exists(kept):
                store.drop(name)
                store.move(kept, name)
        if note["manifest"] is None:
            store.drop(MANIFEST)
        elif not store.exists(MANIFEST):
            store.write(MANIFEST, note["manifest"])
    store.drop(note["stage"])
    store.drop(JOURNAL)
    return True


def verify(spark: SparkSession, root: str) -> dict[str, Any]:
    """The manifest of root, if it is whole and every table that it names is there and unchanged; else an error."""
    store = Store(spark, root)
    if not store.exists(MANIFEST):
        raise ValueError(f"{root} has no manifest")
    if store.exists(JOURNAL):
        raise ValueError(f"{root} holds a publication that did not end")
    manifest = store.read(MANIFEST)
    if manifest.get("signature") != signature({k: v for k, v in manifest.items() if k != "signature"}):
        raise ValueError("the manifest was changed")
    for name, digest in manifest["tables"].items():
        path = store.path(name)
        if not store.exists(name) or table_digest(spark.read.parquet(path)) != digest:
            raise ValueError(f"{name} is missing or changed")
    return manifest
