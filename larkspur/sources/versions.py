"""Tables that change by whole versions: merges of the touched partitions, exact ingest, feeds of changes.

A version is a small file that names the folders of every partition and the
last batch of every writer. Folders are never changed. A writer reads the newest
version, writes what is new to a folder of its own, and publishes the next
version by creating its file, which fails if another writer was first. So a
change is seen whole or not at all, a job that dies leaves no trace in the
table, and a batch that is written again adds nothing.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur import operators as O
from larkspur.operators.changes import differences


class Conflict(Exception):
    """Another writer has published the version first; read it and try again."""


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; one of this machine only where that is unset and all tasks run here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-larkspur-")
    return f"{found.rstrip('/')}/versions-{uuid.uuid4().hex}"


class Versions:
    """A table in a folder, in partitions by the text of ``partition``: an expression that only depends on the key columns.

    Values of ``partition`` are letters, digits, ``_``, ``.`` and ``-``. Collected are the values that a change
    touches, and a version's file has a line for each partition: both are bounded by the number of partitions.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], partition: str):
        self.spark, self.folder, self.schema, self.keys, self.partition = spark, folder.rstrip("/"), schema, keys, partition
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Versions.

    def version(self) -> int:
        """The number of the newest version; 0 for a table that has none."""
        where = self._path(f"{self.folder}/versions")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(where)), default=0) if self._fs.exists(where) else 0

    def manifest(self, version: int | None = None) -> dict:
        """partitions: the folders of each; batches: the last number of each writer."""
        version = self.version() if version is None else version
        if version == 0:
            return {"partitions": {}, "batches": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{version:012d}", wholetext=True).first()[0])

    def publish(self, base: int, manifest: dict) -> int:
        """Version ``base`` + 1, unless another writer has made it."""
        path = self._path(f"{self.folder}/versions/{base + 1:012d}")
        if self._fs.exists(path):
            raise Conflict(f"version {base + 1} is there")
        try:
            out = self._fs.create(path, False)  # fails if the file has come meanwhile
        except Py4JJavaError as e:
            raise Conflict(f"version {base + 1} is there") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return base + 1

    # Rows.

    def _load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._load([f for fs in self.manifest(version)["partitions"].values() for f in fs])

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names).withColumn("_part", F.coalesce(F.expr(self.partition).cast("string"), F.lit("null")))

    def _write(self, rows: DataFrame, touched: list[str]) -> dict[str, str]:
        """The new folder of each touched partition that has rows."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.repartition("_part").write.partitionBy("_part").parquet(folder)
        return {t: f"{folder}/_part={t}" for t in touched if self._fs.exists(self._path(f"{folder}/_part={t}"))}

    def _change(self, delta: DataFrame, rows: Callable[[DataFrame, DataFrame], DataFrame], add: bool, batch: tuple[str, int] | None, base: int | None) -> int:
        base = self.version() if base is None else base
        manifest = self.manifest(base)
        if batch is not None and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return base
        named = self._named(delta)
        touched = sorted(r[0] for r in named.select("_part").distinct().collect())
        bad = [t for t in touched if not re.fullmatch(r"[A-Za-z0-9_.-]+", t)]
        if bad:
            raise ValueError(f"not a name of a partition: {bad[0]!r}")
        parts = manifest["partitions"]
        old = self._load([f for t in touched for f in parts.get(t, [])])
        new = self._write(self._named(rows(old, named.drop("_part"))), touched)
        for t in touched:
            parts[t] = (parts.get(t, []) if add else []) + ([new[t]] if t in new else [])
            if not parts[t]:
                del parts[t]
        if batch is not None:
            manifest["batches"][batch[0]] = batch[1]
        return self.publish(base, manifest)

    def merge(self, delta: DataFrame, update: list[str], batch: tuple[str, int] | None = None, base: int | None = None) -> int:
        """Rows of known keys get the ``update`` columns, others are added; only the partitions of the delta's rows are read and written.

        The delta has each key once. ``base`` is the version that the change was made for, by default the newest.
        """
        return self._change(delta, lambda old, new: O.upsert(old, new, self.keys, update), False, batch, base)

    def insert_absent(self, delta: DataFrame, order: list[str], batch: tuple[str, int] | None = None, base: int | None = None) -> int:
        """Rows of keys that the table lacks are added, however late they come; of one key the first in ``order`` counts.

        Only the partitions of the delta's rows are read, and nothing is written again. A batch (writer, number) that is there already adds nothing.
        """

        def absent(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [c for c in new.columns if c not in self.keys]
            first = new.groupBy(*self.keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *rest)).alias("_r"))
            known = old.select(*self.keys)
            same = [first[k].eqNullSafe(known[k]) for k in self.keys]
            return first.join(known, same, "left_anti").select(*self.keys, *(F.col("_r").getField(c).alias(c) for c in rest))

        return self._change(delta, absent, True, batch, base)

    def replace(self, keys: DataFrame, rows: DataFrame, batch: tuple[str, int] | None = None, base: int | None = None) -> int:
        """All rows of ``keys`` go, and ``rows``, which have no others, take their places."""
        gone = keys.select(*self.keys, *(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.keys))

        def replaced(old: DataFrame, _: DataFrame) -> DataFrame:
            return old.join(keys.select(*self.keys), self.keys, "left_anti").select(*self.schema.names).unionByName(rows.select(*self.schema.names))

        return self._change(gone, replaced, False, batch, base)

    def combine(self, delta: DataFrame, how: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None, base: int | None = None) -> int:
        """The touched partitions become ``how`` of their rows and the delta's together: one row for each key."""
        return self._change(delta, lambda old, new: how(old.unionByName(new)), False, batch, base)

    def ingest(self, writer: str, order: list[str]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch is inserted once, also if the stream hands it over again after a failure."""
        return lambda batch, number: self.insert_absent(batch, order, (writer, number)) and None

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """(version, op, key columns, before, after) of every row that versions after ``since`` have changed; only partitions with other folders are read."""
        found = None
        for v in range(since + 1, (self.version() if until is None else until) + 1):
            a, b = self.manifest(v - 1)["partitions"], self.manifest(v)["partitions"]
            other = [t for t in sorted({*a, *b}) if a.get(t) != b.get(t)]
            # What both versions hold is the same folder, whose rows cancel out.
            old, new = ([f for t in other for f in x.get(t, []) if f not in y.get(t, [])] for x, y in ((a, b), (b, a)))
            rows = differences(self._load(old), self._load(new), self.keys).select(F.lit(v).alias("version"), "*")
            found = rows if found is None else found.unionByName(rows)
        return found if found is not None else differences(self._load([]), self._load([]), self.keys).select(F.lit(0).alias("version"), "*")

    def drop(self) -> None:
        """Deletes the folder."""
        self._fs.delete(self._path(self.folder), True)


def messages(changes: DataFrame, channel: str, keys: list[str]) -> DataFrame:
    """(version, channel, payload): each change as a JSON text, with the row as it is now, or was before it was deleted."""
    row = F.coalesce("after", "before")
    rest = [f.name for f in changes.schema["after"].dataType.fields]
    payload = F.to_json(F.struct("op", *keys, *(row.getField(c).alias(c) for c in rest)), {"ignoreNullFields": "false"})
    return changes.select("version", F.lit(channel).alias("channel"), payload.alias("payload"))


def refreshed(view: DataFrame, changed: DataFrame, rebuild: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """A view after a change of its base: rows of the changed keys are made anew by ``rebuild``, which gets these keys; all others stay."""
    these = changed.select(*keys).distinct()
    return view.join(these, keys, "left_anti").select(*view.columns).unionByName(rebuild(these).select(*view.columns))
