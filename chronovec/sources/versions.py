"""Stores that hold hand-made records: every save is a new numbered version beside the old ones.

A version is a folder of data and a small file that names it. The file is written aside and then renamed to its number,
which fails if that number is taken; so readers see one whole version, a crash at any step leaves the last one, and of
two writers that started from the same version one is told to try again. Rows keep the number of the version that wrote
them (`seq`) and their place within it, so which of two rows counts never depends on how files are read.

The pointer also keeps, for each stream that writes, the last batch applied: a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS, DATA = "_versions", "_data"


class Conflict(Exception):
    """Another writer saved a version in between."""


class VersionedStore:
    """A store at `path` of rows with `schema`, one for each `identity`, in Parquet or JSON lines."""

    def __init__(self, spark: SparkSession, path: str, schema: str, identity: list[str], kind: str = "parquet"):
        self.spark, self.path, self.identity, self.kind = spark, path.rstrip("/"), identity, kind
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.schema = f"{schema}, seq long"

    # versions

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, system = self._fs(f"{self.path}/{POINTERS}")
        if not system.exists(at):
            return []
        names = [f.getPath().getName() for f in system.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def _pointer(self, number: int) -> dict:
        at, system = self._fs(f"{self.path}/{POINTERS}/{number:012d}")
        stream = system.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        """Number and pointer of the version that readers see; 0 where nothing was saved."""
        own = self.versions()
        return (own[-1], self._pointer(own[-1])) if own else (0, {"data": None, "batches": {}, "rows": 0})

    def load(self, number: int | None = None) -> DataFrame:
        """Rows of the current or a given version, with seq."""
        pointer = self.current()[1] if number is None else self._pointer(number)
        if pointer["data"] is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.kind).load(f"{self.path}/{DATA}/{pointer['data']}")

    def _write_data(self, rows: DataFrame, name: str) -> None:
        writer = rows.write
        if self.kind == "json":
            writer = writer.option("ignoreNullFields", False)
        writer.format(self.kind).save(f"{self.path}/{DATA}/{name}")

    def _write_aside(self, text: str) -> str:
        aside = f"{self.path}/{POINTERS}/.{uuid.uuid4().hex}"
        at, system = self._fs(aside)
        stream = system.create(at)
        stream.write(bytearray(text.encode()))
        stream.close()
        return aside

    def _publish(self, aside: str, number: int) -> None:
        """Renames to the version's number; FileContext's rename refuses to replace a file."""
        jvm = self.spark._jvm
        (old, _), (new, _) = self._fs(aside), self._fs(f"{self.path}/{POINTERS}/{number:012d}")
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(old, new, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "exists" in str(e):
                raise Conflict(f"version {number} of {self.path} was saved by another writer") from e
            raise

    def save(self, change: Callable[[DataFrame, int], DataFrame], batch: tuple[str, int] | None = None, tries: int = 5) -> int:
        """Saves change(rows, number of the new version) as a new version and returns its number.

        batch: name of a stream and number of its batch; one that was applied already changes nothing. A conflict with
        another writer begins anew from what that one saved.
        """
        for attempt in range(tries):
            number, pointer = self.current()
            if batch and batch[1] <= pointer["batches"].get(batch[0], -1):
                return number
            name = f"{number + 1:012d}-{uuid.uuid4().hex}"
            self._write_data(change(self.load(number) if number else self.load(), number + 1).select(*self.columns, "seq"), name)
            batches = pointer["batches"] | ({batch[0]: batch[1]} if batch else {})
            rows = self.spark.read.schema(self.schema).format(self.kind).load(f"{self.path}/{DATA}/{name}").count()
            aside = self._write_aside(json.dumps({"data": name, "batches": batches, "rows": rows}))
            try:
                self._publish(aside, number + 1)
                return number + 1
            except Conflict:
                if attempt + 1 == tries:
                    raise
        raise Conflict(self.path)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last versions and what failed saves left; not while others write."""
        kept = self.versions()[-keep:]
        named = {self._pointer(n)["data"] for n in kept}
        for folder, wanted in ((POINTERS, {f"{n:012d}" for n in kept}), (DATA, named)):
            at, system = self._fs(f"{self.path}/{folder}")
            for found in system.listStatus(at) if system.exists(at) else []:
                if found.getPath().getName() not in wanted:
                    system.delete(found.getPath(), True)

    # changes

    def put(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Upserts rows; of rows with one identity the last in `order` counts, without one any, and all count after the store's."""
        own = [c for c in self.columns if c in rows.columns]

        def change(store: DataFrame, number: int) -> DataFrame:
            place = F.col(order) if order else F.lit(0)
            new = rows.select(*own, *(F.lit(None).alias(c) for c in self.columns if c not in own), F.struct(F.lit(number).cast("long").alias("seq"), place.cast("double").alias("nth")).alias("_at"))
            old = store.select(*self.columns, F.struct("seq", F.lit(0.0).alias("nth")).alias("_at"))
            rest = [c for c in self.columns if c not in self.identity]
            last = old.unionByName(new).groupBy(*self.identity).agg(F.max_by(F.struct(*rest, "_at"), F.struct("_at", *rest)).alias("last"))
            return last.select(*self.identity, *(F.col(f"last.{c}").alias(c) for c in rest), F.col("last._at.seq").alias("seq"))

        return self.save(change, batch)

    def remove(self, gone: Column | DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Deletes the rows that a condition or a table of identities names, and returns how many there were."""
        before = self.current()[1]["rows"]
        if isinstance(gone, DataFrame):
            ids = gone.select(*self.identity).distinct()
            number = self.save(lambda store, _: store.join(ids, self.identity, "left_anti"), batch)
        else:
            number = self.save(lambda store, _: store.where(~F.coalesce(gone, F.lit(False))), batch)
        return before - self._pointer(number)["rows"]

    def rows(self) -> int:
        """Number of rows, without reading any."""
        return self.current()[1]["rows"]
