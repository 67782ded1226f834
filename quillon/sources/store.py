"""Entity storage: immutable parquet files and numbered manifests.

A version of an entity is a manifest `_versions/00000007.json` that lists its files and schema. Inserts
add files; updates and deletes write anew only the files that hold touched rows. A commit creates the next
manifest under a name that must not exist, so that of two writers one wins and readers never see half a
change. Files keep the field names they were written with; reading maps renames and adds defaults.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.errors import refuse
from quillon.functions.schema import EntitySchema
from quillon.sources.files import Files


@dataclass(frozen=True)
class Snapshot:
    number: int
    schema: EntitySchema
    files: tuple[str, ...]  # relative to the entity's folder
    sequence: int = 0  # of identity fields


class Store:
    """Entities under a folder: journaled ones under root, heap ones in a folder of the session's own."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.files = spark, Files(spark)
        self._root, self._heap = root.rstrip("/") if root else None, None

    def _own(self, label: str) -> str:
        """A new folder in the one that the cluster shares; a local one only where none is set."""
        shared = self.spark.conf.get("spark.checkpoint.dir", None)
        return f"{shared.rstrip('/')}/quillon-{label}-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix=f"quillon-{label}-")

    @property
    def root(self) -> str:
        self._root = self._root or self._own("journal")
        return self._root

    @property
    def heap(self) -> str:
        self._heap = self._heap or self._own("heap")
        return self._heap

    def home(self, schema: EntitySchema) -> str:
        return f"{self.root if schema.store == 'journaled' else self.heap}/{schema.name}"

    def find(self, name: str) -> list[str]:
        return [f"{top}/{n}" for top in (self.root, self.heap) for n in self.files.names(top) if n.lower() == name.lower()]

    def names(self) -> list[str]:
        return sorted({n for top in (self.root, self.heap) for n in self.files.names(top)})

    def current(self, home: str) -> Snapshot:
        last = [n for n in self.files.names(f"{home}/_versions") if n.endswith(".json")][-1]
        d = json.loads(self.files.read(f"{home}/_versions/{last}"))
        return Snapshot(d["number"], EntitySchema.from_json(d["schema"]), tuple(d["files"]), d["sequence"])

    def commit(self, schema: EntitySchema, number: int, files: tuple[str, ...], sequence: int = 0) -> Snapshot:
        body = json.dumps({"number": number, "schema": schema.to_json(), "files": list(files), "sequence": sequence})
        if not self.files.create(f"{self.home(schema)}/_versions/{number:08d}.json", body):
            refuse("conflict", f"{schema.name} has changed since version {number - 1}")
        return Snapshot(number, schema, files, sequence)

    def write(self, schema: EntitySchema, df: DataFrame, number: int) -> tuple[str, ...]:
        """New files with the rows of df, for version number."""
        part = f"data/{number:08d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.home(schema)}/{part}")
        return tuple(f"{part}/{n}" for n in self.files.names(f"{self.home(schema)}/{part}") if n.startswith("part-"))

    def read(self, snap: Snapshot, files: tuple[str, ...] | None = None, with_file: bool = False) -> DataFrame:
        """Rows of a version, or of some of its files; with_file adds the column __file."""
        schema, files = snap.schema, snap.files if files is None else files
        if not files:
            df = self.spark.createDataFrame([], schema.spark())
            return df.withColumn("__file", F.lit("")) if with_file else df
        written = {n: f.spark_type() for f in schema.fields for n in dict.fromkeys((f.name, f.source or f.name))}
        declared = T.StructType([T.StructField(n, t) for n, t in written.items()])  # a file without a column gives nulls
        raw = self.spark.read.schema(declared).parquet(*[f"{self.home(schema)}/{f}" for f in files])
        cols = []
        for f in schema.fields:
            old = f.source or f.name
            have = [n for n in (f.name, old) if n in raw.columns]
            value = F.coalesce(*[raw[n] for n in dict.fromkeys(have)]) if have else F.lit(None)
            if f.since and f.added_default is not None:
                written = F.regexp_extract("_metadata.file_path", r"/data/(\d+)-", 1).cast("long")
                value = F.when(written < f.since, F.lit(f.added_default).cast(f.spark_type())).otherwise(value.cast(f.spark_type()))
            cols.append(value.cast(f.spark_type()).alias(f.name))
        return raw.select(*cols, *([F.concat(F.lit("data/"), F.element_at(F.split("_metadata.file_path", "/data/"), -1)).alias("__file")] if with_file else []))
