"""Tables by key with versions: a replacement rewrites the files that hold a changed key and no other, and is seen whole or not at all.

A store is a folder. `data` holds Parquet files that never change; `versions/N.json` lists, for each table, its schema, its key and its files with the least
and greatest key of each. The newest version that can be read is the current one. A change writes new files, then publishes version N + 1 under a name
that must not exist yet: of two writers that began from version N one commits, the other gets Conflict and its files are never listed. A writer that dies half way
leaves files that no version lists; `vacuum` removes them. One version covers all tables, so a cascade over several is one commit.

Each file spans the keys from its least to its greatest. The files that may hold a key are found by binary search, and the rows of a rewritten file go to files of
their own, so spans hardly overlap, and a key with very many rows may fill several files, written by several tasks.

The driver holds a row a file, never a row of a table.

Defined results: a null key is refused; a table that is not there reads as an error; a change without rows or keys commits nothing; keys that are replaced by no row are
deleted; an empty table keeps its schema.
"""

from __future__ import annotations

import bisect
import itertools
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_A_FILE = 1_000_000


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Spans:
    """The files of a table in order of their least key."""

    def __init__(self, files: list[dict]) -> None:
        self.files = sorted(files, key=lambda f: (f["least"], f["most"], f["file"]))
        self.least = [f["least"] for f in self.files]
        self.most = [f["most"] for f in self.files]
        #: the greatest key up to each file
        self.upto = list(itertools.accumulate(self.most, max))

    def holding(self, key) -> list[int]:
        """The files whose span holds a key, the last first."""
        out, at = [], bisect.bisect_right(self.least, key) - 1
        while at >= 0 and self.upto[at] >= key:
            if self.most[at] >= key:
                out.append(at)
            at -= 1
        return out

    def home(self, key, touched: set[int]) -> int:
        """Where a row of a rewritten file, or a new one, goes: to the rewritten file that spans it, else to one of its own after the file before."""
        return next((k for k in self.holding(key) if k in touched), bisect.bisect_right(self.least, key) - 1)


class Store:
    """Tables under one path, all read and changed through one list of versions."""

    def __init__(self, spark: SparkSession, path: str, rows_a_file: int = ROWS_A_FILE) -> None:
        self.spark, self.path, self.rows_a_file = spark, path.rstrip("/"), rows_a_file
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # versions --------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> dict:
        """What a version lists; the newest without a number; nothing before the first."""
        known = self.versions()
        if number is None:
            number = known[-1] if known else 0
        if number == 0:
            return {"version": 0, "tables": {}, "marks": {}}
        stream = self._fs.open(self._path(self._name(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _name(self, number: int) -> str:
        return f"{self.path}/versions/{number:020d}.json"

    def _publish(self, listed: dict) -> None:
        """Writes a version aside and gives it its name, which fails where the name is taken."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        aside = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        try:
            out.write(json.dumps(listed).encode())
        finally:
            out.close()
        options = jvm.org.apache.hadoop.fs.Options
        none = gateway.new_array(options.Rename, 1)
        none[0] = options.Rename.NONE
        target = self._path(self._name(listed["version"]))
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, target, none)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(target):
                raise Conflict(f"version {listed['version']} is taken") from e
            raise

    # reading ---------------------------------------------------------------------------------------------------

    def tables(self, number: int | None = None) -> list[str]:
        return sorted(self.version(number)["tables"])

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of a version."""
        told = self.version(number)["tables"][name]
        return self._files(told, told["files"])

    def read_keys(self, name: str, keys: DataFrame, number: int | None = None) -> DataFrame:
        """The rows of a table whose key is in keys, from the files that may hold one."""
        told = self.version(number)["tables"][name]
        files = Spans(told["files"]).files
        return self._files(told, [files[k] for k in self._touched(told, keys)]).join(keys.select(told["key"]).distinct(), told["key"], "left_semi")

    def _files(self, told: dict, files: list[dict]) -> DataFrame:
        schema = StructType.fromJson(told["schema"])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f['file']}" for f in files])

    def _touched(self, told: dict, keys: DataFrame) -> list[int]:
        """The places, in the order of spans, of the files that may hold a key. At most a row a file comes to the driver."""
        spans = Spans(told["files"])
        if not spans.files:
            return []

        @F.pandas_udf("array<int>")
        def holding(values: pd.Series) -> pd.Series:
            return pd.Series([spans.holding(k) for k in values.tolist()])

        return sorted(r[0] for r in keys.select(F.explode(holding(F.col(told["key"]))).alias("k")).distinct().collect())

    # changing --------------------------------------------------------------------------------------------------

    def change(self, *changes: Change, base: dict | None = None, marks: dict[str, object] | None = None) -> int:
        """Commits changes of one or more tables as one version; its number. base: the version they were computed from.

        marks: values kept with the version, such as the last batch of a stream.
        """
        base = base or self.version()
        tables, changed = dict(base["tables"]), False
        for c in changes:
            found = c.apply(self, tables.get(c.name))
            if found is not None:
                tables[c.name], changed = found, True
        kept = base.get("marks", {}) | (marks or {})
        if not changed and kept == base.get("marks", {}):
            return base["version"]
        self._publish({"version": base["version"] + 1, "tables": tables, "marks": kept})
        return base["version"] + 1

    def _write(self, rows: DataFrame, key: str, slotted: bool, about: int) -> list[dict]:
        """Writes rows, about so many, as new files, those of different homes apart; their entries."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        order = ["__slot", key] if slotted else [key]
        # ties of the key are dealt by the row, so one key may fill several tasks
        spread = rows.withColumn("__deal", F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in rows.columns]))
        ranged = spread.repartitionByRange(max(1, -(-about // self.rows_a_file)), *order, "__deal").sortWithinPartitions(*order).drop("__deal")
        writer = ranged.write.option("maxRecordsPerFile", self.rows_a_file)
        (writer.partitionBy("__slot") if slotted else writer).parquet(folder)
        told = self.spark.read.schema(rows.drop("__slot").schema).option("recursiveFileLookup", True).parquet(folder).select(F.col(key).alias("k"), F.col("_metadata.file_path").alias("file"))
        found = told.groupBy("file").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count(F.lit(1)).alias("rows"), F.count("k").alias("keys")).collect()
        if any(r.rows > r.keys for r in found):
            self._fs.delete(self._path(folder), True)
            raise ValueError(f"a row has no {key}")
        name = folder.rsplit("/", 1)[1]
        return [{"file": f"{name}/{r.file.split(f'/{name}/', 1)[1]}", "least": r.least, "most": r.most, "rows": r.rows} for r in found]

    # upkeep ----------------------------------------------------------------------------------------------------

    def vacuum(self, keep: int = 2) -> int:
        """Removes all versions but the last `keep`, and the files that none of these lists; the number of files removed.

        Not while a writer is at work: files that it has not published yet would go.
        """
        known = self.versions()
        for number in known[:-keep]:
            self._fs.delete(self._path(self._name(number)), False)
        listed = {f["file"] for n in known[-keep:] for t in self.version(n)["tables"].values() for f in t["files"]}
        gone = 0
        for file in self._walk(f"{self.path}/data"):
            name = file.split("/data/", 1)[1]
            if name.endswith(".parquet") and name not in listed:
                gone += self._fs.delete(self._path(file), False)
        return gone

    def _walk(self, folder: str) -> Iterator[str]:
        top = self._path(folder)
        if self._fs.exists(top):
            found = self._fs.listFiles(top, True)
            while found.hasNext():
                yield found.next().getPath().toString()


class Change:
    """A table's change: rows take the place of all rows with their keys, and of those of `keys`."""

    def __init__(self, name: str, rows: DataFrame, key: str, keys: DataFrame | None = None, settled: bool = False) -> None:
        """key: a column of numbers or text; settled: rows are read from files already, so computing them twice gives the same."""
        self.name, self.rows, self.key, self.keys, self.settled = name, rows, key, keys, settled

    def apply(self, store: Store, told: dict | None) -> dict | None:
        """The table's new entry; null where nothing changes."""
        schema = StructType.fromJson(told["schema"]) if told else self.rows.schema
        if told and told["key"] != self.key:
            raise ValueError(f"{self.name} is kept by {told['key']}")
        # the new rows are computed once, aside: what tells the slots is what is written
        aside = f"{store.path}/data/incoming-{uuid.uuid4().hex}"
        try:
            rows = self.rows.select(*schema.names)
            if not self.settled:
                rows.write.parquet(aside)
                rows = store.spark.read.schema(rows.schema).parquet(aside)
            n = rows.count()
            if told is None:
                return {"schema": json.loads(schema.json()), "key": self.key, "files": store._write(rows, self.key, False, n)}
            gone = rows.select(self.key)
            if self.keys is not None:
                gone = gone.unionByName(self.keys.select(F.col(self.key).cast(schema[self.key].dataType)))
            gone = gone.distinct()
            touched = set(store._touched(told, gone.filter(F.col(self.key).isNotNull())))
            if not n and not touched:
                return None
            spans = Spans(told["files"])
            before = [spans.files[k] for k in sorted(touched)]
            after = store._files(told, before).join(gone, self.key, "left_anti").select(*schema.names).unionByName(rows)

            @F.pandas_udf("int")
            def home(values: pd.Series) -> pd.Series:
                return pd.Series([-1 if k is None or k != k else spans.home(k, touched) for k in values.tolist()], dtype="int32")

            new = store._write(after.withColumn("__slot", home(F.col(self.key))), self.key, True, n + sum(f["rows"] for f in before))
        finally:
            store._fs.delete(store._path(aside), True)
        return told | {"files": [f for k, f in enumerate(spans.files) if k not in touched] + new}
