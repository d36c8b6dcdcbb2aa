"""Layered tables on Parquet: loads of raw tables, versions of all others.

What a load or a version holds is told by one small JSON file beside it, which
the driver reads through the file system: no job and no data file is needed to
know a table's schema, files, buckets and statistics.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from layerkit.functions.columns import as_list, col
from layerkit.sources import files
from layerkit.sources.sinks import write_partitioned

# Partition column of a bucketed table, and the folders of what the store notes for itself.
BUCKET = "_bucket"
_VERSIONS, _LOADS = "_versions", "_loads"
# Loads whose notes the driver reads one by one; more are read by a Spark job.
_FEW_LOADS = 200


class ConcurrentWrite(RuntimeError):
    """Another writer has taken the version this one meant to write."""


@dataclass
class Version:
    """One version of a table, as its JSON file tells."""

    number: int
    folder: str
    schema: T.StructType
    notes: dict[str, str] = field(default_factory=dict)
    # Of a table in key buckets: their number, and by bucket the folder and bytes it has.
    count: int = 0
    buckets: dict[int, tuple[str, int]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({
            "number": self.number, "folder": self.folder, "schema": self.schema.jsonValue(), "notes": self.notes,
            "count": self.count, "buckets": {str(b): list(v) for b, v in self.buckets.items()},
        })

    @staticmethod
    def of(text: str) -> Version:
        raw = json.loads(text)
        buckets = {int(b): (folder, size) for b, (folder, size) in raw["buckets"].items()}
        return Version(raw["number"], raw["folder"], T.StructType.fromJson(raw["schema"]), raw["notes"], raw["count"], buckets)

    def folders(self) -> set[str]:
        return {self.folder, *(folder for folder, _ in self.buckets.values())}


@dataclass
class Load:
    """One load of a raw table: its folder, schema, and per file bytes, rows and ends of some columns."""

    name: str
    order: int
    schema: T.StructType
    files: list[dict]

    def text(self) -> str:
        return json.dumps({"name": self.name, "order": self.order, "schema": self.schema.jsonValue(), "files": self.files})

    @staticmethod
    def of(text: str) -> Load:
        raw = json.loads(text)
        return Load(raw["name"], raw["order"], T.StructType.fromJson(raw["schema"]), raw["files"])


class TableStore:
    """Tables of one lakehouse folder.

    A raw table is a folder of loads. Any other table is a folder of versions: a
    version counts once its JSON file is there, so a reader never sees half a
    write and a table may be rebuilt from itself. That file is created only
    where none is: of two writers of one version, the second raises and its rows
    are removed. A version is whole, or, of a table merged by key, holds the key
    buckets that changed.
    """

    RAW = "bronze_"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # --- Versions ---

    def _numbers(self, name: str) -> list[int]:
        found = files.names(self.spark, f"{self.path(name)}/{_VERSIONS}")
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and not n.startswith("."))

    def _read_version(self, name: str, number: int) -> Version | None:
        """A version; none where its file is only half written."""
        try:
            return Version.of(files.read_text(self.spark, f"{self.path(name)}/{_VERSIONS}/{number}.json"))
        except json.JSONDecodeError:
            return None

    def state(self, name: str, number: int | None = None) -> Version | None:
        """The current, or one certain, version; none when it was never written."""
        for n in [number] if number else reversed(self._numbers(name)):
            found = self._read_version(name, n)
            if found:
                return found
        return None

    def version(self, name: str) -> int:
        """Current version of a table; 0 when it was never written."""
        found = self.state(name)
        return found.number if found else 0

    def exists(self, name: str) -> bool:
        return files.exists(self.spark, self.path(name)) if name.startswith(self.RAW) else self.version(name) > 0

    def read(self, name: str, version: int | None = None) -> DataFrame:
        if name.startswith(self.RAW):
            return self.read_bronze(name)
        found = self.state(name, version)
        if not found:
            raise ValueError(f"no table {name}")
        return self.read_state(name, found)

    def read_state(self, name: str, found: Version, buckets: Iterable[int] | None = None) -> DataFrame:
        """A version, or some of its buckets, each from the version that wrote it."""
        reader = self.spark.read.schema(found.schema)
        if not found.count:
            return reader.parquet(f"{self.path(name)}/{found.folder}")
        wanted = sorted(found.buckets) if buckets is None else sorted(set(buckets) & set(found.buckets))
        paths = [f"{self.path(name)}/{found.buckets[b][0]}/{BUCKET}={b}" for b in wanted]
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], found.schema)

    def notes(self, name: str) -> dict[str, str]:
        """What the writers of the current version have noted beside it; of a table never written, nothing."""
        found = self.state(name)
        return dict(found.notes) if found else {}

    def bucket_count(self, name: str) -> int:
        """Buckets of a table's current version; 0 when it is not bucketed."""
        found = self.state(name)
        return found.count if found else 0

    def write_silver(
        self, df: DataFrame, name: str, partition_by: Iterable[str] = (), notes: Mapping[str, str] | None = None
    ) -> DataFrame:
        """Replace a table: write the next version whole, then let readers switch to it.

        The version that readers may still use stays; older ones are removed.
        ``notes``, a few pairs of texts, are part of the version; without any,
        those of the last version are carried on.
        """
        before = self.state(name)
        folder, partition_by = self._new_folder(before), as_list(partition_by)
        path = f"{self.path(name)}/{folder}"
        if partition_by:
            write_partitioned(df, path, partition_by)
        else:
            df.write.parquet(path)
        # As read back: partition columns come last.
        fields = sorted(df.schema.fields, key=lambda f: f.name in partition_by)
        kept = dict(notes) if notes is not None else before.notes if before else {}
        self._publish(name, before, Version(0, folder, T.StructType(fields), kept))
        return self.read(name)

    def write_buckets(
        self, df: DataFrame, name: str, before: Version | None, count: int, schema: T.StructType, replaced: Iterable[int], notes: Mapping[str, str]
    ) -> DataFrame:
        """The next version of a table in ``count`` buckets: ``df`` holds those that are new in full, with their number.

        ``replaced`` are buckets of ``before`` whose rows are all in ``df``; the others stay where they are.
        """
        folder, replaced = self._new_folder(before), {*replaced}
        write_partitioned(df, f"{self.path(name)}/{folder}", BUCKET)
        sizes: dict[int, int] = {}
        for path, size in files.file_bytes(self.spark, f"{self.path(name)}/{folder}").items():
            bucket = int(path.rsplit(f"/{BUCKET}=", 1)[1].split("/")[0])
            sizes[bucket] = sizes.get(bucket, 0) + size
        held = {b: v for b, v in before.buckets.items() if b not in replaced} if before else {}
        if held.keys() & sizes.keys():
            raise RuntimeError(f"{name}: rows of buckets {sorted(held.keys() & sizes.keys())} that were not read")
        new = Version(0, folder, schema, dict(notes), count, held | {b: (folder, size) for b, size in sizes.items()})
        return self.read_state(name, self._publish(name, before, new))

    def _new_folder(self, before: Version | None) -> str:
        return f"data-{(before.number if before else 0) + 1}-{uuid.uuid4().hex[:12]}"

    def _publish(self, name: str, before: Version | None, new: Version) -> Version:
        """Let a written version count, unless another writer was first."""
        base, numbers = before.number if before else 0, self._numbers(name)
        above = [n for n in numbers if n > base]
        # A file that a lost writer left half written keeps its number; a whole one is another writer's version.
        new.number = max([base, *above]) + 1
        late = any(self._read_version(name, n) for n in above)
        if late or not files.write_text(self.spark, f"{self.path(name)}/{_VERSIONS}/{new.number}.json", new.text()):
            files.delete(self.spark, f"{self.path(name)}/{new.folder}")
            raise ConcurrentWrite(f"{name}: another writer has added a version behind {base}")
        kept = new.folders() | (before.folders() if before else set())
        for n in numbers:
            if n < base:
                old = self._read_version(name, n)
                for folder in (old.folders() if old else set()) - kept:
                    files.delete(self.spark, f"{self.path(name)}/{folder}")
                files.delete(self.spark, f"{self.path(name)}/{_VERSIONS}/{n}.json")
        return new

    # --- Loads of raw tables ---

    def loads(self, name: str) -> list[Load]:
        """The loads of a raw table in the order they came."""
        folder = f"{self.path(name)}/{_LOADS}"
        found = [n for n in files.names(self.spark, folder) if n.endswith(".json") and not n.startswith(".")]
        if len(found) > _FEW_LOADS:
            texts = [r.value for r in self.spark.read.text([f"{folder}/{n}" for n in found], wholetext=True).collect()]
        else:
            texts = [files.read_text(self.spark, f"{folder}/{n}") for n in found]
        return sorted(map(Load.of, texts), key=lambda load: (load.order, load.name))

    def raw_rows(self, name: str) -> int:
        """Rows of a raw table, from the notes of its loads."""
        return sum(f["rows"] for load in self.loads(name) for f in load.files)

    def write_bronze(self, df: DataFrame, name: str, load: str | None = None, ends: Iterable[str] = ("_load_timestamp",)) -> None:
        """Add a load to a raw table; new columns are taken over.

        Beside it lie its schema and, per file, bytes, rows and the least and
        greatest value of the columns ``ends`` that it has: one scan of those
        columns after the write. A ``load`` of a given name replaces the one of
        that name, so a repeated attempt adds nothing twice.
        """
        if not name.startswith(self.RAW):
            raise ValueError(f"raw tables are named {self.RAW}...")
        folder = load or f"load-{uuid.uuid4().hex}"
        path = f"{self.path(name)}/{folder}"
        before = self.loads(name)
        _merged_schema([*(x.schema for x in before if x.name != folder), df.schema])
        df.write.mode("overwrite").parquet(path)
        order = next((x.order for x in before if x.name == folder), max((x.order for x in before), default=0) + 1)
        noted = Load(folder, order, df.schema, self._described(path, df.schema, [c for c in as_list(ends) if c in df.columns]))
        files.write_text(self.spark, f"{self.path(name)}/{_LOADS}/{folder}.json", noted.text(), replace=True)

    def _described(self, path: str, schema: T.StructType, ends: list[str]) -> list[dict]:
        written = files.file_bytes(self.spark, path)
        if not written:
            return []
        kinds = {f.name: f.dataType for f in schema.fields}
        ends = [c for c in ends if isinstance(kinds[c], T.AtomicType) and not isinstance(kinds[c], T.BinaryType)]
        df = self.spark.read.schema(schema).parquet(path).withColumn("__file", F.input_file_name())
        shown = [_text(f(col(c)), kinds[c]).alias(f"{mark}{i}") for i, c in enumerate(ends) for f, mark in ((F.min, "low"), (F.max, "high"))]
        rows = df.groupBy("__file").agg(F.count(F.lit(1)).alias("n"), *shown).collect()  # one per file
        found = {r["__file"].rsplit("/", 1)[-1]: r for r in rows}
        out = []
        for file, size in sorted(written.items()):
            # A file without rows has no group.
            row = found.get(file.rsplit("/", 1)[-1])
            out.append({
                "file": file.rsplit("/", 1)[-1], "bytes": size, "rows": row["n"] if row else 0,
                "ends": {c: [row[f"low{i}"], row[f"high{i}"]] for i, c in enumerate(ends)} if row else {},
            })
        return out

    def read_bronze(self, name: str) -> DataFrame:
        """A raw table with every column any load has brought; no file is opened to learn the schema."""
        self._check_raw(name)
        loads = self.loads(name)
        if not loads:  # written by others
            return self.spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(self.path(name))
        return self._read_loads(name, loads, [f"{self.path(name)}/{x.name}" for x in loads if x.files])

    def read_since(self, name: str, column: str, value) -> DataFrame:
        """Rows of a raw table whose ``column`` is above ``value``; files that hold none are not opened.

        A file without noted ends of the column is read.
        """
        self._check_raw(name)
        value = value if isinstance(value, Column) else F.lit(value)
        loads = self.loads(name)
        if not loads:
            return self.read_bronze(name).filter(col(column) > value)
        schema = _merged_schema(x.schema for x in loads)
        if column not in schema.names:
            raise ValueError(f"no such column: {column}")
        kind = schema[column].dataType
        listed = [
            (f"{self.path(name)}/{x.name}/{f['file']}", column in f["ends"], f["ends"].get(column, [None, None])[1])
            for x in loads if column in x.schema.names for f in x.files if f["rows"]
        ]
        marked = self.spark.createDataFrame(listed, "path string, noted boolean, high string")
        held = marked.filter(~F.col("noted") | (_value(F.col("high"), kind) > value)).select("path").collect()
        return self._read_loads(name, loads, [r.path for r in held]).filter(col(column) > value)

    def _check_raw(self, name: str) -> None:
        if not name.startswith(self.RAW):
            raise ValueError(f"{name} is not a raw table: cleaned tables are built from raw ones only")

    def _read_loads(self, name: str, loads: list[Load], paths: list[str]) -> DataFrame:
        schema = _merged_schema(x.schema for x in loads)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def _text(c: Column, kind: T.DataType) -> Column:
    """A value as text that :func:`_value` reads back: an instant as microseconds, whatever the time zone."""
    return (F.unix_micros(c) if isinstance(kind, T.TimestampType) else c).cast("string")


def _value(text: Column, kind: T.DataType) -> Column:
    return F.timestamp_micros(text.cast("long")) if isinstance(kind, T.TimestampType) else text.cast(kind)


_WIDER = [[T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()], [T.FloatType(), T.DoubleType()]]


def _merged_schema(schemas: Iterable[T.StructType]) -> T.StructType:
    """All columns in the order they came; of whole numbers and of fractions the wider type, other types must agree."""
    found: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            kind = found.setdefault(f.name, f.dataType)
            if kind != f.dataType:
                line = next((w for w in _WIDER if kind in w and f.dataType in w), None)
                if line is None:
                    raise ValueError(f"column {f.name} is {kind.simpleString()} in one load and {f.dataType.simpleString()} in another")
                found[f.name] = max(kind, f.dataType, key=line.index)
    return T.StructType([T.StructField(n, kind) for n, kind in found.items()])
