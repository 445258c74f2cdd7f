"""Tables in parts below one folder, switched by commits: readers see all of a change or nothing of it.

A change writes Parquet below folders of its own (table/commit=n/part=p). The commit is one small file that names for every
part of every table the folders that hold it, written aside and renamed at the end. What a crash leaves behind is
named by no commit. Of two changes that began from one commit, the later one fails and can be made again. Appended
parts grow by folders, and a part of too many is written anew. Nothing of a part is read to append to it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Folders of a part from which on it is written anew.
MOST_FOLDERS = 8


def part_of(key: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


@dataclass
class Held:
    """A table as of a commit: its schema, and the folders of each part that has any."""

    schema: str
    parts: dict[int, list[str]] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str, parts: int = 64) -> None:
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        """Numbers of the commits that are kept, oldest first."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def tables(self, number: int | None = None) -> dict[str, Held]:
        """The tables as of a commit, the newest if none is named."""
        known = self.commits()
        if not known:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/commits/{known[-1] if number is None else number}.json"))
        try:
            raw = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return {name: Held(t["schema"], {int(p): f for p, f in t["parts"].items()}) for name, t in raw.items()}

    def load(self, name: str, held: Held | None, parts: list[int] | None = None, with_part: bool = False) -> DataFrame | None:
        """The rows of a table, or of some of its parts, which alone are read; None for a table that was never written."""
        if held is None:
            return None
        schema = StructType.fromJson(json.loads(held.schema))
        folders = [f"{self.root}/{f}" for p, found in sorted(held.parts.items()) if parts is None or p in parts for f in found]
        dealt = StructType([*schema.fields, StructField("commit", StringType()), StructField("part", IntegerType())])
        rows = self.spark.read.schema(dealt).option("basePath", f"{self.root}/{name}").parquet(*folders) if folders else self.spark.createDataFrame([], dealt)
        return rows.drop("commit") if with_part else rows.drop("commit", "part")

    def read(self, name: str, parts: list[int] | None = None, number: int | None = None) -> DataFrame | None:
        return self.load(name, self.tables(number).get(name), parts)

    def begin(self) -> Change:
        return Change(self)

    def compact(self, most: int = MOST_FOLDERS) -> None:
        """Writes the parts anew that lie in too many folders, a table at a time."""
        for name, held in self.tables().items():
            crowded = [p for p, found in held.parts.items() if len(found) > most]
            if crowded:
                change = self.begin()
                change.replace(name, self.load(name, held, crowded, with_part=True), crowded)
                change.commit()

    def vacuum(self, keep: int = 2) -> None:
        """Deletes commits but for the newest, and the folders that none of those names. Not while a change is under way."""
        known = self.commits()
        stay = {f"{self.root}/{f}" for n in known[-keep:] for t in self.tables(n).values() for found in t.parts.values() for f in found}
        for n in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/commits/{n}.json"), False)
        for table in self._fs.listStatus(self._path(self.root)):
            name = table.getPath().getName()
            for commit in self._fs.listStatus(table.getPath()) if name != "commits" else ():
                below = f"{self.root}/{name}/{commit.getPath().getName()}"
                for part in self._fs.listStatus(commit.getPath()):
                    if f"{below}/{part.getPath().getName()}" not in stay:
                        self._fs.delete(part.getPath(), True)
                if not self._fs.listStatus(commit.getPath()):
                    self._fs.delete(commit.getPath(), True)


class Change:
    """What one commit will switch; until then nobody sees it."""

    def __init__(self, store: Store) -> None:
        self.store, self.tables, known = store, store.tables(), store.commits()
        self.number, self.writes = (known[-1] if known else 0) + 1, 0

    def read(self, name: str, parts: list[int] | None = None) -> DataFrame | None:
        """A table with what this change has done to it so far."""
        return self.store.load(name, self.tables.get(name), parts)

    def _write(self, name: str, rows: DataFrame, dealt: bool = False) -> dict[int, list[str]]:
        self.writes += 1
        s, base = self.store, f"{name}/commit={self.number}-{self.writes}"
        # A crashed change of the same number may have left files.
        (rows if dealt else rows.hint("rebalance", F.col("part"))).write.partitionBy("part").mode("overwrite").parquet(f"{s.root}/{base}")
        found = [x.getPath().getName() for x in s._fs.listStatus(s._path(f"{s.root}/{base}"))]
        return {int(n.removeprefix("part=")): [f"{base}/{n}"] for n in found if n.startswith("part=")}

    def _schema(self, rows: DataFrame) -> str:
        return json.dumps(StructType([f for f in rows.schema if f.name != "part"]).jsonValue())

    def append(self, name: str, rows: DataFrame, key: Column | str | None) -> list[int]:
        """Adds rows to the parts that their key says, and gives those; without any row nothing changes. Rows without a key name
        their part themselves, and are dealt by it already."""
        written = self._write(name, rows if key is None else rows.withColumn("part", part_of(key, self.store.parts)), key is None)
        if not written:
            self.writes -= 1
            return []
        held = self.tables.setdefault(name, Held(""))
        # Columns that came later are null in what is older.
        held.schema = self._schema(rows)
        for p, folders in written.items():
            held.parts[p] = held.parts.get(p, []) + folders
        return sorted(written)

    def replace(self, name: str, rows: DataFrame, parts: list[int] | None = None, key: Column | str | None = None) -> None:
        """Puts rows in the place of some parts, or of the whole table; rows without a key name their part themselves."""
        rows = rows if key is None else rows.withColumn("part", part_of(key, self.store.parts))
        written = self._write(name, rows)
        before = self.tables[name].parts if name in self.tables else {}
        self.tables[name] = Held(self._schema(rows), {p: f for p, f in before.items() if parts is not None and p not in parts} | written)

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)

    def commit(self) -> int:
        s = self.store
        folder, aside = f"{s.root}/commits", f"{s.root}/commits/.{self.number}.part"
        s._fs.mkdirs(s._path(folder))
        out = s._fs.create(s._path(aside), True)
        try:
            raw = {n: {"schema": t.schema, "parts": {str(p): f for p, f in t.parts.items()}} for n, t in self.tables.items()}
            out.write(bytearray(json.dumps(raw).encode()))
        finally:
            out.close()
        target = s._path(f"{folder}/{self.number}.json")
        if s._fs.exists(target) or not s._fs.rename(s._path(aside), target):
            raise RuntimeError(f"commit {self.number} was made by another change; begin again")
        return self.number
