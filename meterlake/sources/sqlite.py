"""Rows of embedded SQLite stores as Python data sources.

The file is one that the tasks can open (a shared folder, or local mode); it is opened read-only. Partitions are ranges of
the key, each read by an indexed seek, so a store of any size is many tasks. A store is followed by its watermark: what was
updated after it, and what was updated at the same instant but is not among the ids already taken.
"""

from __future__ import annotations

import json
import math
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MESSAGES = "rowid long, id string, session_id string, time_created long, time_updated long, data string, session_directory string, session_parent_id string"
KEY_VALUES = "key string, value string"
HEADERS = "composer string, workspace string, created_ms long"
_JOIN = "SELECT m.rowid, m.id, m.session_id, m.time_created, m.time_updated, m.data, s.directory, s.parent_id FROM message m LEFT JOIN session s ON s.id = m.session_id"


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True, timeout=5)


class Range(InputPartition):
    def __init__(self, low: object, high: object, after: int | None = None, taken: tuple[str, ...] = (), until: int | None = None) -> None:
        self.low, self.high, self.after, self.taken, self.until = low, high, after, taken, until


def rowid_ranges(path: str, rows: int) -> list[tuple[int, int]]:
    with opened(path) as db:
        low, high = db.execute("SELECT min(rowid), max(rowid) FROM message").fetchone()
    return [] if low is None else [(a, min(a + rows, high + 1)) for a in range(low, high + 1, rows)]


class MessageReader(DataSourceReader):
    """All messages with their session, in ranges of rowid."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], int(options.get("rowsPerPartition", 100_000))

    def partitions(self) -> list[Range]:
        return [Range(a, b) for a, b in rowid_ranges(self.path, self.rows)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        # Spark reads None where there is no partition.
        if partition is None:
            return
        with opened(self.path) as db:
            yield from db.execute(f"{_JOIN} WHERE m.rowid >= ? AND m.rowid < ? ORDER BY m.rowid", (partition.low, partition.high))


class MessageStream(DataSourceStreamReader):
    """Messages that were updated since the last batch.

    An offset is the watermark (the latest update taken), the ids taken at that instant, and the generation (number of
    rows and latest update): a store whose generation went back was replaced, and is read from its start.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], int(options.get("rowsPerPartition", 100_000))

    def initialOffset(self) -> dict:
        return {"watermark": -1, "taken": [], "count": 0}

    def latestOffset(self) -> dict:
        with opened(self.path) as db:
            n, latest = db.execute("SELECT count(*), coalesce(max(time_updated), -1) FROM message").fetchone()
            taken = [r[0] for r in db.execute("SELECT id FROM message WHERE time_updated = ? ORDER BY id", (latest,))]
        return {"watermark": latest, "taken": taken, "count": n}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        replaced = end["count"] < start["count"] or end["watermark"] < start["watermark"]
        after, taken = (-1, ()) if replaced else (start["watermark"], tuple(start["taken"]))
        return [Range(a, b, after, taken, end["watermark"]) for a, b in rowid_ranges(self.path, self.rows)]

    def read(self, partition: Range) -> Iterator[tuple]:
        p = partition
        with opened(self.path) as db:
            sql = f"{_JOIN} WHERE m.rowid >= ? AND m.rowid < ? AND m.time_updated <= ? AND (m.time_updated > ? OR (m.time_updated = ? AND m.id NOT IN (SELECT value FROM json_each(?)))) ORDER BY m.rowid"
            yield from db.execute(sql, (p.low, p.high, p.until, p.after, p.after, json.dumps(p.taken)))


class Messages(DataSource):
    """spark.read.format("sqlite_messages").load(path), or readStream."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_messages"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema: object) -> DataSourceReader:
        return MessageReader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return MessageStream(self.options)


def state(path: str, table: str) -> str:
    """"no-database", "no-table" or "ready", where the store is."""
    if not os.path.exists(path.removeprefix("file://")):
        return "no-database"
    with opened(path) as db:
        return "ready" if db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone() else "no-table"


def key_ranges(path: str, table: str, key: str, prefix: str, rows: int) -> list[tuple[str, str | None]]:
    """Half-open ranges of the keys with a prefix that hold equally many of them, at most so many rows each.

    The boundaries are keys of the store, told by one pass over the key's index; values are not read. The ranges tile the prefix,
    so a key that is added after they are made is in one of them.
    """
    until = prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix else None
    some = f"FROM {table} WHERE {key} >= ?1 AND (?2 IS NULL OR {key} < ?2)"
    with opened(path) as db:
        n = db.execute(f"SELECT count(*) {some}", (prefix, until)).fetchone()[0]
        if not n:
            return []
        # Key i of n is in part i * parts / n; a part's first key is its boundary.
        parts = -(-n // rows)
        numbered = f"SELECT {key} AS k, row_number() OVER (ORDER BY {key}) - 1 AS i {some}"
        cuts = db.execute(f"SELECT DISTINCT k FROM ({numbered}) WHERE i > 0 AND i * ?3 / ?4 > (i - 1) * ?3 / ?4 ORDER BY k", (prefix, until, parts, n))
        cuts = [prefix, *(k for (k,) in cuts)]
    return list(zip(cuts, [*cuts[1:], until], strict=True))


class KeyedReader(DataSourceReader):
    """Rows of a table whose text keys have a prefix, in ranges of equally many keys. A table that is not there has no rows."""

    def __init__(self, options: dict[str, str], table: str, key: str, values: tuple[str, ...]) -> None:
        self.path, self.table, self.key, self.values = options["path"], options.get("table", table), key, values
        self.prefix, self.rows = options.get("prefix", ""), int(options.get("rowsPerPartition", 10_000))
        if not self.table.isidentifier():
            raise ValueError(f"no table: {self.table}")

    def partitions(self) -> list[Range]:
        if state(self.path, self.table) == "no-table":
            return []
        return [Range(a, b) for a, b in key_ranges(self.path, self.table, self.key, self.prefix, self.rows)]

    def rows_of(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:
            return
        with opened(self.path) as db:
            where = f"{self.key} >= ?1 AND (?2 IS NULL OR {self.key} < ?2)"
            yield from db.execute(f"SELECT {', '.join((self.key, *self.values))} FROM {self.table} WHERE {where} ORDER BY {self.key}, rowid", (partition.low, partition.high))


class KeyValueReader(KeyedReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options, "cursorDiskKV", "key", ("value",))

    def read(self, partition: Range | None) -> Iterator[tuple]:
        for key, value in self.rows_of(partition):
            yield key, value.decode("utf-8", "replace") if isinstance(value, bytes) else None if value is None else str(value)


class HeaderReader(KeyedReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options, "composerHeaders", "composerId", ("workspaceId", "createdAt"))

    def read(self, partition: Range | None) -> Iterator[tuple]:
        """Of rows of one conversation, which are side by side, the last."""
        last = None
        for composer, workspace, created in self.rows_of(partition):
            if last and last[0] != composer:
                yield last
            at = int(created) if isinstance(created, (int, float)) and math.isfinite(created) else None
            last = composer, None if workspace is None else str(workspace), at
        if last:
            yield last


class KeyValues(DataSource):
    """spark.read.format("sqlite_keys").option("prefix", "bubbleId:").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_keys"

    def schema(self) -> str:
        return KEY_VALUES

    def reader(self, schema: object) -> DataSourceReader:
        return KeyValueReader(self.options)


class Headers(DataSource):
    """spark.read.format("sqlite_headers").load(path): the workspace and the time of each conversation."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: object) -> DataSourceReader:
        return HeaderReader(self.options)
