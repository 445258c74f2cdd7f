"""Growing log files as a stream of finished lines.

An offset holds for each file where its last finished line ends, its size and its time of change. A last line without a line
feed waits. What has not changed is not read; a file that was read to its end and has another signature was rewritten, and
is read from its start. New bytes of a file are dealt into ranges, each a task of its own; a range that cannot be read
becomes a row with its error, and the others go on. Files are on a disk that driver and tasks share.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINE = "file string, at long, text string, error string"
CHUNK = 1 << 18


def end_of_lines(path: str, size: int) -> int:
    """The place after the last line feed, looked for from the end."""
    with open(path, "rb") as f:
        while size > 0:
            start = max(0, size - CHUNK)
            f.seek(start)
            last = f.read(size - start).rfind(b"\n")
            if last >= 0:
                return start + last + 1
            size = start
    return 0


class Lines(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int) -> None:
        self.path, self.first, self.start, self.end = path, first, start, end


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.glob, self.bytes = options["path"].removeprefix("file://"), options.get("glob", "*.jsonl"), int(options.get("bytesPerPartition", 32 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for top, _, names in os.walk(self.folder):
            for path in (os.path.join(top, n) for n in sorted(fnmatch.filter(names, self.glob))):
                try:
                    s = os.stat(path)
                    found[path] = [end_of_lines(path, s.st_size), s.st_size, s.st_mtime_ns]
                except OSError:
                    continue  # gone, or not readable now: its last good offset stands in the checkpoint
        return found

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        out = []
        for path, (upto, size, time) in sorted(end.items()):
            cursor, old_size, old_time = start.get(path, [0, -1, -1])
            rewritten = cursor > upto or (cursor >= size and (size, time) != (old_size, old_time))
            first = 0 if rewritten else cursor
            out += [Lines(path, first, a, min(a + self.bytes, upto)) for a in range(first, upto, self.bytes)]
        return out

    def read(self, partition: Lines) -> Iterator[tuple]:
        p = partition
        try:
            with open(p.path, "rb") as f:
                if p.start > p.first:
                    f.seek(p.start - 1)
                    f.readline()
                else:
                    f.seek(p.start)
                while (at := f.tell()) < p.end:
                    yield p.path, at, f.readline().decode("utf-8", "replace").removesuffix("\n").removesuffix("\r"), None
        except OSError as e:
            yield p.path, p.start, None, str(e)


class LineSource(DataSource):
    """spark.readStream.format("finished_lines").option("glob", "*.jsonl").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "finished_lines"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return LineReader(self.options)


def stream(spark: SparkSession, folder: str, glob: str = "*.jsonl", **options: str) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.readStream.format("finished_lines").options(glob=glob, **options).load(folder)


def numbered(batch: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """file, ordinal, text of a batch of lines, counted on from the lines of the batches before (file, lines).

    A batch with the first byte of a file counts from 1 again.
    """
    own = Window.partitionBy("file")
    rows = batch.where("error IS NULL").withColumns({"n": F.row_number().over(own.orderBy("at")), "low": F.min("at").over(own)})
    if before is None:
        return rows.select("file", F.col("n").cast("long").alias("ordinal"), "text")
    known = rows.join(before.select("file", "lines"), "file", "left")
    return known.select("file", (F.col("n") + F.when(F.col("low") > 0, F.coalesce("lines", F.lit(0))).otherwise(0)).cast("long").alias("ordinal"), "text")


def carried_state(lines: DataFrame, first: dict[str, str], last: dict[str, str]) -> DataFrame:
    """A stream of lines (file, at, text) with what each file has said so far: one value per name, by JSON path.

    first: the first value of the file counts; last: the last one up to the line. The state of a file is these few values.
    """
    names = [*first, *last]
    paths = {**first, **last}
    given = lines.select("file", "at", "text", *(F.nullif(F.get_json_object("text", p), F.lit("")).alias(n) for n, p in paths.items()))
    out = "file string, at long, text string, " + ", ".join(f"{n} string" for n in names)
    state = ", ".join(f"{n} string" for n in names)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, held.get, strict=True)) if held.exists else dict.fromkeys(names)
        rows = pd.concat(list(batches)).sort_values("at")
        found = []
        for r in rows.itertuples():
            for n in names:
                v = getattr(r, n)
                if isinstance(v, str) and (n in last or now[n] is None):
                    now[n] = v
            found.append((r.file, r.at, r.text, *(now[n] for n in names)))
        held.update(tuple(now[n] for n in names))
        yield pd.DataFrame(found, columns=["file", "at", "text", *names])

    return given.groupBy("file").applyInPandasWithState(fold, out, state, "append", GroupStateTimeout.NoTimeout)
