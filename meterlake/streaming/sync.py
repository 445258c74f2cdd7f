"""One run that brings a store up to date with the logs of its sources.

The catalogue (table files) holds for every file its signature, how far it was read, how many lines that were, and the
version of the reader. A run lists the files, joins them with the catalogue, and reads only what it does not have: the new
bytes of files whose signature changed, in ranges that are tasks. Lines are parsed where they are read, so no content of
a conversation is written anywhere. Before the new parsed lines of a file stand the few earlier ones that they depend on
(table context), so that records come out as from one read of the whole file.

Everything that a source's run changes is switched by one commit: bronze (raw records, appended), facts (the parts of the
touched sessions, computed again from bronze in commit order, and the rollup over those parts), context, catalogue. A file of which any range could not be read
keeps its cursor and gives no line in this run; the next run reads it again from there. A source that fails as a whole
leaves the others alone. Both are told in the run log. Since cursors are switched together with what was read, no line is
lost or stored twice; restarts of rewritten files, and files that moved, meet the records that bronze has.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from meterlake.functions.config import Config
from meterlake.functions.repository import with_roots
from meterlake.operators import normalize, rollup, store
from meterlake.session import discard, written
from meterlake.sources import STEPS
from meterlake.sources.lines import GLOBS
from meterlake.streaming.commits import Change, Store, part_of

#: Bytes that one task reads of a file.
RANGE_BYTES = 32 << 20
#: What opening a file weighs beside its bytes, where small ranges share a task.
OPEN_BYTES = 64 << 10
MOST_TASKS = 10_000
#: Tasks that write a listing.
LISTING_TASKS = 256
FILES = "source_id string, harness string, path string, size long, modified_ms long, cursor long, lines long, version string, present boolean"
#: What facts and all that is above them is parted by.
SESSION = "logical_session_id"
_LINE = "file string, first long, ordinal long, text string, end long, error string, modified_at timestamp"


@dataclass(frozen=True)
class Source:
    """A folder of logs of one harness; glob: which of its files are logs."""

    id: str
    harness: str
    root: str
    glob: str | None = None


def _nothing(spark: SparkSession, ddl: str) -> DataFrame:
    """A table without rows, for which no task runs."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)))


def listed(spark: SparkSession, source: Source) -> DataFrame:
    """path, size and time of change of each log below the source's folder; none if the folder is not there."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", source.glob or GLOBS[source.harness])
    try:
        files = read.load(source.root)
    except AnalysisException:
        return _nothing(spark, "path string, size long, modified_ms long")
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms")).coalesce(LISTING_TASKS)


def planned(files: DataFrame, known: DataFrame, version: str) -> DataFrame:
    """The files of which something is to be read: path, size, modified_ms, and from which byte and after how many lines.

    A file that was read to its end and has another signature was rewritten, as was one that is shorter than what was read;
    both begin again, as do all files after a change of the reader. known: FILES of the source.
    """
    old = known.select("path", F.col("size").alias("old_size"), F.col("modified_ms").alias("old_ms"), "cursor", "lines", "version")
    rows = files.join(old, "path", "left")
    same = (F.col("size") == F.col("old_size")) & (F.col("modified_ms") == F.col("old_ms")) & (F.col("cursor") >= F.col("size")) & (F.col("version") == version)
    on = F.coalesce((F.col("version") == version) & (F.col("cursor") < F.col("size")) & (F.col("size") >= F.col("old_size")), F.lit(False))
    start = lambda c: F.when(on, F.col(c)).otherwise(0).cast("long").alias(c)
    return rows.where((F.col("size") > 0) & ~F.coalesce(same, F.lit(False))).select("path", "size", "modified_ms", start("cursor"), start("lines"))


def opened(path: str):
    """A file by its path or URI, to be read from any place."""
    if path.startswith(("file:", "/")):
        return open(re.sub(r"^file:/+", "/", path), "rb")
    files, at = pyarrow.fs.FileSystem.from_uri(path)
    return io.BufferedReader(files.open_input_file(at), 1 << 20)


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int = 2000, chunk: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The finished lines that begin in each range, numbered from 1 (in the first range of a file, on from the lines before), and
    one row without text for the range: its lines, and where the last one ends."""
    # Rows of small ranges leave together.
    out: dict[str, list] = {name: [] for name in schema.names}

    def add(r: dict, ordinals: range, text: list, end: int | None = None, error: str | None = None) -> None:
        values = {"ordinal": ordinals, "text": text}
        for name, one in (("file", r["path"]), ("first", r["first"]), ("end", end), ("error", error), ("modified_at", r["modified_at"])):
            values[name] = [one] * len(text)
        for name, column in out.items():
            column.extend(values[name])

    def taken() -> pa.RecordBatch:
        full = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        for column in out.values():
            column.clear()
        return full

    for batch in batches:
        # Times as numbers: one for each line is made into a column.
        times = batch["modified_at"].cast(pa.int64())
        for r in batch.set_column(batch.schema.get_field_index("modified_at"), "modified_at", times).to_pylist():
            n, end, error = 0, r["first"], None
            before = r["lines"] if r["first"] == r["cursor"] else 0
            try:
                with opened(r["path"]) as f:
                    f.seek(r["first"])
                    if r["first"] > r["cursor"]:
                        # A line that begins before the range belongs to the one before.
                        f.seek(r["first"] - 1)
                        line = f.readline()
                        end += len(line) - 1
                        if not line.endswith(b"\n") or end > r["size"]:
                            end = r["cursor"]
                    while r["first"] <= end < r["last"]:
                        lines = f.readlines(min(chunk, r["last"] - end))
                        ends = list(accumulate(map(len, lines), initial=end))
                        # What was written after the listing is left to the next run, as is what begins after the range to the one after.
                        good = 0
                        while good < len(lines) and ends[good] < r["last"] and ends[good + 1] <= r["size"] and lines[good].endswith(b"\n"):
                            good += 1
                        add(r, range(before + n + 1, before + n + good + 1), [x[:-1].removesuffix(b"\r").decode("utf-8", "replace") for x in lines[:good]])
                        n, end = n + good, ends[good]
                        if len(out["text"]) >= most:
                            yield taken()
                        if good < len(lines) or not lines:
                            break
            except OSError as e:
                error = str(e)
            add(r, range(n, n + 1), [None], end, error)
            if len(out["text"]) >= most:
                yield taken()
    if out["text"]:
        yield taken()


def new_lines(plan: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines (_LINE) of planned files; ordinal counts within a range, which begins at first, and in the first one of a file from its start."""
    schema = to_arrow_schema(StructType.fromDDL(_LINE))
    begin = F.sequence(F.col("cursor"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    ranges = plan.select("path", "cursor", "size", "lines", F.timestamp_millis("modified_ms").alias("modified_at"), F.explode(begin).alias("first"))
    size = F.col("size") - F.col("cursor")
    n, weight = plan.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.ceil(size / F.lit(range_bytes)), size + F.lit(OPEN_BYTES)))).first()
    # A task for each range; small ones share tasks that weigh as much as one, as long as every core has some.
    tasks = max(-(-int(weight) // range_bytes), min(int(n), plan.sparkSession.sparkContext.defaultParallelism))
    ranges = ranges.withColumn("last", F.least(F.col("first") + range_bytes, F.col("size"))).repartition(max(1, min(tasks, int(n), MOST_TASKS)))
    return ranges.mapInArrow(lambda it: _read(it, schema), _LINE)


def _taken(parsed: DataFrame, ranges: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Parsed lines numbered from the start of their file; path, cursor, lines and error of each planned file, written; whether
    that took joins, which files of one range that was read do not need."""
    at = ranges.join(plan.select(F.col("path").alias("file"), "lines"), "file")
    done = at.groupBy(F.col("file").alias("path")).agg(F.max("end").alias("cursor"), (F.max("lines") + F.sum("ordinal")).alias("lines"), F.max("error").alias("error"), F.count("*").alias("ranges"))
    done = written(done, "done")
    most, failed = done.agg(F.max("ranges"), F.count("error")).first()
    if (most or 0) > 1:
        earlier = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
        # The first range of a file is numbered already; nothing is before it.
        offsets = at.select("file", "first", (F.sum("ordinal").over(earlier) + F.col("lines")).alias("offset")).where(F.col("offset").isNotNull())
        parsed = parsed.join(offsets, ["file", "first"], "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("offset", F.lit(0))).drop("offset")
    if failed:
        parsed = parsed.join(done.where("error IS NOT NULL").select(F.col("path").alias("file")), "file", "left_anti")
    return parsed.drop("first"), done, bool((most or 0) > 1 or failed)


def _touched(rows: DataFrame, key: str, parts: int) -> list[int]:
    """Parts in which rows lie: at most so many numbers."""
    return sorted(r[0] for r in rows.select(part_of(key, parts).alias("p")).distinct().collect())


def _merged(change: Change, name: str, rows: DataFrame, key: str, keys: DataFrame, parts: int) -> None:
    """Puts rows in the place of those whose key is among keys, part by part."""
    touched = _touched(keys, key, parts)
    held = change.read(name, touched)
    rest = None if held is None else held.join(keys, key, "left_anti")
    change.replace(name, rows if rest is None else rest.unionByName(rows), touched, key)


def _facts(change: Change, config: Config, parts: list[int] | None = None) -> None:
    """Puts the facts of some parts of bronze, or of all, and the rollup over them in the place of what was there.

    A session lies in one part, so sums and distinct sessions of parts add up. A store that has no rollup yet gets all of it.
    """
    change.replace("facts", normalize.facts(change.read("bronze", parts), config), parts, SESSION)
    parts = parts if "cells" in change.tables else None
    own = change.read("facts", parts).withColumn("part", part_of(SESSION, change.store.parts))
    change.replace("cells", rollup.cells(own, "part"), parts)
    change.replace("visits", rollup.visits(own, "part"), parts)


def rolled(st: Store, number: int | None = None) -> rollup.Rollup | None:
    """The rollup as of one commit, the newest if none is named; None before the first."""
    tables = st.tables(number)
    if "cells" not in tables:
        return None
    return rollup.Rollup(*(st.load(name, tables[name]) for name in ("cells", "visits", "facts")))


def sync_source(st: Store, source: Source, config: Config, range_bytes: int = RANGE_BYTES) -> dict:
    """Brings one source up to date by one commit; counts of what was done."""
    spark, steps = st.spark, STEPS[source.harness]
    change = st.begin()
    catalogue = change.read("files")
    known = (_nothing(spark, FILES) if catalogue is None else catalogue).where(F.col("source_id") == source.id)
    files = written(listed(spark, source), "files")
    plan = written(planned(files, known, steps.version), "plan")
    gone = known.where("present").join(files, "path", "left_anti").select("path")
    back = known.where("NOT present").join(files, "path", "left_semi").select("path")
    moved = written(gone.withColumn("present", F.lit(False)).union(back.withColumn("present", F.lit(True))), "moved")
    counts = {"files": plan.count(), "imported": 0, "duplicates": 0, "quarantined": 0, "errors": []}
    if not counts["files"] and moved.isEmpty():
        return counts
    # Parsed where they are read; the row of a range, which has no text, passes with its end and error alone.
    both = written(steps.parsed(new_lines(plan, range_bytes)), "parsed")
    summary = F.col("end").isNotNull()
    rows, done, joined = _taken(both.where(~summary).drop("end", "error"), both.where(summary).select("file", "first", "ordinal", "end", "error"), plan)
    on = plan.where("cursor > 0").join(done.where("error IS NULL"), "path", "left_semi").select(F.col("path").alias("file"))
    held = change.read(f"context_{source.harness}", _touched(on, "file", st.parts))
    rows = rows if held is None else held.join(on, "file", "left_semi").select(*rows.columns).unionByName(rows)
    more = []
    if joined or held is not None:
        rows = written(rows, "rows")
        more.append(rows)
    records = steps.records(rows)
    if held is not None:
        start = plan.select(F.col("path").alias("file"), "lines")
        records = records.join(start, "file").where(F.col("ordinal") > F.col("lines")).drop("lines")
    incoming = with_roots(normalize.raw(records, source.harness, source.id, change.number))
    if change.read("bronze") is None:
        # What nothing is compared with is dealt once, by its part and a share of its keys, and written as it lies then.
        shares = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // st.parts)
        dealt = {"part": part_of(SESSION, st.parts), "__share": F.pmod(F.xxhash64(F.lit("share"), *store.RAW_KEY), F.lit(shares))}
        new = store.new_records(incoming.withColumns(dealt).repartition(*dealt), None, *dealt).drop("__share")
        sessions = change.append("bronze", new, None)
    else:
        incoming = written(incoming, "incoming")
        more.append(incoming)
        bronze = change.read("bronze", _touched(incoming, SESSION, st.parts))
        sessions = change.append("bronze", store.new_records(incoming, bronze), SESSION)
    kinds = {}
    if sessions:
        own = change.read("bronze", sessions).where(F.col("seq")["commit"] == change.number)
        kinds = {r["kind"]: r["count"] for r in own.groupBy("kind").count().collect()}
        _facts(change, config, sessions)
    taken = done.where("error IS NULL").select(F.col("path").alias("file"))
    if not taken.isEmpty():
        _merged(change, f"context_{source.harness}", steps.context(rows), "file", taken, st.parts)
    good = plan.select("path", "size", "modified_ms").join(done.where("error IS NULL"), "path")
    entries = good.select(F.lit(source.id).alias("source_id"), F.lit(source.harness).alias("harness"), "path", "size", "modified_ms", "cursor", "lines", F.lit(steps.version).alias("version"), F.lit(True).alias("present"))
    turned = known.drop("present").join(moved, "path").select(*entries.columns).join(entries, "path", "left_anti")
    entries = written(entries.unionByName(turned), "entries")
    if not entries.isEmpty():
        _merged(change, "files", entries, "path", entries.select("path"), st.parts)
    # One message for each file that failed in this run.
    errors = [f"source {source.id}: file {r['path'].rsplit('/', 1)[-1]}: {r['error']}" for r in done.where("error IS NOT NULL").orderBy("path").limit(100).collect()]
    if change.writes:
        change.commit()
    for df in (files, plan, moved, both, done, entries, *more):
        discard(df)
    return counts | {"imported": kinds.get("usage", 0), "duplicates": kinds.get("duplicate", 0), "quarantined": kinds.get("quarantine", 0), "errors": errors}


def forget(st: Store, source: Source, config: Config) -> None:
    """Takes a source out of bronze, catalogue and context, and its records out of the facts; its logs stay as they are."""
    change = st.begin()
    files = change.read("files")
    if files is None:
        return
    own = written(files.where(F.col("source_id") == source.id).select("path"), "own")
    bronze = change.read("bronze")
    if bronze is not None:
        change.replace("bronze", store.without_source(bronze, source.id), None, "logical_session_id")
        _facts(change, config)
    context = change.read(f"context_{source.harness}")
    if context is not None:
        change.replace(f"context_{source.harness}", context.join(own.withColumnRenamed("path", "file"), "file", "left_anti"), None, "file")
    change.replace("files", files.where(F.col("source_id") != source.id), None, "path")
    change.commit()


def renormalise(st: Store, config: Config) -> None:
    """All facts from bronze, under another config. Readers see the old facts until the commit, then the new ones."""
    change = st.begin()
    if change.read("bronze") is not None:
        _facts(change, config)
        change.commit()


def _log(st: Store, run_id: str, entries: list[tuple]) -> None:
    rows = st.spark.createDataFrame(
        [(run_id, i, at, status, *(c.get(k) for k in ("files", "imported", "duplicates", "quarantined")), error) for i, (at, status, c, error) in enumerate(entries)],
        "run_id string, seq long, at timestamp_ntz, status string, files long, imported long, duplicates long, quarantined long, error string",
    )
    change = st.begin()
    change.append("runs", rows, "run_id")
    change.commit()


def sync(st: Store, sources: list[Source], config: Config = Config(), run_id: str | None = None, range_bytes: int = RANGE_BYTES) -> dict:
    """Brings the store up to date with every source, one after the other, and writes the run log.

    A source whose reader has another version than its files were read with is taken out first and read again.
    """
    now = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
    run_id = run_id or f"run-{now():%Y%m%dT%H%M%S%f}"
    entries: list[tuple] = [(now(), "running", {}, None)]
    total = {"files": 0, "imported": 0, "duplicates": 0, "quarantined": 0}
    for source in sources:
        try:
            files = st.read("files")
            if files is not None and not files.where((F.col("source_id") == source.id) & (F.col("version") != STEPS[source.harness].version)).isEmpty():
                forget(st, source, config)
            counts = sync_source(st, source, config, range_bytes)
            entries.append((now(), "running", counts, "; ".join(counts["errors"]) or None))
            total = {k: total[k] + counts[k] for k in total}
        except Exception as e:  # noqa: BLE001  a source that fails leaves the others alone
            entries.append((now(), "running", {}, f"source {source.id}: {str(e).splitlines()[0]}"))
    entries.append((now(), "completed", {}, None))
    _log(st, run_id, entries)
    st.compact()
    return total | {"run_id": run_id, "errors": [e for _, _, _, e in entries if e]}


def rebuild(st: Store, sources: list[Source], config: Config = Config()) -> dict:
    """Empties the index, but for the run log, and reads every log again."""
    change = st.begin()
    for name in list(change.tables):
        if name != "runs":
            change.drop(name)
    change.commit()
    return sync(st, sources, config)


def counters(st: Store) -> DataFrame | None:
    """store.counters() of the store as it is."""
    bronze, files, facts = st.read("bronze"), st.read("files"), st.read("facts")
    if bronze is None or facts is None or files is None:
        return None
    return store.counters(bronze, files.select("source_id", "path"), facts)


def follow(st: Store, sources: list[Source], config: Config, checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """A streaming query whose batches are syncs: one at each interval, a late one instead of several."""
    ticks = st.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, i: sync(st, sources, config) and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
