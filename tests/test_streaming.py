"""The stream of finished lines and the state that is kept for each file."""

import json
import os

from meterlake.streaming import lines


def drained(spark, folder, out, checkpoint, **options):
    q = lines.stream(spark, str(folder), **options).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return sorted((os.path.basename(r["file"]), r["at"], r["text"]) for r in spark.read.parquet(str(out)).collect())


def test_open_lines_wait_and_rewrites_start_again(spark, tmp_path):
    folder, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    (folder / "sub").mkdir(parents=True)
    a, b = folder / "a.jsonl", folder / "sub" / "b.jsonl"
    a.write_bytes(b"one\r\ntwo\nope")
    b.write_bytes(b"")
    (folder / "other.txt").write_bytes(b"no\n")
    run = lambda: drained(spark, folder, out, cp, bytesPerPartition="4")
    want = [("a.jsonl", 0, "one"), ("a.jsonl", 5, "two")]
    assert run() == want
    assert run() == want
    with a.open("ab") as f:
        f.write("n é\n".encode())
    b.write_bytes(b"x\n\ny\n")
    want = sorted([*want, ("a.jsonl", 9, "open é"), ("b.jsonl", 0, "x"), ("b.jsonl", 2, ""), ("b.jsonl", 3, "y")])
    assert run() == want
    # Read to its end, then other bytes of the same size: from the start.
    b.write_bytes(b"X\n\nY\n")
    os.utime(b, ns=(1, 1))
    assert run() == sorted([*want, ("b.jsonl", 0, "X"), ("b.jsonl", 2, ""), ("b.jsonl", 3, "Y")])


def test_what_cannot_be_read_is_a_row_and_the_rest_goes_on(tmp_path):
    reader = lines.LineReader({"path": str(tmp_path)})
    (tmp_path / "good.jsonl").write_bytes(b"1\n2\n")
    end = reader.latestOffset() | {str(tmp_path / "gone.jsonl"): [10, 10, 1]}
    rows = [r for p in reader.partitions({}, end) for r in reader.read(p)]
    assert [(r[1], r[2], r[3] is None) for r in rows] == [(0, None, False), (0, "1", True), (2, "2", True)]


def test_ranges_cover_every_line_once(tmp_path):
    text = [f"line {i} " + "x" * (i * 7 % 90) for i in range(400)]
    path = tmp_path / "big.jsonl"
    path.write_text("\n".join(text) + "\nrest")
    for size in (1, 13, 100, 1 << 20):
        reader = lines.LineReader({"path": str(tmp_path), "bytesPerPartition": str(size)})
        end = reader.latestOffset()
        assert [r[2] for p in reader.partitions({}, end) for r in reader.read(p)] == text
    assert lines.end_of_lines(str(path), path.stat().st_size) == path.stat().st_size - 4


def test_numbers_go_on(spark):
    batch = spark.createDataFrame([("a", 40, "x", None), ("a", 50, "y", None), ("b", 0, "z", None), ("b", 2, "w", None), ("c", 7, None, "broken")], lines.LINE)
    before = spark.createDataFrame([("a", 3), ("b", 9)], "file string, lines long")
    got = {(r["file"], r["ordinal"], r["text"]) for r in lines.numbered(batch, before).collect()}
    assert got == {("a", 4, "x"), ("a", 5, "y"), ("b", 1, "z"), ("b", 2, "w")}


def test_state_of_a_file_outlives_its_batch(spark, tmp_path):
    folder, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    folder.mkdir()
    path = folder / "f.jsonl"

    def run(*records):
        with path.open("a") as f:
            f.writelines(json.dumps(r) + "\n" for r in records)
        rows = lines.carried_state(lines.stream(spark, str(folder)), {"session": "$.id"}, {"model": "$.model"})
        q = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(cp)).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return [(r["session"], r["model"]) for r in spark.read.parquet(str(out)).orderBy("at").collect()]

    assert run({"id": "s", "model": "m1"}, {"id": "t"}) == [("s", "m1"), ("s", "m1")]
    assert run({"n": 1}, {"model": "m2"}, {}) == [("s", "m1"), ("s", "m1"), ("s", "m1"), ("s", "m2"), ("s", "m2")]
