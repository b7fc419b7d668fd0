"""Event files as a stream: start position, rate limit, lost files, restart."""

import pytest
from pyspark.sql import functions as F

from finlake.streaming.folder import EventFileReader, LostFiles, read_folder, stream_folder
from tests.test_streaming import _feed, _message


def _sink(stream, out, checkpoint):
    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(str(out))

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(checkpoint)).start()


def _drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_start_limit_and_restart(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    for i in range(5):
        _feed(src, f"{i}.txt", [f"a{i}", f"b{i}"])

    def run():
        _drain(_sink(stream_folder(spark, str(src), starting="earliest", per_trigger=2, position=f"{ckpt}/position"), out, ckpt))

    run()
    rows = spark.read.parquet(str(out))
    assert sorted(r["value"] for r in rows.collect()) == sorted(f"{c}{i}" for i in range(5) for c in "ab")
    per_batch = rows.groupBy("batch").agg(F.countDistinct("file").alias("n")).orderBy("batch")
    assert [r["n"] for r in per_batch.collect()] == [2, 2, 1]
    # After a restart only what is new is read, within the limit, whatever the start position says.
    for i in range(5, 8):
        _feed(src, f"{i}.txt", [f"a{i}"])
    run()
    rows = spark.read.parquet(str(out))
    assert rows.count() == 13 and rows.select("value").distinct().count() == 13
    assert [r["n"] for r in rows.groupBy("batch").agg(F.countDistinct("file").alias("n")).orderBy("batch").collect()] == [2, 2, 1, 2, 1]


def test_latest_skips_what_is_there(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    _feed(src, "0.txt", [_message("old")])
    query = _sink(read_folder(spark, str(src)), out, tmp_path / "ckpt")
    query.processAllAvailable()
    _feed(src, "1.txt", [_message("t1"), "{broken", _message("t2")])
    _drain(query)
    assert sorted(r["transaction_id"] for r in spark.read.parquet(str(out)).collect()) == ["t1", "t2"]


def test_lost_files(tmp_path):
    for i in range(3):
        _feed(tmp_path / "in", f"{i}.txt", [str(i)])
    options = {"path": str(tmp_path / "in"), "startingoffsets": "earliest"}
    strict, lax = EventFileReader(options), EventFileReader({**options, "failondataloss": "false"})
    strict.position = start = strict.initialOffset()
    end = strict.latestOffset()
    assert end == {"last": "2.txt", "files": 3} and strict.latestOffset() == end
    planned = strict.partitions(start, end)
    (tmp_path / "in" / "1.txt").unlink()
    with pytest.raises(LostFiles, match="1 files"):
        strict.partitions(start, end)
    with pytest.raises(LostFiles, match="1.txt"):
        list(strict.read(planned[1]))
    assert [p.name for p in lax.partitions(start, end)] == ["0.txt", "2.txt"]
    assert list(lax.read(planned[1])) == []


def test_lines_across_blocks_and_empty_files(tmp_path, monkeypatch):
    monkeypatch.setattr("finlake.streaming.folder.BLOCK_BYTES", 3)
    folder = tmp_path / "in"
    _feed(folder, "0.txt", ["one", "", "a long line", "\u00e9\u00e9"])
    (folder / "1.txt").write_text("")
    (folder / "_skip").write_text("no")
    reader = EventFileReader({"path": str(folder), "startingoffsets": "earliest"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    got = [[v for b in reader.read(p) for v in b.column(0).to_pylist()] for p in parts]
    assert got == [["one", "", "a long line", "\u00e9\u00e9"], []]


@pytest.mark.parametrize("options", [{}, {"path": "x", "startingoffsets": "middle"}, {"path": "x", "maxfilespertrigger": "-1"},
                                     {"path": "x", "maxfilespertrigger": "2"}])
def test_wrong_options(options):
    with pytest.raises(ValueError):
        EventFileReader(options)


def test_a_missing_folder_is_empty(tmp_path):
    reader = EventFileReader({"path": str(tmp_path / "none")})
    start = reader.initialOffset()
    assert start == {"last": "", "files": 0} and reader.partitions(start, reader.latestOffset()) == []
