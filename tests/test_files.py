"""Files as a data source: batches, a stream, and writes that leave whole files or none."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from strandloom.sources.files import Folder, dealt, listed


def _frame(spark, n, text="line"):
    return spark.range(n).select(F.format_string("s%d.pdb", "id").alias("name"), F.encode(F.format_string(f"{text} %d", "id"), "utf-8").alias("body"))


def _read(spark, path, **options):
    spark.dataSource.register(Folder)
    return spark.read.format("folder").options(**options).load(str(path))


def test_files_come_back_as_written(spark, tmp_path):
    spark.dataSource.register(Folder)
    _frame(spark, 9).repartition(4).write.format("folder").mode("append").save(str(tmp_path / "a"))
    assert sorted((r.name, bytes(r.body).decode()) for r in _read(spark, tmp_path / "a").collect()) == [(f"s{n}.pdb", f"line {n}") for n in range(9)]
    assert not any(files for _, _, files in os.walk(tmp_path / "a" / "_staged"))
    _frame(spark, 2, "new").write.format("folder").mode("append").save(str(tmp_path / "a"))
    assert sum(bytes(r.body).startswith(b"new") for r in _read(spark, tmp_path / "a").collect()) == 2
    _frame(spark, 3).unionByName(spark.createDataFrame([("deep/er/x.cif", None)], "name string, body binary")).write.format("folder").mode("overwrite").save(str(tmp_path / "a"))
    assert sorted(r.name for r in _read(spark, tmp_path / "a").collect()) == ["deep/er/x.cif", "s0.pdb", "s1.pdb", "s2.pdb"]
    assert [r.name for r in _read(spark, tmp_path / "a", suffix=".cif").collect()] == ["deep/er/x.cif"]
    assert _read(spark, tmp_path / "none").count() == 0


@pytest.mark.parametrize("bad", ["", "/x", "a//b", "../x", "_staged/x", ".x"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    spark.dataSource.register(Folder)
    rows = _frame(spark, 20).unionByName(spark.createDataFrame([(bad, bytearray(b"x"))], "name string, body binary")).repartition(5)
    with pytest.raises(Exception, match="not a name of a file"):
        rows.write.format("folder").mode("append").save(str(tmp_path / "a"))
    # a try that is still being killed may write on below _staged, which nothing reads
    assert listed(str(tmp_path / "a")) == [] and _read(spark, tmp_path / "a").count() == 0
    assert not any(files for at, _, files in os.walk(tmp_path / "a") if "_staged" not in at)


def test_files_are_dealt_by_bytes():
    files = [(0, "a", 6), (0, "b", 4), (0, "c", 1), (0, "d", 50), (0, "e", 1)]
    assert [t.names for t in dealt(files, 10)] == [["a", "b"], ["c"], ["d"], ["e"]]
    assert dealt([], 10) == []


def test_a_stream_of_files_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(Folder)
    seen = []

    def run():
        stream = spark.readStream.format("folder").load(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r.name for r in df.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    _frame(spark, 3).write.format("folder").mode("append").save(str(tmp_path / "in"))
    run()
    assert sorted(seen) == ["s0.pdb", "s1.pdb", "s2.pdb"]
    _frame(spark, 5).filter("name > 's2.pdb'").write.format("folder").mode("append").save(str(tmp_path / "in"))
    run()
    assert sorted(seen) == [f"s{n}.pdb" for n in range(5)]
