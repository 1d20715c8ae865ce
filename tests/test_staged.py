"""Staging a table as micro-batches: several files each, so that no single task writes or reads one."""

from conftest import at

from metricloom.plans import tables as t


def batches(stream, path):
    """Rows and input partitions of each micro-batch."""
    seen = {}

    def note(batch, number):
        seen[number] = (sorted(r.n for r in batch.select("n").collect()), batch.rdd.getNumPartitions())

    stream.writeStream.foreachBatch(note).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return [seen[n] for n in sorted(seen)]


def test_parts_have_many_files_and_stay_one_batch_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "STAGED_ROWS", 100)
    times = [float(n) for n in range(990)] + [2000.0] * 10  # the third quarter is empty, the last one has ten rows
    rows = spark.createDataFrame([(n, at(when)) for n, when in enumerate(times)], "n bigint, at timestamp").repartition(8)
    later = spark.createDataFrame([(5000, at(3000))], rows.schema)
    with spark_files_apart(spark):
        found = batches(t.staged(rows, str(tmp_path / "in"), "at", then=[later]), str(tmp_path / "checkpoint"))
    assert [len(n) for n, _ in found] == [500, 490, 0, 10, 1]
    assert found[3][0] == list(range(990, 1000)) and found[4][0] == [5000]
    assert found[0][1] >= 2 and found[1][1] >= 2


def test_few_rows_are_one_file_a_part(spark, tmp_path):
    rows = spark.createDataFrame([(n, at(n)) for n in range(8)], "n bigint, at timestamp")
    found = batches(t.staged(rows, str(tmp_path / "in"), "at"), str(tmp_path / "checkpoint"))
    assert [n for n, _ in found] == [[0, 1], [2, 3], [4, 5], [6, 7]]
    assert len([f for f in (tmp_path / "in").iterdir() if f.suffix == ".parquet"]) == 4


class spark_files_apart:
    """Files small as these are a task each."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")

    def __exit__(self, *_):
        self.spark.conf.unset("spark.sql.files.maxPartitionBytes")
