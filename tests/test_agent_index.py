"""The layout by agent: same rows as a scan of the dated store, few files opened, no aggregate where one write holds a bucket."""

from conftest import frame

from metricloom.operators.store import scan_agent, upsert_frames
from metricloom.sources import agent_index as ai


def opened(spark, df):
    """Files that the scan of a plan opened, as the scan itself counts them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = df._jdf.queryExecution()
        execution.executedPlan().executeCollect()
        leaves = execution.executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def written(frames, agents, key, cpu, days=6):
    return upsert_frames(frames(*[frame(agent=a, when=86400.0 * d + 60 * i, cpu=cpu, key=f"{key}{a}{d}") for i, a in enumerate(agents) for d in range(days)]))


def rows_of(df):
    return [(r.row_key, r.idempotency_key, r.system[0]) for r in df.collect()]


def test_scans_equal_the_store_and_open_one_bucket(spark, frames, tmp_path):
    path, agents = str(tmp_path / "by"), [f"a{i}" for i in range(30)] + ["a1#x", "a1#x#y", ""]
    first = written(frames, agents, "k", 1.0)
    ai.write_by_agent(first, path, 0, buckets=16)
    for agent in ("a1", "a7", "a1#x", "nobody"):
        found = ai.scan_by_agent(spark, path, agent, 9, buckets=16)
        assert rows_of(found) == rows_of(scan_agent(first, agent, 9))
    assert len(rows_of(ai.scan_by_agent(spark, path, "a1", 99, 16))) == 18  # a1, a1#x and a1#x#y
    one = ai.scan_by_agent(spark, path, "a7", 9, 16)
    every = spark.read.parquet(path).filter("agent_id = 'a7'")
    assert opened(spark, one) <= 2 < 10 < opened(spark, every)
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text and "TakeOrderedAndProject" in text  # one generation: read as it is


def test_later_generations_win_and_can_be_written_again(spark, frames, tmp_path):
    path = str(tmp_path / "by")
    first, second = written(frames, ["a", "b"], "k", 1.0), written(frames, ["a"], "n", 2.0, days=2)
    ai.write_by_agent(first, path, 0, buckets=4)
    for _ in range(2):
        ai.write_by_agent(second, path, 1, buckets=4)
    found = rows_of(ai.scan_by_agent(spark, path, "a", 99, 4))
    assert len(found) == 6 and sorted(cpu for _, _, cpu in found) == [1.0] * 4 + [2.0] * 2
    assert {cpu for _, _, cpu in rows_of(ai.scan_by_agent(spark, path, "b", 99, 4))} == {1.0}


def test_an_agent_with_most_rows_is_spread(spark, frames, tmp_path):
    path = str(tmp_path / "by")
    rows = upsert_frames(frames(*[frame(agent="hot" if i % 4 else f"c{i}", when=float(i), cpu=1.0, key=str(i)) for i in range(400)]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ai.write_by_agent(rows, path, 0, buckets=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = {f for f in spark.read.parquet(path).filter("agent_id = 'hot'").selectExpr("input_file_name() AS f").distinct().toPandas()["f"]}
    assert len(files) >= 3
