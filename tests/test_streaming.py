from tessera.engine import Engine
from tessera.streaming.ingest import append_stream


def test_stream_appends_to_a_table(spark, tmp_path):
    e = Engine(spark)
    e.execute("CREATE TABLE ev (event_id int, event_type text)")
    stream = spark.readStream.schema("event_id bigint, event_type string").parquet("/root/testdata/sf0.001/events*.parquet")
    q = append_stream(e, "ev", stream, str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert e.execute("SELECT COUNT(*) FROM ev").first()[0] == 1000


def test_a_replayed_batch_is_appended_once(spark, tmp_path):
    root = str(tmp_path / "db")
    e = Engine(spark, root)
    e.execute("CREATE TABLE ev (event_id int)")
    batch = spark.range(3).toDF("event_id")
    assert [e.insert_df("ev", batch, batch=("s", n)) for n in (0, 0, 1, 1)] == [3, 0, 3, 0]
    again = Engine(spark, root)  # the commit log remembers the batches, also beyond a checkpoint
    assert again.insert_df("ev", batch, batch=("s", 1)) == 0
    again.checkpoint()
    last = Engine(spark, root)
    assert last.insert_df("ev", batch, batch=("s", 1)) == 0 and last.insert_df("ev", batch, batch=("other", 1)) == 3
    assert last.execute("SELECT COUNT(*) FROM ev").first()[0] == 9
