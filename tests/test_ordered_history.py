import random

from pyspark.sql import functions as F

from quillstream.operators import session
from quillstream.streaming.history import ordered_history

SCHEMA = "session_id string, turn_no long, question string, answer string"


def test_history_of_shuffled_turns_equals_the_window(spark, tmp_path):
    rows = [(f"s{s}", t, f"q{s}.{t}", f"a{t}") for s in range(4) for t in range(3 + 4 * s)]
    random.Random(1).shuffle(rows)
    folder = f"file://{tmp_path}/turns"
    for at in range(0, len(rows), 9):  # a file and a batch each
        spark.createDataFrame(rows[at : at + 9], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = ordered_history(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))
        batches = []

        def keep(batch, number):
            batches.extend((number, *r) for r in batch.collect())

        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    last = {}
    for number, s, t, q, h in sorted(batches, key=lambda b: b[0]):
        last[s, t] = (q, [(x["question"], x["answer"]) for x in h])
    want = session.history(spark.createDataFrame(rows, SCHEMA)).select("session_id", "turn_no", "question", "history").collect()
    assert len({b[0] for b in batches}) > 1
    assert last == {(r[0], r[1]): (r[2], [tuple(x) for x in r[3]]) for r in want}
