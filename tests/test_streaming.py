from __future__ import annotations

import json

from tests.conftest import rows
from vouchline import streaming

GOOD = json.dumps({"question": "What?", "answer": "That.", "task_type": "definition", "paragraph_ids": ["p"]})


def test_stream_checks_what_the_batch_does(spark, tmp_path):
    data = [("a", GOOD, "2026-01-01T00:00:00Z"), ("b", "[]", "2026-01-01T01:00:00Z"), ("c", None, "2026-01-02T00:00:00Z"), ("a", GOOD, "2026-01-01T02:00:00Z"), ("d", "{", None)]
    df = spark.createDataFrame(data, "id string, raw string, generation_timestamp string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, mode, name):
        query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    got = run(streaming.checked(stream), "append", "checked")
    assert rows(got.select("id", "schema_reason")) == rows(streaming.checked(df).select("id", "schema_reason"))
    assert run(streaming.first_deliveries(stream), "append", "firsts").filter("id = 'a'").count() == 1
    counts = run(streaming.rejections(stream), "complete", "rejections")
    assert rows(counts.selectExpr("reason", "candidates"))[:2] == [("candidate_not_object", 1), ("candidate_not_object", 1)] and counts.filter("reason = 'sound'").first()["candidates"] == 2
