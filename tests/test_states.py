"""Streams with state against the batch form."""

import random

from palimpsest.streaming import states


def test_violations_in_any_order_within_the_watermark(spark, tmp_path):
    r = random.Random(1)
    events = [(s, "d", 1_000_000 + 60 * k, r.random() < 0.5) for s in ("a", "b", "c") for k in range(40)]
    want = []
    for s in ("a", "b", "c"):
        since = None
        for _, _, at, flag in sorted(e for e in events if e[0] == s):
            if flag and since is None:
                since = at
            elif not flag and since is not None:
                want.append((s, "d", since * 1000, at * 1000))
                since = None
    # shuffled among their neighbours: each file is at most ten minutes behind
    events.sort(key=lambda e: (e[2] + r.randint(0, 500), e[0]))
    folder, schema = tmp_path / "in", "src string, dst string, at long, flag boolean"
    for k in range(0, len(events), 30):
        spark.createDataFrame(events[k : k + 30], schema).coalesce(1).selectExpr("src", "dst", "timestamp_seconds(at) AS ts", "flag").write.mode("append").parquet(str(folder))
    spark.createDataFrame([("z", "z", 2_000_000, False)], schema).coalesce(1).selectExpr("src", "dst", "timestamp_seconds(at) AS ts", "flag").write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("src string, dst string, ts timestamp, flag boolean").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = states.violations(stream, "10 minutes").writeStream.outputMode("append").format("memory").queryName("violated").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("violated").collect())) == sorted(want) and want
