"""The repository source and the streams."""

import subprocess

import pytest

from palimpsest.sources.repository import RepositorySource
from palimpsest.streaming import events as E


def git(path, *args):
    subprocess.run(["git", "-C", str(path), "-c", "user.name=a", "-c", "user.email=a@x", *args], check=True, capture_output=True)


def test_repository(spark, tmp_path):
    git(tmp_path, "init", "-q")
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\nfour\n")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "first")
    git(tmp_path, "mv", "a.txt", "b.txt")
    (tmp_path / "b.txt").write_text("one\ntwo\nthree\nfour\nfive\n")
    git(tmp_path, "commit", "-qam", "second")
    git(tmp_path, "tag", "v1")
    spark.dataSource.register(RepositorySource)

    def read(table, **more):
        return spark.read.format("repository").options(path=str(tmp_path), table=table, **more).load()

    assert [r["message"] for r in read("commits").orderBy("position").collect()] == ["first", "second"]
    changes = {(r["change_type"], r["old_path"], r["new_path"], r["additions"]) for r in read("changes").collect()}
    assert changes == {("added", None, "a.txt", 4), ("renamed", "a.txt", "b.txt", 1)}
    assert [r["name"] for r in read("tags").collect()] == ["v1"]
    assert [(r["path"], r["size"]) for r in read("tree").collect()] == [("b.txt", 24)]
    blame = read("blame", file="b.txt").orderBy("line").collect()
    assert len({r["sha"] for r in blame}) == 2 and [(r["source"], r["original_path"]) for r in blame][3:] == [("four", "a.txt"), ("five", "b.txt")]
    assert [(r["line"], r["original_line"]) for r in read("blame", file="b.txt", lines="2,3").collect()] == [(2, 2), (3, 3)]
    blob = read("blob", file="b.txt", mostBytes="7").first()
    assert (bytes(blob["content"]), blob["size"], blob["truncated"]) == (b"one\ntwo", 24, True)
    assert bytes(read("blob", rev=blob["blob"]).first()["content"]).endswith(b"five\n")
    diff = read("diff", context="0").first()
    assert diff["path"] == "b.txt" and "@@ -4,0 +5 @@ four\n+five" in diff["diff"] and not diff["truncated"]
    assert [(r["path"], r["truncated"]) for r in read("diff", rev="HEAD~1..HEAD", mostBytes="10").collect()] == [("b.txt", True)]
    assert [(r["change_type"], r["old_path"]) for r in read("follow", file="b.txt").orderBy("place").collect()] == [("renamed", "a.txt"), ("added", None)]
    assert read("commits", rev="HEAD~1..HEAD").first()["committer_email"] == "a@x"
    with pytest.raises(Exception, match="more than mostCommits"):
        read("commits", mostCommits="1").collect()


def test_windowed_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    df = spark.sql("SELECT id AS event_id, timestamp_seconds(id * 600) AS ts, id % 3 AS user_id, IF(id % 2 = 0, 'a', 'b') AS event_type FROM range(60)")
    df.write.parquet(str(folder))
    stream = E.windowed_counts(E.read_events(spark, str(folder), df.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("counted").collect()}
    assert sum(got.values()) == 60 and len(got) == 20


def test_incremental_sync(spark, tmp_path):
    folder, table = tmp_path / "sync", str(tmp_path / "synced")
    assert E.current(spark, table, "key") is None
    for part in ([(1, 1, "a"), (2, 2, "b")], [(2, 4, "c"), (2, 3, "x"), (3, 5, "d")]):
        spark.createDataFrame(part, "key int, at int, body string").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("key int, at int, body string").parquet(str(folder))
        E.sync_into(stream, table, "key", "at", str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in E.current(spark, table, "key").orderBy("key").collect()] == [(1, 1, "a"), (2, 4, "c"), (3, 5, "d")]
    # a version that a cut-off batch left isn't read
    spark.createDataFrame([(9, 9, "z")], "key int, at int, body string").write.parquet(f"{table}/change/7")
    assert E.current(spark, table, "key").count() == 3


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_sessions_and_repeats_in_streams(spark, tmp_path):
    folder = tmp_path / "in"
    # one event twice, and a last one far ahead that closes the sessions
    df = spark.sql("SELECT id % 19 AS event_id, timestamp_seconds(IF(id >= 10, 96000, 6000) + id * 60) AS ts, 1L AS user_id, 'a' AS event_type FROM range(20) WHERE id < 19 UNION ALL SELECT 5L, timestamp_seconds(6300), 1L, 'a' UNION ALL SELECT 99L, timestamp_seconds(900000), 1L, 'a'")
    df.coalesce(1).write.parquet(str(folder))
    run(E.without_repeats(E.read_events(spark, str(folder), df.schema)), "once", "append")
    assert sorted(r["event_id"] for r in spark.table("once").collect()) == [*range(19), 99]
    run(E.sessions(E.read_events(spark, str(folder), df.schema)), "sessions", "append")
    assert sorted(r["n"] for r in spark.table("sessions").collect()) == [9, 11]
