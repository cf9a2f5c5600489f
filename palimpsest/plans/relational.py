"""The relational surface: filters, joins, sets, pages, merges and windows of time."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import merge as M
from .registry import query


@query(sql="SELECT user_id AS lineage, event_id AS version_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 69")
def json_prop_filter(h):
    k = F.get_json_object("props", "$.k").cast("long")
    return h.versions().where(k == 69).select("lineage", "version_id", k.alias("k"))


@query("commits", "SELECT commit_id, author_id, moment FROM commits WHERE is_merge AND message = '1-URGENT' AND moment BETWEEN 820454400 AND 915148800")
def optional_filters(h):
    return M.filtered(h.commits(), is_merge=True, message="1-URGENT", author_id=None).where(F.col("moment").between(820454400, 915148800)).select("commit_id", "author_id", "moment")


@query("commits changes", "SELECT commit_id, author_id FROM commits WHERE commit_id IN (SELECT commit_id FROM changes WHERE additions > 48)")
def semi_join_changes(h):
    return h.commits().select("commit_id", "author_id").join(h.changes().where("additions > 48"), "commit_id", "left_semi")


@query("commits changes", "SELECT commit_id, author_id FROM commits WHERE commit_id NOT IN (SELECT commit_id FROM changes WHERE commit_id IS NOT NULL)")
def anti_join_changes(h):
    return h.commits().select("commit_id", "author_id").join(h.changes(), "commit_id", "left_anti")


@query("changes", "SELECT DISTINCT file_id AS path FROM changes WHERE change_type = 'added' UNION SELECT file_id FROM changes WHERE change_type = 'renamed'")
def union_distinct(h):
    c = h.changes()
    return c.where("change_type = 'added'").select(F.col("file_id").alias("path")).union(c.where("change_type = 'renamed'").select("file_id")).distinct()


@query("commits", "SELECT commit_id, moment, count(*) OVER () AS total FROM commits WHERE is_merge ORDER BY moment DESC, commit_id LIMIT 25 OFFSET 50")
def paged_with_total(h):
    return M.page(h.commits().where("is_merge").select("commit_id", "moment"), [F.desc("moment"), F.asc("commit_id")], 50, 25)


@query("changes", "SELECT commit_id, string_agg(DISTINCT CAST(file_id AS VARCHAR), ',' ORDER BY CAST(file_id AS VARCHAR)) AS files FROM changes GROUP BY 1")
def changed_files(h):
    return h.changes().groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("file_id").cast("string"))), ",").alias("files"))


@query("changes files", "SELECT files.file_id, files.name, count(commit_id) AS n FROM files LEFT JOIN changes ON files.file_id = changes.file_id AND deletions > 9 GROUP BY 1, 2")
def left_join_files(h):
    return h.files().join(h.changes().where("deletions > 9"), "file_id", "left").groupBy("file_id", "name").agg(F.count("commit_id").alias("n"))


@query("commits changes", "SELECT a.file_id, b.author_id, count(DISTINCT a.commit_id) AS n FROM changes a JOIN commits b ON a.commit_id = b.commit_id GROUP BY 1, 2 HAVING count(DISTINCT a.commit_id) > 1")
def bridge_join(h):
    return h.changes().select("file_id", "commit_id").distinct().join(h.commits(), "commit_id").groupBy("file_id", "author_id").agg(F.count("*").alias("n")).where("n > 1")


@query(sql="WITH o AS (SELECT o_orderkey AS key, o_orderpriority AS body FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS body FROM orders WHERE o_orderkey % 4 <> 0) SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'insert' WHEN n.key IS NULL THEN 'delete' WHEN o.body IS DISTINCT FROM n.body THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.key = n.key")
def upsert_classify(h):
    o = h.table("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("body"))
    new = o.where("key % 4 <> 0").withColumn("body", F.when(F.col("key") % 5 == 0, "x").otherwise(F.col("body")))
    return M.classify(o.where("key % 3 <> 0"), new, "key")


@query("sources", """WITH a AS (SELECT file_id, path, lines AS blob FROM sources WHERE file_id % 3 <> 0), b AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN path ELSE 'moved/' || path END AS path, lines AS blob FROM sources WHERE file_id % 5 <> 0),
 k AS (SELECT b.path, a.file_id AS old FROM a JOIN b ON a.path = b.path), x AS (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY path) AS r FROM a WHERE path NOT IN (SELECT path FROM b)), y AS (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY path) AS r FROM b WHERE path NOT IN (SELECT path FROM a))
 SELECT path, old AS file_id, 'kept' AS how FROM k UNION ALL SELECT y.path, x.file_id, CASE WHEN x.file_id IS NULL THEN 'new' ELSE 'adopted' END FROM y LEFT JOIN x ON x.blob = y.blob AND x.r = y.r""")
def blob_reuse(h):
    s = h.sources().select("file_id", "path", F.col("lines").alias("blob"))
    moved = F.when(F.col("file_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("moved/"), F.col("path")))
    return M.reuse_by_blob(s.where("file_id % 3 <> 0"), s.where("file_id % 5 <> 0").withColumn("path", moved))


@query(sql="WITH e AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS hour FROM events) SELECT hour, event_type, count(*) AS n FROM e GROUP BY 1, 2")
def hourly_events(h):
    from ..functions.scalars import epoch

    hour = (F.floor(epoch("ts") / 3600) * 3600).cast("long")
    return h.table("events").groupBy(hour.alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("commits", "SELECT author_id, is_merge, count(*) AS n FROM commits GROUP BY ROLLUP (author_id, is_merge)")
def rollup_commits(h):
    return h.commits().rollup("author_id", "is_merge").agg(F.count("*").alias("n"))


@query(sql="SELECT doc_id, CASE WHEN toxic IS NULL THEN 'open' WHEN toxic = 1 THEN 'rejected' ELSE 'accepted' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def candidate_feedback(h):
    labels = h.table("labels").select("doc_id", "toxic")
    return h.table("documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.when(F.col("toxic").isNull(), "open").when(F.col("toxic") == 1, "rejected").otherwise("accepted").alias("verdict"))


@query("commits", "SELECT commit_id, kind, max(confidence) AS confidence FROM (SELECT commit_id, 'member' AS kind, 0.99 AS confidence FROM commits WHERE commit_id % 2 = 0 UNION ALL SELECT commit_id, 'merge', 0.98 FROM commits WHERE is_merge UNION ALL SELECT commit_id, 'text', CASE WHEN message = '1-URGENT' THEN 0.98 ELSE 0.55 END FROM commits WHERE commit_id % 3 = 0) GROUP BY 1, 2")
def link_materialisation(h):
    c = h.commits()
    parts = [c.where("commit_id % 2 = 0").select("commit_id", F.lit("member").alias("kind"), F.lit(0.99).alias("confidence")), c.where("is_merge").select("commit_id", F.lit("merge").alias("kind"), F.lit(0.98).alias("confidence")), c.where("commit_id % 3 = 0").select("commit_id", F.lit("text").alias("kind"), F.when(F.col("message") == "1-URGENT", 0.98).otherwise(0.55).alias("confidence"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("commit_id", "kind").agg(F.max("confidence").alias("confidence"))


@query("commits", "SELECT commit_id, author_id, round(1.0 / count(*) OVER (PARTITION BY author_id), 6) AS share, CAST(row_number() OVER (PARTITION BY author_id ORDER BY moment, commit_id) AS INTEGER) AS place FROM commits")
def share_and_rank(h):
    w = Window.partitionBy("author_id")
    return h.commits().select("commit_id", "author_id", F.round(1 / F.count("*").over(w), 6).alias("share"), F.row_number().over(w.orderBy("moment", "commit_id")).alias("place"))


@query("commits changes", "SELECT commit_id, author_id FROM commits WHERE commit_id IN (SELECT commit_id FROM changes WHERE additions > 25)")
def reconcile_deletes(h):
    return M.without_gone(h.commits().select("commit_id", "author_id"), h.changes().where("additions > 25"), "commit_id")


@query("commits", "WITH o AS (SELECT author_id, commit_id FROM commits WHERE is_merge), f AS (SELECT author_id, min(commit_id) AS commit_id FROM commits WHERE NOT is_merge GROUP BY 1) SELECT * FROM o UNION ALL SELECT * FROM f WHERE author_id NOT IN (SELECT author_id FROM o)")
def insert_absent(h):
    c = h.commits()
    return M.insert_absent(c.where("is_merge").select("author_id", "commit_id"), c.where("NOT is_merge").select("author_id", "commit_id"), "author_id", "commit_id")


@query(sql="SELECT event_id AS record, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, substring(event_type, 1, 5) AS body, length(event_type) > 5 AS truncated, CASE WHEN event_type = 'view' THEN 'pull_request' ELSE 'issue' END AS kind FROM events WHERE user_id % 2 = 0 AND event_id = (SELECT max(e.event_id) FROM events e WHERE e.user_id = events.user_id AND e.event_type = events.event_type)")
def record_normalisation(h):
    """Raw records by their natural key, the last one of each; a record with a pull request's mark is no issue."""
    raw = h.table("events").where("user_id % 2 = 0").select(F.struct(F.col("user_id"), F.col("event_type")).alias("natural"), "event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("body"), (F.col("event_type") == "view").alias("pull_request"))).alias("record"))
    return M.normalised_records(raw, "natural", "event_id", most=5)
