"""Requests, commits, lineages and dossiers in context. Conversations are pull requests: their commits are those of
the customer of the same number, and orders and requests refer to the document of the same number as an issue."""

from pyspark.sql import functions as F

from ..operators import context as X
from ..operators import filters as P
from ..operators import temporal as T
from . import people
from .registry import query

REQUESTS = "links AS (SELECT conv_id AS request, o_orderkey AS commit_id FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN orders ON o_custkey = conv_id)"


def links(h):
    return h.table("conversations").select("conv_id").distinct().join(h.table("orders"), F.col("o_custkey") == F.col("conv_id")).select(F.col("conv_id").alias("request"), F.col("o_orderkey").alias("commit_id"))


def comments(h):
    return h.table("conversations").select(F.col("conv_id").alias("request"), "turn", "role", "text")


def requests(h):
    return comments(h).groupBy("request").agg(F.substring(F.min_by("text", "turn"), 1, 60).alias("title"))


@query(sql="WITH " + REQUESTS + ", t AS (SELECT conv_id AS request, arg_min(substring(text, 1, 60), turn) AS title, count(*) AS comments, count(DISTINCT role) AS people, max(turn) AS last_turn FROM conversations GROUP BY 1), n AS (SELECT request, count(DISTINCT commit_id) AS commits FROM links GROUP BY 1) SELECT t.request, title, comments, people, coalesce(commits, 0) AS commits, last_turn FROM t LEFT JOIN n ON t.request = n.request")
def request_list(h):
    return X.request_list(requests(h), comments(h), links(h))


@query("commits", "WITH " + REQUESTS + ", s AS (SELECT conv_id AS request, string_agg(turn || ':' || role, ',' ORDER BY turn, turn || ':' || role) AS roles FROM conversations GROUP BY 1), d AS (SELECT request, string_agg(CAST(commits.commit_id AS VARCHAR), ',' ORDER BY moment, commits.commit_id) AS commits FROM links JOIN commits ON links.commit_id = commits.commit_id GROUP BY 1) SELECT s.request, roles, coalesce(commits, '') AS commits FROM s LEFT JOIN d ON s.request = d.request")
def request_detail(h):
    return X.request_detail(comments(h), links(h), h.commits())


@query("commits", "WITH " + REQUESTS + """, i AS (SELECT DISTINCT commit_id, issue FROM (SELECT o_orderkey AS commit_id, doc_id AS issue FROM orders JOIN documents ON doc_id = o_orderkey UNION ALL SELECT commit_id, doc_id FROM links JOIN documents ON doc_id = request)),
 a AS (SELECT commit_id, string_agg(CAST(issue AS VARCHAR), ',' ORDER BY issue) AS issues FROM i GROUP BY 1), r AS (SELECT commit_id, string_agg(CAST(request AS VARCHAR), ',' ORDER BY request) AS requests FROM (SELECT DISTINCT commit_id, request FROM links) GROUP BY 1)
 SELECT commits.commit_id, coalesce(requests, '') AS requests, coalesce(issues, '') AS issues FROM commits LEFT JOIN a ON commits.commit_id = a.commit_id LEFT JOIN r ON commits.commit_id = r.commit_id""")
def commit_context(h):
    issue = h.table("documents").select(F.col("doc_id").alias("issue"))
    return X.commit_context(h.commits(), links(h), h.commits().join(issue, F.col("commit_id") == F.col("issue")).select("commit_id", "issue"), links(h).select("request").distinct().join(issue, F.col("request") == F.col("issue")).select("request", "issue"))


@query("commits", "WITH c AS (SELECT commit_id, c_name AS author, moment, message FROM commits JOIN customer ON author_id = c_custkey WHERE message = '1-URGENT') SELECT commit_id, author, moment, message, (SELECT count(*) FROM c) AS total FROM c ORDER BY moment DESC, commit_id LIMIT 25 OFFSET 25")
def commit_list(h):
    from ..operators import merge as M

    rows = M.filtered(h.commits(), message="1-URGENT").join(h.authors(), "author_id").select("commit_id", F.col("name").alias("author"), "moment", "message")
    return M.page(rows, [F.desc("moment"), F.col("commit_id")], 25, 25)


@query(sql="SELECT p_partkey AS symbol, p_name AS name, p_type AS kind, count(l_orderkey) AS imports FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE contains(lower(p_name), 'ring') GROUP BY 1, 2, 3")
def symbol_list(h):
    from ..functions.scalars import literal_like

    symbols = h.table("part").where(literal_like(F.col("p_name"), "ring")).select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    n = h.changes().groupBy(F.col("part_id").alias("symbol")).agg(F.count("*").alias("imports"))
    return symbols.join(n, "symbol", "left").select("symbol", "name", "kind", F.coalesce("imports", F.lit(0)).cast("long").alias("imports"))


@query(sql="WITH r AS (SELECT s_suppkey AS key, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS ix, max(o_orderkey) AS head, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS wanted FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT key, CASE WHEN ix IS NULL THEN 'missing' WHEN done * 4 < wanted THEN 'running' WHEN ix <> head THEN 'stale' ELSE 'ready' END AS status, coalesce(ix <> head, false) AS stale, round(done / CAST(wanted AS DOUBLE), 6) AS share FROM r")
def index_status(h):
    rows = h.changes().join(h.table("orders").select(F.col("o_orderkey").alias("commit_id"), "o_orderstatus"), "commit_id").groupBy(F.col("file_id").alias("key"))
    done = F.col("o_orderstatus") == "F"
    per = rows.agg(F.max(F.when(done, F.col("commit_id"))).alias("indexed_sha"), F.max("commit_id").alias("head_sha"), F.count_if(done).alias("done"), F.count("*").alias("wanted"))
    state = F.when(F.col("indexed_sha").isNull(), F.lit(None)).when(F.col("done") * 4 < F.col("wanted"), "running").otherwise("done")
    return X.index_status(per.withColumn("state", state))


@query("refs changes", "WITH " + REQUESTS + """, i AS (SELECT dst AS node, count(DISTINCT src) AS fan_in FROM refs GROUP BY 1), o AS (SELECT src AS node, count(DISTINCT dst) AS fan_out FROM refs GROUP BY 1), q AS (SELECT file_id AS node, count(DISTINCT request) AS requests FROM changes JOIN links ON changes.commit_id = links.commit_id GROUP BY 1)
 SELECT s_suppkey AS node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(requests, 0) AS requests FROM supplier LEFT JOIN i ON i.node = s_suppkey LEFT JOIN o ON o.node = s_suppkey LEFT JOIN q ON q.node = s_suppkey""")
def node_counts(h):
    asked = h.changes().select("commit_id", "file_id").join(links(h), "commit_id").select(F.col("file_id").alias("node"), "request")
    return X.node_counts(h.files().select(F.col("file_id").alias("node")), h.file_references(), asked)


@query("versions", "SELECT 'lineages' AS name, count(DISTINCT lineage) AS n FROM versions UNION ALL SELECT 'versions', count(*) FROM versions UNION ALL SELECT 'deletions', count(*) FROM versions WHERE kind = 'deleted' UNION ALL SELECT 'requests', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'comments', count(*) FROM conversations UNION ALL SELECT 'issues', count(*) FROM documents")
def state_counters(h):
    v = h.versions()
    return X.state_counters(lineages=v.select("lineage").distinct(), versions=v, deletions=v.where("kind = 'deleted'"), requests=comments(h).select("request").distinct(), comments=comments(h), issues=h.table("documents"))


@query("commits changes", people.KNOW + """, c AS (SELECT file_id, count(*) AS people, max(knowledge) AS top, sum(CASE WHEN knowledge > 0 THEN -knowledge * ln(knowledge) ELSE 0 END) AS h FROM kn GROUP BY 1), e AS (SELECT file_id, CASE WHEN top >= 0.6 OR CASE WHEN people <= 1 THEN 0.0 ELSE h / ln(people) END < 0.45 THEN 'concentrated' ELSE 'distributed' END AS label FROM c)
 SELECT kn.file_id, row_number() OVER (PARTITION BY kn.file_id ORDER BY knowledge DESC, author_id) AS place, author_id, knowledge, label FROM kn JOIN e ON kn.file_id = e.file_id""")
def entity_contributors(h):
    return X.entity_contributors(people.contributor_knowledge(h), "file_id", people.knowledge_concentration(h))


@query("sources versions", """WITH a AS (SELECT o_orderkey AS ask, CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_custkey END AS f, CASE WHEN o_orderkey % 4 = 1 THEN o_custkey END AS s, CASE WHEN o_orderkey % 4 >= 2 AND o_orderkey % 8 <> 6 THEN o_custkey END AS l FROM orders),
 n AS (SELECT *, CAST(f IS NOT NULL AS INTEGER) + CAST(s IS NOT NULL AS INTEGER) + CAST(l IS NOT NULL AS INTEGER) AS n FROM a), e AS (SELECT n.*, CASE WHEN f IN (SELECT s_suppkey FROM supplier) THEN f END AS ef, CASE WHEN s IN (SELECT file_id FROM sources) THEN s END AS es, CASE WHEN l IN (SELECT lineage FROM versions) THEN l END AS el FROM n),
 k AS (SELECT ask, coalesce(ef, es, el) AS ent, CASE WHEN n <> 1 THEN 'error' WHEN coalesce(ef, es, el) IS NULL THEN 'missing' WHEN f IS NOT NULL THEN 'file' WHEN s IS NOT NULL THEN 'symbol' ELSE 'lineage' END AS kind FROM e) SELECT ask, kind, CASE WHEN kind IN ('file', 'symbol', 'lineage') THEN CAST(ent AS VARCHAR) END AS entity FROM k""")
def entity_resolution(h):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = h.table("orders").select(k.alias("ask"), F.when((k % 4).isin(0, 3), c).alias("file"), F.when(k % 4 == 1, c).alias("symbol"), F.when((k % 4 >= 2) & (k % 8 != 6), c).alias("lineage"))
    return X.resolve_entity(asked, h.files().select(F.col("file_id").alias("file")), h.sources().select(F.col("file_id").alias("symbol")), h.versions().select("lineage"))


EVENTS = "ev AS (SELECT lineage, version_id FROM (SELECT *, lag(kind) OVER w AS k0, lag(name) OVER w AS n0, lag(value) OVER w AS v0 FROM versions WINDOW w AS (PARTITION BY lineage ORDER BY moment, version_id)), unnest([k0 IS NULL, k0 = 'deleted' AND kind <> 'deleted', kind = 'deleted' AND k0 IS NOT NULL, name <> n0, value > 2 * v0]) AS t(hit) WHERE hit)"


@query("versions", "WITH " + EVENTS + """, f AS (SELECT lineage, name, min((moment, version_id)) AS k FROM versions GROUP BY 1, 2), n AS (SELECT lineage, string_agg(name, ',' ORDER BY k) AS names FROM f GROUP BY 1), e AS (SELECT lineage, count(*) AS events FROM ev GROUP BY 1),
 p AS (SELECT lineage, count(*) AS versions, arg_max(name, (moment, version_id)) AS label, min(moment) AS introduced, max(moment) AS last_seen, arg_max(kind, (moment, version_id)) = 'deleted' AS deleted FROM versions GROUP BY 1)
 SELECT p.lineage, label, names, versions, coalesce(events, 0) AS events, introduced, last_seen, deleted FROM p JOIN n ON p.lineage = n.lineage LEFT JOIN e ON p.lineage = e.lineage""")
def lineage_read(h):
    return X.lineage_read(h.versions(), T.change_event_types(h.versions()))


@query("commits changes", """WITH r AS (SELECT changes.*, author_id, moment, row_number() OVER (PARTITION BY file_id, author_id ORDER BY moment, changes.commit_id, change_order, additions, deletions, change_type) = 1 AS first FROM changes JOIN commits ON changes.commit_id = commits.commit_id)
 SELECT file_id, row_number() OVER w AS place, commit_id, change_type, additions + deletions AS lines, CAST(sum(CAST(first AS INTEGER)) OVER (PARTITION BY file_id ORDER BY moment, commit_id, change_order, additions, deletions, change_type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS authors_so_far FROM r WINDOW w AS (PARTITION BY file_id ORDER BY moment, commit_id, change_order, additions, deletions, change_type)""")
def file_history(h):
    return X.file_history(h.changes(), h.commits())


TIMELINE = """tl AS (SELECT file_id AS entity, moment, change_type AS kind, c.commit_id AS ref FROM (SELECT DISTINCT file_id, commit_id, change_type FROM changes) c JOIN commits ON c.commit_id = commits.commit_id
 UNION ALL SELECT c.file_id, moment, 'rewritten', c.commit_id FROM (SELECT DISTINCT file_id, commit_id FROM changes WHERE additions > 48 AND deletions > 9) c JOIN commits ON c.commit_id = commits.commit_id)"""


@query("commits changes", "WITH " + TIMELINE + " SELECT *, row_number() OVER (PARTITION BY entity ORDER BY moment, kind, ref) AS place FROM tl")
def provenance_timeline(h):
    at = h.commits().select("commit_id", "moment")
    happened = h.changes().select("file_id", "commit_id", "change_type").distinct().join(at, "commit_id").select(F.col("file_id").alias("entity"), "moment", F.col("change_type").alias("kind"), F.col("commit_id").alias("ref"))
    rewritten = h.changes().where("additions > 48 AND deletions > 9").select("file_id", "commit_id").distinct().join(at, "commit_id").select(F.col("file_id").alias("entity"), "moment", F.lit("rewritten").alias("kind"), F.col("commit_id").alias("ref"))
    return X.provenance(happened, rewritten)


@query("commits changes refs", people.ACT + ", " + REQUESTS + ", " + TIMELINE + """, kn0 AS (SELECT file_id, author_id, moment, k.commit_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, commit_id ORDER BY change_order, additions, deletions) AS k FROM changes) k JOIN commits ON k.commit_id = commits.commit_id WHERE k = 1 AND NOT is_merge),
 kp AS (SELECT file_id, author_id, count(*) AS commits, max(moment) AS last_at, min((moment, commit_id)) AS start FROM kn0 GROUP BY 1, 2), ki AS (SELECT *, CAST(start = min(start) OVER (PARTITION BY file_id) AS INTEGER) AS introduced FROM kp),
 kw AS (SELECT *, 0.65 * commits + 0.25 * exp(-(""" + people.DAYS.format(now="(SELECT now FROM o)", moment="last_at") + """) / 365.0) + 0.10 * introduced AS raw FROM ki), kk AS (SELECT file_id, author_id, round(raw / sum(raw) OVER (PARTITION BY file_id), 6) AS knowledge FROM kw), kr AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY knowledge DESC, author_id) AS place FROM kk), top AS (SELECT file_id, string_agg(CAST(author_id AS VARCHAR), ',' ORDER BY place) AS top_people FROM kr WHERE place <= 3 GROUP BY 1),
 v AS (SELECT *, least(changes_180 / 6.0, 1.0) AS r, least(changes / 12.0, 1.0) AS t, least(people / 5.0, 1.0) AS p, least(rewrites / 3.0, 1.0) AS w FROM act), s AS (SELECT *, round(0.35 * r + 0.30 * t + 0.20 * w + 0.15 * p, 4) AS vol, round(0.50 * idle_days / (idle_days + 180.0) + 0.30 / (1 + changes / 4.0) + 0.20 * (1 - r), 4) AS stab FROM v),
 i AS (SELECT dst AS node, count(DISTINCT src) AS fan_in FROM refs GROUP BY 1), ou AS (SELECT src AS node, count(DISTINCT dst) AS fan_out FROM refs GROUP BY 1), q AS (SELECT file_id AS node, count(DISTINCT request) AS requests FROM changes JOIN links ON changes.commit_id = links.commit_id GROUP BY 1), la AS (SELECT entity, arg_max(kind, (moment, kind, ref)) AS last_kind, count(*) AS happened FROM tl GROUP BY 1)
 SELECT s.file_id, changes, churn, age_days, rewrites, CAST(vol AS DOUBLE) AS volatility, CAST(stab AS DOUBLE) AS stability, CASE WHEN deleted THEN 'deleted' WHEN rewrites > 0 AND changes_180 > 0 THEN 'recently_rewritten' WHEN age_days >= 365 AND changes_180 = 0 AND changes <= 2 THEN 'stable_legacy' WHEN age_days < 90 THEN 'new_code' WHEN vol >= 0.65 THEN 'frequently_changed' WHEN age_days >= 365 AND changes_180 > 0 THEN 'long_lived_active' WHEN changes_180 = 0 THEN 'recently_inactive' ELSE 'active' END AS label,
  coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(requests, 0) AS requests, top_people, last_kind, happened FROM s LEFT JOIN i ON i.node = s.file_id LEFT JOIN ou ON ou.node = s.file_id LEFT JOIN q ON q.node = s.file_id LEFT JOIN top ON top.file_id = s.file_id LEFT JOIN la ON la.entity = s.file_id""")
def dossiers(h):
    return X.dossier(people.entity_activity(h), people.volatility(h), node_counts(h), entity_contributors(h), provenance_timeline(h))


@query("versions sources", """WITH l AS (SELECT lineage, arg_max(name, (moment, version_id)) AS kind, arg_max(kind, (moment, version_id)) = 'deleted' AS deleted FROM versions GROUP BY 1), c AS (SELECT lineage % 40 AS p, kind, count(*) AS n, min(lineage) AS lineage FROM l WHERE NOT deleted GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT s.user_id AS symbol, c.lineage FROM (SELECT DISTINCT user_id, event_type FROM events) s JOIN c ON s.user_id % 40 = c.p AND s.event_type = c.kind""")
def current_symbol_link(h):
    v = h.versions()
    place = (F.col("lineage") % 40).alias("path")
    lineages = v.groupBy("lineage").agg(F.max_by("name", F.struct("moment", "version_id")).alias("kind"), (F.max_by("kind", F.struct("moment", "version_id")) == "deleted").alias("deleted"))
    return X.link_symbols(v.select(F.col("lineage").alias("symbol"), place, F.col("name").alias("kind"), F.lit("").alias("qualified")).distinct(), lineages.select("lineage", place, "kind", F.lit("").alias("qualified"), "deleted"))


@query("versions", "WITH f AS (SELECT lineage, arg_min(version_id, (moment, version_id)) AS version_id, arg_min(kind, (moment, version_id)) AS kind FROM versions GROUP BY 1) SELECT lineage, version_id, 'baseline' AS event FROM f WHERE kind <> 'introduced'")
def baseline_changes(h):
    return X.baseline_changes(h.versions())


@query("commits changes", people.ACT + " SELECT file_id, changes, age_days FROM act ORDER BY age_days DESC, file_id LIMIT 15")
def sorted_by_key(h):
    keys = {"oldest": F.desc("age_days"), "newest": F.asc("age_days"), "changes": F.desc("changes")}
    return P.sorted_by(people.entity_activity(h).select("file_id", "changes", "age_days"), keys, "oldest", "file_id").limit(15)
