"""Evidence documents and retrieval over them; orders are commits, conversations requests, documents issues."""

from pyspark.sql import functions as F

from ..operators import documents as D
from . import context
from .evidence import REDACTED
from .registry import query

def clean(c: str) -> str:
    return "substring(" + REDACTED.format(t=f"regexp_replace(replace(replace(coalesce({c}, ''), chr(0), ''), chr(13) || chr(10), chr(10)), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')") + ", 1, 20000)"


DOCS = "docs AS (SELECT *, sha256(title || chr(10) || content || chr(10) || concat_ws(',', 'commit_id=' || commit_id, 'file=' || file, 'issue=' || issue, 'lineage=' || lineage, 'request=' || request)) AS hash FROM (" + " UNION ALL ".join([
    "SELECT 'commit:' || commit_id AS key, 'commit' AS kind, 'Commit ' || commit_id AS title, " + clean("message") + " AS content, moment, commit_id, CAST(NULL AS BIGINT) AS file, CAST(NULL AS BIGINT) AS lineage, CAST(NULL AS BIGINT) AS request, CAST(NULL AS BIGINT) AS issue FROM commits",
    "SELECT 'symbol_change:' || version_id, 'symbol_change', lineage || ' ' || name, " + clean("props") + ", moment, NULL, NULL, lineage, NULL, NULL FROM versions",
    "SELECT 'pr_comment:' || (conv_id * 1000 + turn), 'pr_comment', role || ' in request ' || conv_id, " + clean("text") + ", NULL, NULL, NULL, NULL, conv_id, NULL FROM conversations",
    "SELECT 'issue:' || doc_id, 'issue', 'Issue ' || doc_id, " + clean("text") + ", NULL, NULL, NULL, NULL, NULL, doc_id FROM documents",
    "SELECT 'file_current:' || s_suppkey, 'file_current', s_name, " + clean("CAST(s_nationkey AS VARCHAR)") + ", NULL, NULL, s_suppkey, NULL, NULL, NULL FROM supplier",
]) + "))"


def parts(h):
    none = F.lit(None)
    commits = D.document(h.commits(), "commit", F.col("commit_id"), F.concat(F.lit("Commit "), F.col("commit_id").cast("string")), F.col("message"), F.col("moment"), commit_id=F.col("commit_id"))
    changes = D.document(h.versions(), "symbol_change", F.col("version_id"), F.concat_ws(" ", F.col("lineage").cast("string"), "name"), F.col("props"), F.col("moment"), lineage=F.col("lineage"))
    said = D.document(h.table("conversations"), "pr_comment", F.col("conv_id") * 1000 + F.col("turn"), F.concat(F.col("role"), F.lit(" in request "), F.col("conv_id").cast("string")), F.col("text"), none, request=F.col("conv_id"))
    issues = D.document(h.table("documents"), "issue", F.col("doc_id"), F.concat(F.lit("Issue "), F.col("doc_id").cast("string")), F.col("text"), none, issue=F.col("doc_id"))
    files = D.document(h.files(), "file_current", F.col("file_id"), F.col("name"), F.col("module_id").cast("string"), none, file=F.col("file_id"))
    return [commits, changes, said, issues, files]


@query("commits versions", "WITH " + DOCS + " SELECT key, kind, title, length(content) AS n_chars, moment, hash FROM docs")
def evidence_documents(h):
    return D.documents(parts(h)).select("key", "kind", "title", F.length("content").cast("long").alias("n_chars"), "moment", "hash")


@query("commits versions", "WITH " + DOCS + ", p AS (SELECT key, kind, CASE kind WHEN 'commit' THEN 1 WHEN 'symbol_change' THEN 2 WHEN 'issue' THEN 4 WHEN 'pr_comment' THEN 5 ELSE 7 END AS place, moment FROM docs) SELECT key, kind FROM p ORDER BY place, moment DESC NULLS LAST, key LIMIT 12000")
def evidence_by_priority(h):
    return D.documents(parts(h), 12_000).select("key", "kind")


@query(sql=r"""WITH t AS (SELECT o_orderkey AS id, 'Why did ' || replace(c_name, '#', '_') || ' change pr #' || o_custkey || ' and Order.' || o_orderstatus || ' for issue ' || o_orderkey || '?' AS q, c_name, o_custkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT id, o_custkey AS request, id AS issue, CAST(nullif(lower(regexp_extract(q, '(?i)\b[0-9a-f]{7,40}\b', 0)), '') AS VARCHAR) AS sha, 'Order.' || o_orderstatus || ',' || replace(c_name, '#', '_') AS names FROM t""")
def question_targets(h):
    o = h.table("orders").join(h.authors(), F.col("o_custkey") == F.col("author_id"))
    text = F.concat(F.lit("Why did "), F.replace("name", F.lit("#"), F.lit("_")), F.lit(" change pr #"), F.col("o_custkey").cast("string"), F.lit(" and Order."), F.col("o_orderstatus"), F.lit(" for issue "), F.col("o_orderkey").cast("string"), F.lit("?"))
    return D.question_targets(o.select(F.col("o_orderkey").alias("id"), text.alias("text")))


@query(sql="""WITH m AS MATERIALIZED (SELECT o_orderkey AS commit_id, md5(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders), u AS (SELECT substr(sha, 1, 8) AS p, min(commit_id) AS commit_id FROM m GROUP BY 1 HAVING count(*) = 1),
 s AS (SELECT lower(replace(c_name, '#', '_')) AS name, min(c_custkey) AS symbol_id FROM customer GROUP BY 1 HAVING count(*) = 1)
 SELECT o_orderkey AS id, u.commit_id, symbol_id, symbol_id % 50 AS lineage, 'c/' || symbol_id AS path FROM orders LEFT JOIN u ON substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) = u.p JOIN customer ON o_custkey = c_custkey LEFT JOIN s ON lower(replace(c_name, '#', '_')) = s.name""")
def question_lookups(h):
    """Questions that name a commit by the beginning of its sha, and a customer as a symbol."""
    sha = lambda: F.md5(F.col("o_orderkey").cast("string"))
    o = h.table("orders").join(h.authors(), F.col("o_custkey") == F.col("author_id"))
    text = F.concat(F.lit("Why did "), F.replace("name", F.lit("#"), F.lit("_")), F.lit(" change in "), F.upper(F.substring(sha(), 1, 8)), F.lit("?"))
    commits = h.table("orders").select(F.col("o_orderkey").alias("commit_id"), sha().alias("sha"))
    c = F.col("author_id")
    symbols = h.authors().select(c.alias("symbol_id"), F.replace("name", F.lit("#"), F.lit("_")).alias("name"), F.concat(F.lit("crm."), "name").alias("qualified"), (c % 50).alias("lineage"), F.concat(F.lit("c/"), c.cast("string")).alias("path"))
    return D.look_up_targets(D.question_targets(o.select(F.col("o_orderkey").alias("id"), text.alias("text"))), commits, symbols)


@query(sql="""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'introduced|first added|who added|when was') THEN 'introduction' WHEN regexp_matches(lower(text), 'impact|depends on|dependent|caller|hotspot') THEN 'impact'
 WHEN regexp_matches(lower(text), 'architecture|role of|module|component') THEN 'architecture' WHEN regexp_matches(lower(text), 'history|changed|rename|moved|evolution') THEN 'history'
 WHEN regexp_matches(lower(text), 'dependency|imports|calls|uses') THEN 'dependency' WHEN regexp_matches(lower(text), 'why|reason|exist') THEN 'why' ELSE 'general' END AS intent FROM conversations""")
def question_intent(h):
    return h.table("conversations").select("conv_id", "turn", D.intent_of(F.col("text")).alias("intent"))


@query("commits versions", "WITH " + DOCS + ", " + context.REQUESTS + """, t AS (SELECT commit_id AS ask, commit_id % 50 AS lineage, request, commit_id AS issue, commit_id, 1 + commit_id % 10 AS file FROM links),
 k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY moment DESC NULLS LAST, key) AS rl, row_number() OVER (PARTITION BY request ORDER BY moment DESC NULLS LAST, key) AS rr, row_number() OVER (PARTITION BY issue ORDER BY moment DESC NULLS LAST, key) AS ri,
  row_number() OVER (PARTITION BY file ORDER BY moment DESC NULLS LAST, key) AS rf FROM docs), c AS (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY moment DESC NULLS LAST, key) AS rc FROM docs WHERE kind IN ('commit', 'commit_diff', 'pull_request', 'review_comment', 'pr_comment', 'issue_comment')),
 p AS (SELECT ask, key FROM t JOIN k ON t.lineage = k.lineage AND rl <= 30 UNION SELECT ask, key FROM t JOIN k ON t.request = k.request AND rr <= 30 UNION SELECT ask, key FROM t JOIN k ON t.issue = k.issue AND ri <= 30 UNION SELECT ask, key FROM t JOIN k ON t.file = k.file AND rf <= 20 UNION SELECT ask, key FROM t JOIN c ON t.commit_id = c.commit_id AND rc <= 30),
 m AS (SELECT p.ask, p.key, kind, title, coalesce(k.lineage = t.lineage, false) AS sl, coalesce(k.request = t.request, false) AS sr, coalesce(k.issue = t.issue, false) AS si, coalesce(k.commit_id = t.commit_id, false) AS sc FROM p JOIN t ON p.ask = t.ask JOIN k ON p.key = k.key),
 s AS (SELECT ask, key, kind, title, CASE WHEN sl THEN 0.99 WHEN sr THEN 0.94 WHEN si THEN 0.93 WHEN sc THEN 0.97 ELSE 0.78 END AS raw, CASE WHEN sl THEN 'direct_symbol_' || kind WHEN sr THEN 'direct_pull_request_link' WHEN si THEN 'direct_issue_reference' WHEN sc THEN 'symbol_introduction+direct_commit' ELSE 'direct_file_' || kind END AS reason FROM m),
 z AS (SELECT *, row_number() OVER (PARTITION BY ask, kind ORDER BY raw DESC, title, key) AS place FROM s) SELECT ask, key, kind, CAST(round(raw - 0.03 * (place - 1), 6) AS DOUBLE) AS score, reason FROM z WHERE place <= 3""")
def direct_evidence(h):
    c = F.col("commit_id")
    targets = context.links(h).select(c.alias("ask"), (c % 50).alias("lineage"), "request", c.alias("issue"), "commit_id", (1 + c % 10).alias("file"), c.alias("introduced"))
    return D.direct_evidence(D.documents(parts(h)), targets)


@query(sql="WITH c AS (SELECT l_orderkey AS claim, min(l_linenumber) AS mention, l_partkey % 1500 AS key FROM lineitem GROUP BY 1, 3) SELECT claim, count(*) AS cited, count(doc_id) AS known, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY mention, key), '') AS kept, count(doc_id) > 0 AS valid FROM c LEFT JOIN documents ON doc_id = key GROUP BY 1")
def claim_validation(h):
    mention = F.struct("change_order", (F.col("part_id") % 1500).alias("key"))
    claims = h.changes().groupBy(F.col("commit_id").alias("claim")).agg(F.transform(F.array_sort(F.collect_list(mention)), lambda x: x["key"]).alias("keys"))
    told = D.cited_claims(claims, h.table("documents").select(F.col("doc_id").alias("key")))
    return told.withColumn("kept", F.array_join(F.transform("kept", lambda x: x.cast("string")), ","))


@query(sql="SELECT vec_id, len(embedding) AS dimension FROM embeddings")
def vector_validation(h):
    return D.check_vectors(h.table("embeddings"), 64).select("vec_id", F.size("embedding").cast("long").alias("dimension"))


@query(sql="SELECT coalesce(d.doc_id, e.vec_id) AS key, CASE WHEN d.doc_id IS NULL THEN 'drop' WHEN e.vec_id IS NOT NULL AND e.label % 2 = 0 AND d.n_chars % 3 = 0 THEN 'keep' ELSE 'embed' END AS action FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id")
def embedding_reuse(h):
    d = h.table("documents").select(F.col("doc_id").alias("key"), F.when(F.col("n_chars") % 3 == 0, "a").otherwise("b").alias("hash"))
    known = h.table("embeddings").select(F.col("vec_id").alias("key"), F.lit("a").alias("hash"), F.when(F.col("label") % 2 == 0, "v2").otherwise("v1").alias("version"), F.size("embedding").alias("dimension"))
    return D.to_embed(d, known, "v2", 64)
