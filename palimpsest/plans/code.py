"""Source files, ancestry and relations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import code as C
from ..operators import graphs as G
from ..operators.ancestry import CommitGraph
from .registry import query


@query("sources", "SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'cpp' WHEN 3 THEN 'go' END AS language FROM sources")
def language_detection(h):
    ext = F.element_at(F.array(*map(F.lit, (".py", ".TSX", ".hpp", ".go", ".bin"))), (F.col("file_id") % 5 + 1).cast("int"))
    return h.sources().select("file_id", C.language_of(F.concat("path", ext)).alias("language"))


@query(sql="SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS digest, len(string_split(text, chr(10))) > 4 AS truncated FROM documents")
def file_range(h):
    lines, more = C.line_range(F.col("text"), 2, 4)
    return h.table("documents").select("doc_id", F.sha2(lines, 256).alias("digest"), more.alias("truncated"))


@query("sources", "SELECT file_id, unnest(['pkg.m' || file_id % 7, 'os']) AS module FROM sources WHERE file_id % 2 = 0 UNION ALL SELECT file_id, 'com.x.T' || file_id % 7 FROM sources WHERE file_id % 2 = 1")
def import_extraction(h):
    n = (F.col("file_id") % 7).cast("string")
    text = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("from pkg.m"), n, F.lit(" import z\nimport os\nimport os\nx = 1\n"))).otherwise(F.concat(F.lit("package a;\nimport static com.x.T"), n, F.lit(";\n")))
    return C.imports(h.sources().select("file_id", F.when(F.col("file_id") % 2 == 0, "python").otherwise("java").alias("language"), text.alias("text")))


@query("sources", "SELECT file_id, unnest(['C' || file_id, 'C' || file_id || '.run', 'top']) AS qualified, unnest(['class', 'method', 'function']) AS kind FROM sources")
def source_symbols(h):
    n = F.col("file_id").cast("string")
    text = F.concat(F.lit("class C"), n, F.lit(":\n    def run(self):\n        return 1\n\ndef top():\n    pass\n"))
    return C.symbols(h.sources().select("file_id", text.alias("text"))).select("file_id", "qualified", "kind")


@query(sql="WITH RECURSIVE p AS (SELECT o_orderkey AS child, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 1), r AS (SELECT o_orderkey AS commit_id, parent AS ancestor, 1 AS distance FROM orders JOIN p ON child = o_orderkey UNION SELECT commit_id, parent, distance + 1 FROM r JOIN p ON child = ancestor WHERE distance < 6) SELECT commit_id, ancestor, distance FROM r")
def ancestry(h):
    o = h.table("orders").select(F.col("o_orderkey").alias("commit_id"))
    parents = o.where("commit_id > 1").select(F.col("commit_id").alias("child"), F.floor(F.col("commit_id") / 2).alias("parent"))
    return G.ancestors(parents, o, 6)


@query("lines edges", "WITH m AS (SELECT min(src) AS n FROM edges) SELECT 'out' AS direction, dst AS other, weight FROM edges, m WHERE src = n UNION ALL SELECT 'in', src, weight FROM edges, m WHERE dst = n")
def node_neighbourhood(h):
    e = h.module_edges()
    return G.neighbourhood(e, e.agg(F.min("src")).first()[0] or 0)


@query("lines edges", "WITH t AS (SELECT n_nationkey AS node FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM t) OR dst IN (SELECT node FROM t)")
def dependency_context(h):
    asked = h.table("nation").join(h.table("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return G.touching(h.module_edges(), asked.select(F.col("n_nationkey").alias("node")))


@query("commits changes", "WITH s AS (SELECT commit_id AS id FROM commits WHERE is_merge), a AS (SELECT DISTINCT author_id AS id FROM commits WHERE commit_id IN (SELECT id FROM s)), f AS (SELECT DISTINCT file_id AS id FROM changes WHERE commit_id IN (SELECT id FROM s)) SELECT 'commit' AS kind, id FROM s UNION ALL SELECT 'author', id FROM a UNION ALL SELECT 'file', id FROM f")
def relationship_expansion(h):
    seeds = h.commits().where("is_merge").select(F.lit("commit").alias("kind"), F.col("commit_id").alias("id"))
    by = h.commits().select(F.lit("commit").alias("kind_a"), F.col("commit_id").alias("a"), F.lit("author").alias("kind_b"), F.col("author_id").alias("b"))
    of = h.changes().select(F.lit("commit").alias("kind_a"), F.col("commit_id").alias("a"), F.lit("file").alias("kind_b"), F.col("file_id").alias("b"))
    return G.expand_relations(seeds, [by, of])


PARENTS = "c AS MATERIALIZED (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent, o_custkey AS author, o_orderstatus = 'P' AS merge FROM orders), p AS MATERIALIZED (SELECT child, parent FROM c WHERE parent IS NOT NULL UNION SELECT a.child, b.child FROM c a JOIN c b ON b.child = a.child - 7 WHERE a.merge)"
ASKED = "q AS MATERIALIZED (SELECT author AS id, min(child) AS good, max(child) AS bad FROM c GROUP BY 1)"


def commit_parents(h):
    """The author's commit before, and for merges the one seven orders earlier."""
    o = h.table("orders").select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("author"), "o_orderstatus")
    first = o.select("child", F.lag("child").over(Window.partitionBy("author").orderBy("child")).alias("parent"))
    second = o.where("o_orderstatus = 'P'").select("child", (F.col("child") - 7).alias("parent")).join(o.select(F.col("child").alias("parent")), "parent").select("child", "parent")
    return o, first.unionByName(second)


@query(sql="WITH RECURSIVE " + PARENTS + ", " + ASKED + ", b AS (SELECT id, bad AS commit FROM q UNION SELECT id, parent FROM b JOIN p ON commit = child), g AS (SELECT id, good AS commit FROM q UNION SELECT id, parent FROM g JOIN p ON commit = child) SELECT id, commit FROM b EXCEPT SELECT id, commit FROM g")
def commit_range(h):
    """What each author's last commit has and the first one hasn't."""
    o, parents = commit_parents(h)
    asked = o.groupBy(F.col("author").alias("id")).agg(F.min("child").alias("good"), F.max("child").alias("bad"))
    return CommitGraph(parents).commit_range(asked)


@query(sql="WITH RECURSIVE " + PARENTS + ", " + ASKED + ", b AS (SELECT id, bad AS commit FROM q UNION SELECT id, parent FROM b JOIN p ON commit = child) SELECT q.id, q.good + q.id % 3 AS ancestor, q.bad AS commit, EXISTS (SELECT 1 FROM b WHERE b.id = q.id AND b.commit = q.good + q.id % 3) AS holds FROM q")
def is_ancestor(h):
    """Whether each author's last commit builds on the first one, or one of those that came next."""
    o, parents = commit_parents(h)
    asked = o.groupBy(F.col("author").alias("id")).agg((F.min("child") + F.first("author") % 3).alias("ancestor"), F.max("child").alias("commit"))
    return CommitGraph(parents).is_ancestor(asked)
