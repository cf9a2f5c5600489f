"""Graph construction, filters of paths and inputs."""

from pyspark.sql import functions as F

from ..operators import build as B
from ..operators import code as C
from ..operators import filters as P
from ..operators import traces
from .registry import query


def module_names(h):
    """Modules as source texts name them: packages with dots, scoped ones with slashes and relative ones."""
    rows = h.table("lineitem").select("l_returnflag", "l_linenumber", F.concat(F.lit("pkg"), F.col("l_suppkey").cast("string")).alias("p"))
    k, flag = F.col("l_linenumber") % 3, F.col("l_returnflag")
    return rows.select(F.when(k == 0, F.concat("p", F.lit(".core."), flag)).when(k == 1, F.concat(F.lit("@scope"), flag, F.lit("/"), "p", F.lit("/x.js"))).otherwise(F.concat(F.lit(".."), flag, F.lit("\\"), "p")).alias("target"))


@query("sources", """SELECT 'repository:main' AS key, 'repository' AS kind, 'main' AS name UNION ALL SELECT DISTINCT 'module:' || module, 'module', module FROM sources UNION ALL SELECT 'file:' || file_id, 'file', path FROM sources
 UNION ALL SELECT 'symbol:' || p_partkey, 'symbol', p_name FROM part UNION ALL SELECT DISTINCT 'external:' || x, 'external', x FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'pkg' || l_suppkey WHEN 1 THEN '@scope' || l_returnflag || '/pkg' || l_suppkey ELSE l_returnflag END AS x FROM lineitem)""")
def graph_nodes(h):
    symbols = h.table("part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"))
    return B.graph_nodes("main", h.sources(), symbols, module_names(h))


@query("sources", "SELECT DISTINCT 'repository:main' AS src, 'module:' || module AS dst, 'CONTAINS' AS kind FROM sources UNION ALL SELECT 'module:' || module, 'file:' || file_id, 'CONTAINS' FROM sources UNION ALL SELECT 'file:' || file_id, 'symbol:' || file_id, 'CONTAINS' FROM sources")
def graph_containment(h):
    return B.containment("main", h.sources(), h.sources().select(F.col("file_id").alias("symbol_id"), "file_id"))


@query(sql=r"""WITH m AS (SELECT page_id, html, unnest(regexp_extract_all(html, '\b([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\(', 1)) AS qualified FROM pages), c AS (SELECT page_id, qualified, string_split(qualified, '.')[-1] AS name, count(*) AS calls FROM m GROUP BY 1, 2, 3)
 SELECT page_id, qualified, name, calls FROM c WHERE name NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'new', 'def', 'class', 'function', 'sizeof', 'typeof')""")
def call_sites(h):
    bodies = h.table("pages").select(F.col("page_id").alias("symbol"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("first_line"), F.col("html").alias("body"))
    return B.call_sites(bodies).groupBy(F.col("symbol").alias("page_id"), "qualified", "name").agg(F.count("*").alias("calls"))


@query("sources", "SELECT p_partkey AS symbol, unnest([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]]) AS base, unnest(['INHERITS', 'IMPLEMENTS']) AS kind FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')), 'INHERITS' FROM part WHERE p_size % 2 = 1")
def inheritance(h):
    words = F.split("p_name", " ")
    java = F.concat(F.lit("public class X extends "), words[0], F.lit(" implements "), words[1], F.lit(" {"))
    python = F.concat(F.lit("class X("), F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("[T]"))), ", "), F.lit("):"))
    return B.inheritance(h.table("part").select(F.col("p_partkey").alias("symbol"), F.lit("class").alias("kind"), F.when(F.col("p_size") % 2 == 0, java).otherwise(python).alias("signature")))


@query(sql=r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages), s AS (SELECT *, string_split(path, '/') AS w FROM p)
 SELECT page_id, CASE WHEN len(w) <= 1 THEN 'root' ELSE w[1] END AS component, CASE WHEN regexp_replace(path, '([^/])\.[^./]*$', '\1') = '' THEN 'root' ELSE regexp_replace(path, '([^/])\.[^./]*$', '\1') END AS module FROM s""")
def component_grouping(h):
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    return h.table("pages").select("page_id", B.component_of(path).alias("component"), B.module_of(path).alias("module"))


@query("lines edges", "WITH c AS (SELECT n_nationkey AS node, r_name AS component FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT a.component AS src, b.component AS dst, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM edges JOIN c a ON src = a.node JOIN c b ON dst = b.node WHERE a.component <> b.component GROUP BY 1, 2")
def component_dependencies(h):
    of = h.table("nation").join(h.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("component"))
    return B.component_edges(h.module_edges(), of)


@query("lines edges", """WITH s AS (SELECT n_nationkey AS node FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')), e AS (SELECT src, dst FROM edges WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s)),
 q AS (SELECT src AS seed, dst AS node FROM e UNION SELECT seed, dst FROM q JOIN e ON node = src), m AS (SELECT a.seed, a.node FROM q a JOIN q b ON a.seed = b.node AND a.node = b.seed), c AS (SELECT seed AS node, min(node) AS component FROM m GROUP BY 1)
 SELECT src, dst, a.component FROM e JOIN c a ON src = a.node JOIN c b ON dst = b.node WHERE a.component = b.component""", True)
def forbidden_cycles(h):
    scope = h.table("nation").join(h.table("region").where("r_name IN ('ASIA', 'EUROPE')"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"))
    return B.forbidden_cycles(h.module_edges().select("src", "dst"), scope)


@query("sources", "SELECT file_id, path FROM sources WHERE path = 'Brand#1' OR starts_with(path, 'Brand#1/') OR starts_with(path, 'Brand#1::')")
def prefix_filter(h):
    return h.sources().where(P.under(F.col("path"), "Brand#1")).select("file_id", "path")


@query("commits changes", "WITH p AS (SELECT commit_id, row_number() OVER (ORDER BY moment, commit_id) AS position FROM commits) SELECT p.commit_id, position, count(*) AS changes FROM changes JOIN p ON changes.commit_id = p.commit_id WHERE position BETWEEN 101 AND 400 GROUP BY 1, 2")
def position_range(h):
    return P.between_positions(h.changes(), h.commits(), 101, 400).groupBy("commit_id", "position").agg(F.count("*").alias("changes"))


@query("sources", "WITH n AS (SELECT file_id, CASE lines % 4 WHEN 0 THEN 'a/.env.' || language WHEN 1 THEN language || '.PEM' WHEN 2 THEN path ELSE 'x/id_rsa' END AS p FROM sources) SELECT file_id, regexp_matches(lower(p), '(^|/)(\\.env(\\.[^/]*)?|secrets(\\.[^/]*)?|id_rsa|id_dsa|id_ecdsa|id_ed25519|credentials\\.json|[^/]*\\.(pem|key|p12|pfx|keystore))$') AS sensitive FROM n".replace("\\\\", "\\"))
def sensitive_paths(h):
    k = F.col("lines") % 4
    path = F.when(k == 0, F.concat(F.lit("a/.env."), "language")).when(k == 1, F.concat("language", F.lit(".PEM"))).when(k == 2, F.col("path")).otherwise(F.lit("x/id_rsa"))
    return h.sources().select("file_id", P.sensitive_path(path).alias("sensitive"))


@query(sql=r"""SELECT page_id, regexp_matches(lower(html), 'node_modules|vendor|dist|build|\.min\.js|package-lock\.json') AS excluded FROM pages""")
def excluded_paths(h):
    return h.table("pages").select("page_id", traces.excluded_path(F.col("html")).alias("excluded"))


@query(sql=r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https://[A-Za-z0-9.-]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(\.git)?/?$') THEN regexp_replace(url, '^https://[A-Za-z0-9.-]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(\.git)?/?$', '\1/\2') END AS repository,
 regexp_matches(md5(url), '^[0-9a-f]{7,40}$') AS sha_ok, NOT regexp_matches(url, '//|^-|\\|(^|/)\.{1,2}(/|$)|/$') AS path_ok FROM pages""")
def input_validation(h):
    return h.table("pages").select("page_id", P.repository_name(F.col("url")).alias("repository"), P.valid_sha(F.md5("url")).alias("sha_ok"), P.valid_path(F.col("url")).alias("path_ok"))


@query("commits changes", "WITH a AS (SELECT commit_id, moment FROM commits ORDER BY moment DESC, commit_id LIMIT 500), w AS (SELECT * FROM a WHERE commit_id % 3 = 0) SELECT commit_id, moment, (SELECT count(*) FROM w) AS total FROM w ORDER BY moment DESC, commit_id LIMIT 20 OFFSET 20")
def paged_after_filter(h):
    return P.page_after(h.commits().select("commit_id", "moment"), F.col("commit_id") % 3 == 0, [F.desc("moment"), F.col("commit_id")], 500, 20, 20)


@query("sources", "SELECT file_id, language, 'python' AS kind FROM sources WHERE language = 'SMALL' UNION ALL SELECT file_id, language, 'other' FROM sources WHERE language <> 'SMALL'")
def change_relevance(h):
    """Languages by ending: small files end in .py, others in .bin, which no language has."""
    ending = F.when(F.col("language") == "SMALL", ".py").otherwise(".bin")
    return h.sources().select("file_id", "language", F.coalesce(C.language_of(F.concat("path", ending)), F.lit("other")).alias("kind"))
