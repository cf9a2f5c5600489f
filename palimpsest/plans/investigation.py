"""Candidates, resolution and states."""

from pyspark.sql import functions as F

from ..operators import investigate as I
from ..operators import traces as R
from .registry import query

INFO = "WITH info AS (SELECT commits.commit_id, moment, is_merge, n AS files_changed FROM commits JOIN (SELECT commit_id, count(DISTINCT file_id) AS n FROM changes GROUP BY 1) c ON commits.commit_id = c.commit_id)"


def info(h):
    n = h.changes().groupBy("commit_id").agg(F.countDistinct("file_id").alias("files_changed"))
    return h.commits().select("commit_id", "moment", "is_merge").join(n, "commit_id")


@query("commits changes", INFO + """, s AS (SELECT commit_id, max(CASE WHEN change_type = 'renamed' THEN 0.45 ELSE 0.0 END) + max(CASE WHEN additions > 45 THEN 0.25 ELSE 0.0 END) + max(CASE WHEN file_id % 5 = 0 THEN 0.15 ELSE 0.0 END) + max(CASE WHEN deletions > 8 THEN 0.10 ELSE 0.0 END) + max(CASE WHEN part_id % 7 = 0 THEN 0.05 ELSE 0.0 END) AS raw0 FROM changes
  WHERE change_type = 'renamed' OR additions > 45 OR file_id % 5 = 0 OR deletions > 8 OR part_id % 7 = 0 GROUP BY 1),
 r AS (SELECT s.commit_id, moment, round(raw0 * CASE WHEN is_merge OR files_changed > 100 THEN 0.6 ELSE 1.0 END, 9) AS raw FROM s JOIN info ON s.commit_id = info.commit_id), t AS (SELECT *, row_number() OVER (ORDER BY raw DESC, moment, commit_id) AS place FROM r)
 SELECT CAST(place AS INTEGER) AS place, commit_id, CAST(round(least(raw, 1.0), 4) AS DOUBLE) AS score, CASE WHEN raw >= 0.7 THEN 'strong' WHEN raw >= 0.4 THEN 'moderate' ELSE 'weak' END AS label FROM t WHERE place <= 50""")
def candidate_ranking(h):
    c = h.changes()
    tests = {"blame": F.col("change_type") == "renamed", "symbol": F.col("additions") > 45, "file": F.col("file_id") % 5 == 0, "range": F.col("deletions") > 8, "text": F.col("part_id") % 7 == 0}
    signals = c.select("commit_id", F.explode(F.array_compact(F.array(*(F.when(t, s) for s, t in tests.items())))).alias("signal"))
    return I.candidate_ranking(signals, info(h), 50)


@query("commits changes", INFO + ", b AS (SELECT commit_id, count(*) AS lines FROM changes WHERE change_type = 'modified' GROUP BY 1), s AS (SELECT b.commit_id, lines, round(least(1.0, 0.75 + 0.25 * lines / CAST((SELECT max(lines) FROM b) AS DOUBLE)) * CASE WHEN is_merge OR files_changed > 100 THEN 0.55 ELSE 1.0 END, 4) AS score FROM b JOIN info ON b.commit_id = info.commit_id) SELECT commit_id, lines, score, CASE WHEN score >= 0.8 THEN 'strong' ELSE 'moderate' END AS label FROM s")
def szz_score(h):
    return I.szz_score(h.changes().where("change_type = 'modified'").select("commit_id"), info(h))


@query("commits", "WITH r AS (SELECT author_id, commit_id, row_number() OVER (PARTITION BY author_id ORDER BY moment, commit_id) - 1 AS k, count(*) OVER (PARTITION BY author_id) AS n FROM commits) SELECT author_id, commit_id, n FROM r WHERE k = (n - 1) // 2")
def bisect_midpoint(h):
    return I.bisect_midpoint(h.commits(), "author_id")


@query("commits", """WITH l AS (SELECT author_id, list(commit_id ORDER BY commit_id) AS c FROM commits GROUP BY 1), m AS (SELECT author_id, c, (len(c) - 1) // 2 + 1 AS k, author_id % 3 AS v FROM l)
 SELECT author_id, array_to_string(CASE v WHEN 0 THEN c[k + 1:] WHEN 1 THEN c[1:k] ELSE list_filter(c, lambda x: x <> c[k]) END, ',') AS remaining FROM m""")
def bisect_step(h):
    rows = h.commits().groupBy("author_id").agg(F.array_sort(F.collect_list("commit_id")).alias("c"))
    tested = F.element_at("c", (F.floor((F.size("c") - 1) / 2) + 1).cast("int"))
    verdict = F.element_at(F.array(F.lit("good"), F.lit("bad"), F.lit("unknown")), (F.col("author_id") % 3 + 1).cast("int"))
    left = I.bisect_step(F.col("c"), tested, verdict)
    return rows.select("author_id", F.array_join(F.transform(left, lambda x: x.cast("string")), ",").alias("remaining"))


@query(sql="""WITH i AS (SELECT p_brand AS file_id, p_partkey AS symbol, p_size * 10 AS first, p_size * 10 + p_partkey % 37 AS last FROM part), p AS (SELECT DISTINCT p_brand AS file_id, (p_partkey * 13) % 550 AS line FROM part),
 h AS (SELECT p.file_id, line, symbol, row_number() OVER (PARTITION BY p.file_id, line ORDER BY last - first, symbol) AS k FROM p JOIN i ON p.file_id = i.file_id AND line BETWEEN first AND last) SELECT file_id, line, symbol FROM h WHERE k = 1""")
def interval_join(h):
    p = h.table("part")
    intervals = p.select(F.col("p_brand").alias("file_id"), F.col("p_partkey").alias("symbol"), (F.col("p_size") * 10).cast("long").alias("first"), (F.col("p_size") * 10 + F.col("p_partkey") % 37).alias("last"))
    return I.interval_join(p.select(F.col("p_brand").alias("file_id"), ((F.col("p_partkey") * 13) % 550).alias("line")).distinct(), intervals)


@query(sql="""WITH c AS (SELECT l_orderkey AS ref, l_partkey AS symbol, CASE l_linenumber % 5 WHEN 0 THEN 'unique' WHEN 1 THEN 'qualified' WHEN 2 THEN 'same_file' WHEN 3 THEN 'imported' ELSE 'same_module' END AS tier FROM lineitem),
 g AS (SELECT ref, tier, min(symbol) AS symbol, CASE tier WHEN 'qualified' THEN 0 WHEN 'same_file' THEN 1 WHEN 'imported' THEN 2 WHEN 'same_module' THEN 3 ELSE 4 END AS k FROM c GROUP BY 1, 2 HAVING count(DISTINCT symbol) = 1), b AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY k) AS r FROM g)
 SELECT ref, symbol AS target, tier, CAST(CASE k WHEN 0 THEN 0.98 WHEN 1 THEN 0.95 WHEN 2 THEN 0.90 WHEN 3 THEN 0.82 ELSE 0.72 END AS DOUBLE) AS confidence FROM b WHERE r = 1""")
def reference_resolution(h):
    names = F.array(*map(F.lit, ("unique", "qualified", "same_file", "imported", "same_module")))
    rows = h.table("lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("symbol"), F.element_at(names, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("tier"))
    return I.resolve_references(rows)


@query("sources", """WITH q AS (SELECT DISTINCT CASE WHEN file_id % 3 = 0 THEN path WHEN file_id % 3 = 1 THEN language || '/' || file_id ELSE 'gone/' || module END AS name FROM sources), x AS (SELECT path, file_id, language || '/' || file_id AS s2, CAST(file_id AS VARCHAR) AS s1 FROM sources),
 e AS (SELECT q.name, x1.file_id AS e, CASE WHEN (SELECT count(*) FROM x WHERE s2 = q.name) = 1 THEN (SELECT min(file_id) FROM x WHERE s2 = q.name) END AS s FROM q LEFT JOIN x x1 ON q.name = x1.path)
 SELECT name, coalesce(e, s) AS file_id, CASE WHEN e IS NOT NULL THEN 'exact' WHEN s IS NOT NULL THEN 'suffix' ELSE 'missing' END AS how FROM e""")
def suffix_resolution(h):
    s = h.sources()
    name = F.when(F.col("file_id") % 3 == 0, F.col("path")).when(F.col("file_id") % 3 == 1, F.concat_ws("/", "language", F.col("file_id").cast("string"))).otherwise(F.concat(F.lit("gone/"), F.col("module")))
    return I.resolve_suffix(s.select(name.alias("name")).distinct(), s)


@query("sources", "WITH i AS (SELECT file_id AS import_id, unnest([module || '/none/' || file_id, module || '/' || language || '/' || (file_id + 1), path]) AS p, unnest([1, 2, 3]) AS pos FROM sources), j AS (SELECT import_id, file_id, row_number() OVER (PARTITION BY import_id ORDER BY pos) AS k FROM i JOIN sources ON p = path) SELECT import_id, file_id FROM j WHERE k = 1")
def import_resolution(h):
    s = h.sources()
    n = F.col("file_id").cast("string")
    candidates = F.array(F.concat_ws("/", "module", F.lit("none"), n), F.concat_ws("/", "module", "language", (F.col("file_id") + 1).cast("string")), F.col("path"))
    return I.resolve_imports(s.select(F.col("file_id").alias("import_id"), candidates.alias("candidates")), s)


@query(sql="SELECT o_orderkey AS id, NULL::VARCHAR AS owner_repo, o_orderkey AS number, CASE o_orderkey % 4 WHEN 0 THEN 'fixes' WHEN 1 THEN 'closes' WHEN 2 THEN 'resolves' ELSE 'mentions' END AS kind, CAST(CASE WHEN o_orderkey % 4 = 3 THEN 0.55 ELSE 0.98 END AS DOUBLE) AS confidence FROM orders WHERE o_orderkey > 0")
def issue_references(h):
    verb = F.element_at(F.array(*map(F.lit, ("Fixes", "closed", "Resolve", "see"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = h.table("orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", verb, F.concat(F.lit("#"), F.col("o_orderkey")), F.lit("and more")).alias("text"))
    return I.issue_references(rows).withColumn("owner_repo", F.nullif("owner_repo", F.lit("")))


@query(sql="SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 <> 0 THEN 'stale' ELSE 'ready' END AS status FROM orders")
def status_normalize(h):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    state = F.when(s == "P", "running").when(k % 7 == 0, F.lit(None)).when((s == "F") & (k % 5 == 0), "failed").otherwise("done")
    return I.status_normalize(h.table("orders").select(k.alias("key"), state.alias("state"), F.lit("a").alias("indexed_sha"), F.when(k % 3 != 0, "b").otherwise("a").alias("head_sha")))


@query("sources", "SELECT file_id, CASE WHEN file_id % 11 = 0 THEN 'excluded' WHEN lines * 100 > 4500 THEN 'too_large' WHEN file_id % 13 = 0 THEN 'binary' WHEN language NOT LIKE 'S%' AND language NOT LIKE 'P%' THEN 'unsupported' ELSE 'parsed' END AS status FROM sources")
def parse_status(h):
    path = F.when(F.col("file_id") % 11 == 0, F.concat(F.lit("x/vendor/"), F.col("path"))).otherwise(F.col("path"))
    known = F.col("language").rlike("^[SP]")
    return I.parse_status(h.sources().select("file_id", path.alias("path"), (F.col("lines") * 100).alias("size_bytes"), (F.col("file_id") % 13 == 0).alias("is_binary"), known.alias("supported")), 4500)


def diffs(h):
    """A diff without context for each file of a commit: a hunk for each line of the change, at ten times its number,
    that removes a comment, removes code, or only adds."""
    n = F.col("change_order")
    start = (n * 10).cast("string")
    body = F.when(n % 3 == 0, "-# note\n+# other").when(n % 3 == 1, "-return broken\n+return fixed").otherwise("+added")
    hunk = F.concat(F.lit("@@ -"), start, F.lit(" +"), start, F.lit(" @@\n"), body)
    once = h.changes().select("commit_id", "file_id", "change_order", hunk.alias("hunk")).distinct()
    return once.groupBy("commit_id", "file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("change_order", "hunk"))), lambda x: x["hunk"]), "\n").alias("diff"))


SZZ = """WITH d AS (SELECT DISTINCT commit_id, file_id, change_order AS n FROM changes), l AS (SELECT *, n = max(n) OVER (PARTITION BY commit_id, file_id) AS last FROM d),
 b AS (SELECT commit_id, file_id, unnest(CASE WHEN n % 3 = 1 THEN [n * 10] WHEN last THEN [n * 10 - 1, n * 10, n * 10 + 1, n * 10 + 2] ELSE [n * 10 - 1, n * 10, n * 10 + 1] END) AS line FROM l)"""


@query("changes", SZZ + " SELECT commit_id, file_id, CAST(line AS BIGINT) AS line FROM b")
def szz_lines(h):
    d = diffs(h).withColumn("id", F.struct("commit_id", "file_id"))
    return R.blamed_lines(d.select("id", "diff")).select("id.commit_id", "id.file_id", "line")


BLAME = "bl AS (SELECT file_id, line, min(moment * 1000000 + commit_id) % 1000000 AS origin FROM (SELECT c.file_id, unnest(range(change_order * 10 - 5, change_order * 10 + 5)) AS line, moment, c.commit_id FROM changes c JOIN commits ON c.commit_id = commits.commit_id) GROUP BY 1, 2)"


@query("commits changes", SZZ + ", " + BLAME + """, info AS (SELECT commits.commit_id, is_merge, n AS files_changed FROM commits JOIN (SELECT commit_id, count(DISTINCT file_id) AS n FROM changes GROUP BY 1) c ON commits.commit_id = c.commit_id),
 f AS (SELECT origin AS commit_id, count(*) AS lines FROM b JOIN bl ON b.file_id = bl.file_id AND b.line = bl.line WHERE b.commit_id % 7 = 0 AND b.commit_id <> origin GROUP BY 1), s AS (SELECT f.commit_id, lines, round(least(1.0, 0.75 + 0.25 * lines / CAST((SELECT max(lines) FROM f) AS DOUBLE)) * CASE WHEN is_merge OR files_changed > 100 THEN 0.55 ELSE 1.0 END, 4) AS score FROM f JOIN info ON f.commit_id = info.commit_id)
 SELECT commit_id, lines, score, CASE WHEN score >= 0.8 THEN 'strong' ELSE 'moderate' END AS label FROM s""")
def szz_analysis(h):
    """Fixes are the commits of every seventh number; a line's origin is the first commit that touched its place."""
    place = F.explode(F.sequence(F.col("change_order") * 10 - 5, F.col("change_order") * 10 + 4)).alias("line")
    touched = h.changes().select("commit_id", "file_id", place).join(h.commits().select("commit_id", "moment"), "commit_id")
    blame = touched.groupBy("file_id", "line").agg(F.min(F.struct("moment", "commit_id")).alias("x")).select("file_id", F.col("line").cast("long").alias("line"), F.col("x.commit_id").alias("origin"))
    return I.szz_analysis(szz_lines(h).where("commit_id % 7 = 0"), blame, info(h))


@query("sources", """WITH f AS (SELECT file_id AS id, CASE file_id % 4 WHEN 0 THEN path WHEN 1 THEN '/srv/' || upper(path) WHEN 2 THEN '/usr/site-packages/' || path ELSE 'gone/' || module END AS p, lines AS line, 'f' || file_id AS fn FROM sources)
 SELECT id, CASE WHEN id % 4 = 0 THEN 'exact' WHEN id % 4 = 1 THEN CASE WHEN line >= 20 THEN 'symbol_match' ELSE 'path_match' END WHEN id % 4 = 2 THEN 'external' ELSE 'unresolved' END AS status, CASE WHEN id % 4 < 2 THEN id END AS file_id,
  CASE WHEN id % 4 < 2 AND line >= 20 THEN 'f' || id END AS symbol, CAST(CASE WHEN id % 4 < 2 AND line >= 20 THEN 1.0 END AS DOUBLE) AS confidence FROM f""")
def frame_resolution(h):
    s, k = h.sources(), F.col("file_id") % 4
    path = F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit("/srv/"), F.upper("path"))).when(k == 2, F.concat(F.lit("/usr/site-packages/"), "path")).otherwise(F.concat(F.lit("gone/"), "module"))
    name = F.concat(F.lit("f"), F.col("file_id").cast("string"))
    frames = s.select(F.col("file_id").alias("id"), F.lit(0).alias("frame"), path.alias("file"), F.col("lines").alias("line"), F.concat(F.lit("X."), name).alias("function"))
    symbols = s.select("file_id", name.alias("symbol"), name.alias("name"), F.lit(20).alias("first"), F.lit(50).alias("last")).unionByName(s.select("file_id", F.lit("o").alias("symbol"), F.lit("o").alias("name"), F.lit(20).alias("first"), F.lit(49).alias("last")))
    return R.resolve_frames(frames, s, symbols).drop("frame")


REPORT = INFO + """, s AS (SELECT commit_id, max(CASE WHEN change_type = 'renamed' THEN 0.45 ELSE 0.0 END) + max(CASE WHEN additions > 45 THEN 0.25 ELSE 0.0 END) + max(CASE WHEN deletions > 8 THEN 0.10 ELSE 0.0 END) AS raw0, array_to_string(list_filter([CASE WHEN bool_or(change_type = 'renamed') THEN 'blame' END, CASE WHEN bool_or(deletions > 8) THEN 'range' END, CASE WHEN bool_or(additions > 45) THEN 'symbol' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM changes GROUP BY 1 HAVING bool_or(change_type = 'renamed' OR additions > 45 OR deletions > 8)), r AS (SELECT s.commit_id, moment, reasons, round(raw0 * CASE WHEN is_merge OR files_changed > 100 THEN 0.6 ELSE 1.0 END, 9) AS raw FROM s JOIN info ON s.commit_id = info.commit_id), t AS (SELECT *, row_number() OVER (ORDER BY raw DESC, moment, commit_id) AS place FROM r)"""


@query("commits changes", REPORT + """ SELECT CAST(place AS INTEGER) AS place, t.commit_id, CAST(round(least(raw, 1.0), 4) AS DOUBLE) AS score, CASE WHEN raw >= 0.7 THEN 'strong' WHEN raw >= 0.4 THEN 'moderate' ELSE 'weak' END AS label, reasons, c_name AS author,
 (SELECT count(DISTINCT s_nationkey) FROM changes x JOIN supplier ON x.file_id = s_suppkey WHERE x.commit_id = t.commit_id) AS modules FROM t JOIN commits ON t.commit_id = commits.commit_id JOIN customer ON author_id = c_custkey WHERE place <= 25""")
def investigation_report(h):
    tests = {"blame": F.col("change_type") == "renamed", "symbol": F.col("additions") > 45, "range": F.col("deletions") > 8}
    signals = h.changes().select("commit_id", F.explode(F.array_compact(F.array(*(F.when(t, s) for s, t in tests.items())))).alias("signal"))
    modules = h.changes().join(h.files(), "file_id").groupBy("commit_id").agg(F.countDistinct("module_id").alias("modules"))
    return I.investigation_report(signals, info(h), h.commits().join(h.authors(), "author_id").select("commit_id", F.col("name").alias("author")), modules, 25)
