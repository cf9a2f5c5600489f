"""Text evidence and retrieval."""

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .registry import query

TOKENS = ["license", "moron", "que", "tion", "token"]
LEX = "SELECT doc_id, {n} AS matched FROM documents WHERE {n} > 0".format(n=" + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in TOKENS))


REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(?s)-----BEGIN [^-]*PRIVATE KEY-----.*?-----END [^-]*PRIVATE KEY-----', '[REDACTED PRIVATE KEY]', 'g'),
 '(?i)((?:password|passwd|token|secret|api[_-]?key)\s*[:=]\s*)(?:"[^"]*"|''[^'']*''|\S+)', '\1[REDACTED]', 'g'), '\b(?:gh[pousr]_[A-Za-z0-9]{{20,}}|AKIA[0-9A-Z]{{16}})\b', '[REDACTED TOKEN]', 'g'), '(?i)(?:[A-Z]:\\|/(?:home|users)/)[^\s"'']+', '[REDACTED LOCAL PATH]', 'g')"""


@query(sql="SELECT doc_id, sha256(" + REDACTED.format(t="text") + ") AS digest FROM documents")
def redact_secrets(h):
    return h.table("documents").select("doc_id", F.sha2(R.redacted(F.col("text")), 256).alias("digest"))


@query(sql=r"SELECT p_partkey AS file_id, sha256(lower(regexp_replace(p_name, '\s+', '', 'g'))) AS digest FROM part")
def normalized_hash(h):
    return h.table("part").select(F.col("p_partkey").alias("file_id"), R.normalized_hash(F.col("p_name")).alias("digest"))


@query(sql=r"SELECT conv_id, turn, len(regexp_extract_all(regexp_replace(text, '(?s)/\*.*?\*/|//[^\n]*|#[^\n]*', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]')) AS tokens FROM conversations")
def token_counts(h):
    return h.table("conversations").select("conv_id", "turn", F.size(R.code_tokens(F.col("text"))).cast("long").alias("tokens"))


@query(sql="WITH d AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS chunk FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, length(substring(text, chunk * 1000 + 1, 1000)) AS n_chars, sha256(substring(text, chunk * 1000 + 1, 1000)) AS digest FROM d")
def chunk_fixed(h):
    return R.chunk_fixed(h.table("documents"), 1000)


@query(sql="""WITH RECURSIVE q AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, k, length(p) AS n, unnest(range((length(p) + 4999) // 5000)) AS j FROM q), w AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS i, least(5000, n - j * 5000) AS n FROM c),
 r AS (SELECT doc_id, i, n AS held, 0 AS chunk FROM w WHERE i = 1 UNION ALL SELECT w.doc_id, w.i, CASE WHEN held + 2 + w.n > 5000 THEN w.n ELSE held + 2 + w.n END, CASE WHEN held + 2 + w.n > 5000 THEN chunk + 1 ELSE chunk END FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1)
 SELECT doc_id, chunk, CAST(max(held) AS INTEGER) AS n_chars FROM r GROUP BY 1, 2""")
def chunk_paragraphs(h):
    return R.chunk_paragraphs(h.table("documents"), 5000).select("doc_id", "chunk", F.length("text").alias("n_chars"))


@query(sql=f"SELECT doc_id, matched, round(0.35 + 0.25 * matched / {len(TOKENS)}.0, 6) AS score FROM ({LEX}) ORDER BY score DESC, doc_id LIMIT 50")
def lexical_search(h):
    return R.lexical_search(h.table("documents"), TOKENS, 50)


def first_vector(h):
    return h.table("embeddings").orderBy("vec_id").select("embedding").first()[0]


VEC = "WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, greatest(0.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[]))) AS s FROM embeddings, q)"


@query(sql=VEC + " SELECT vec_id, round(s, 5) AS score FROM s ORDER BY s DESC, vec_id LIMIT 25")
def vector_topk(h):
    return R.vector_topk(h.table("embeddings"), first_vector(h), 25)


@query(sql=VEC + f""", l AS (SELECT doc_id, round(0.35 + 0.25 * matched / {len(TOKENS)}.0, 6) AS score FROM ({LEX}) ORDER BY score DESC, doc_id LIMIT 40),
 v AS (SELECT vec_id AS doc_id, round(s, 5) AS score FROM s ORDER BY s DESC, vec_id LIMIT 40), u AS (SELECT *, 'lexical' AS reason FROM l UNION ALL SELECT *, 'vector' FROM v)
 SELECT doc_id, round(least(1.0, max(score) + 0.05 * (count(*) - 1)), 6) AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM u GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""")
def hybrid_search(h):
    lexical = R.lexical_search(h.table("documents"), TOKENS, 40).select("doc_id", "score", F.lit("lexical").alias("reason"))
    vector = R.vector_topk(h.table("embeddings"), first_vector(h), 40).select(F.col("vec_id").alias("doc_id"), "score", F.lit("vector").alias("reason"))
    return R.hybrid_fusion(lexical, vector, k=20)


@query(sql="WITH r AS (SELECT doc_id, source, n_chars / 40000.0 AS s, row_number() OVER (PARTITION BY source ORDER BY n_chars / 40000.0 DESC, doc_id) AS place FROM documents) SELECT doc_id, source, place, round(s - 0.03 * (place - 1), 6) AS decayed FROM r WHERE place <= 3")
def topk_per_type(h):
    rows = h.table("documents").select("doc_id", "source", (F.col("n_chars") / 40000.0).alias("s"))
    return R.topk_per_type(rows, "source", "s", "doc_id").select("doc_id", "source", F.col("place").cast("long").alias("place"), "decayed")


@query(sql="WITH t AS (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place, doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20), b AS (SELECT *, 120000 - coalesce(sum(n_chars) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM t) SELECT place, doc_id, CAST(least(n_chars, l) AS BIGINT) AS taken FROM b WHERE l >= 300")
def budget_packing(h):
    from pyspark.sql import Window

    top = h.table("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    return R.budget_packing(top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long")), 120000, 300)


@query("versions", """WITH d AS (SELECT lineage, name, value >= (SELECT avg(value) FROM versions) AS direct FROM versions), e AS (SELECT lineage, coalesce(bool_or(name = 'view' AND direct), false) AS h, coalesce(bool_or(name = 'click' AND direct), false) AS c, coalesce(bool_or(name = 'purchase' AND direct), false) AS p, coalesce(bool_or(name = 'error' AND direct), false) AS i FROM d GROUP BY 1)
 SELECT c_custkey AS lineage, CASE WHEN e.lineage IS NULL THEN 'insufficient' WHEN h AND c AND p AND i THEN 'strong' WHEN (h AND c) OR (p AND i) OR (c AND p) THEN 'moderate' ELSE 'weak' END AS level FROM customer LEFT JOIN e ON c_custkey = e.lineage""")
def evidence_sufficiency(h):
    """Events above the average are direct evidence of their customers, others are related."""
    kind = F.create_map(*map(F.lit, ("view", "symbol_change", "click", "commit_diff", "purchase", "pull_request", "error", "issue", "signup", "dependency_context")))
    v = h.versions()
    rows = v.select("lineage", kind[F.col("name")].alias("type"), F.when(F.col("value") >= v.agg(F.avg("value")).scalar(), "direct").otherwise("lexical").alias("relationship"))
    return R.sufficiency(rows, h.authors().select(F.col("author_id").alias("lineage")), "lineage")


@query(sql="""WITH s AS (SELECT doc_id, lang, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.w AS x, b.w AS y FROM s a JOIN s b ON a.lang = b.lang AND a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w)) AND len(a.w) > 0),
 j AS (SELECT a, b, round(len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE), 6) AS similarity FROM p) SELECT * FROM j WHERE similarity >= 0.8""")
def near_duplicate_docs(h):
    return R.token_set_pairs(h.table("documents"), 0.8)


LINK = r"""SELECT page_id, unnest(regexp_extract_all(html, '{p}', 1)) AS t, '{k}' AS kind FROM pages"""


@query(sql="WITH l AS (" + LINK.format(p=r"""(?i)<(?:a|link)\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']""", k="href") + " UNION ALL " + LINK.format(p=r"""(?i)<(?:script|img)\b[^>]*?\bsrc\s*=\s*["'']([^"'']+)["'']""", k="src") + r"), c AS (SELECT page_id, regexp_replace(t, '[?#].*$', '') AS target, kind FROM l) SELECT DISTINCT page_id, target, kind FROM c WHERE target <> '' AND NOT regexp_matches(target, '^(?i)(data:|mailto:|javascript:|https?:|//)')")
def html_link_refs(h):
    return R.html_links(h.table("pages"))


@query(sql="SELECT * FROM (SELECT 'document' AS kind, doc_id AS id, n_chars AS rank FROM documents WHERE contains(lower(text), 'moron') UNION ALL SELECT 'turn', conv_id * 1000 + turn, length(text) FROM conversations WHERE contains(lower(text), 'moron') UNION ALL SELECT 'page', page_id, length(html) FROM pages WHERE contains(lower(html), 'moron') UNION ALL SELECT 'part', p_partkey, length(p_name) FROM part WHERE contains(lower(p_name), '1')) ORDER BY rank DESC, kind, id LIMIT 100")
def multi_source_search(h):
    from ..functions.scalars import literal_like

    hits = [("document", "documents", F.col("doc_id"), "text", "moron"), ("turn", "conversations", F.col("conv_id") * 1000 + F.col("turn"), "text", "moron"), ("page", "pages", F.col("page_id"), "html", "moron"), ("part", "part", F.col("p_partkey"), "p_name", "1")]
    rows = None
    for kind, table, key, text, part in hits:
        one = h.table(table).where(literal_like(F.col(text), part)).select(F.lit(kind).alias("kind"), key.cast("long").alias("id"), F.length(text).cast("long").alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.orderBy(F.desc("rank"), "kind", "id").limit(100)
