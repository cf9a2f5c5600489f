"""Table functions used from SQL."""

from ..functions import tables
from .registry import query


@query(sql="WITH c AS (SELECT doc_id, text, unnest(range((length(text) + 499) // 500)) AS chunk FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, sha256(text[chunk * 500 + 1:chunk * 500 + 500]) AS digest FROM c")
def chunks_by_sql(h):
    tables.register(h.spark)
    h.table("documents").createOrReplaceTempView("_chunked")
    return h.spark.sql("SELECT d.doc_id, c.chunk, sha2(c.text, 256) AS digest FROM _chunked d, LATERAL chunk_text(d.text, 500) c")


#: Each change of a file puts a hunk of as many lines as it adds after the line that its number in the commit tells.
HUNKS = "x AS (SELECT l_suppkey AS file, l_orderkey AS pos, min(l_linenumber) AS k, CAST(min(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)"


@query(sql="WITH RECURSIVE " + HUNKS + """, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pos) AS nth, count(*) OVER (PARTITION BY file) AS changes FROM x),
 s AS (SELECT file, nth, changes, list_transform(range(n), lambda i: pos) AS lines FROM o WHERE nth = 1
  UNION ALL SELECT s.file, o.nth, s.changes, lines[:least(o.k - 1, len(lines))] || list_transform(range(o.n), lambda i: o.pos) || lines[least(o.k - 1, len(lines)) + 1:] FROM s JOIN o ON s.file = o.file AND o.nth = s.nth + 1),
 l AS (SELECT file, unnest(lines) AS origin, unnest(range(len(lines))) AS at_line FROM s WHERE nth = changes) SELECT file, origin, count(*) AS lines, sum(at_line + 1) AS places FROM l GROUP BY 1, 2""")
def line_origins(h):
    """Which change each line of each file comes from, as lines and the sum of their places."""
    tables.register(h.spark)
    h.table("lineitem").createOrReplaceTempView("_lines")
    return h.spark.sql("""
        WITH x AS (SELECT l_suppkey AS file, l_orderkey AS pos, min(l_linenumber) AS k, CAST(min(l_quantity) AS BIGINT) AS n FROM _lines GROUP BY 1, 2),
        y AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM x),
        h AS (SELECT file, pos, least(k - 1, held) AS old_start, 0L AS old_count, least(k - 1, held) + 1 AS new_start, n AS new_count FROM y)
        SELECT file, origin, sum(last - first + 1) AS lines, sum((first + last) * (last - first + 1) div 2) AS places FROM line_origins(TABLE(h) PARTITION BY file ORDER BY pos) GROUP BY file, origin""")
