"""Secret scans that link the parts of a credential, in DataFrame functions only.

Passwords and tokens that a name is assigned to, access keys and long hexadecimal strings are reported as they
stand. Weak candidates are reported only where parts that complete them lie in the same text with at most ``scope``
characters between the spans, none where they touch or overlap: an account name with a secret or a bare key, a bare
key with an access key or an account name, an endpoint with a secret, or with a bare key and an identifier. An
endpoint alone doesn't vouch for a bare key, nor the key for it.

With spans in order of their starts, the largest end so far and the next start of each role are its interval join
with the other parts, which makes no pairs. A weak span may hold or cross one of the others, as an endpoint does
that has its secret in it; one that lies within an assignment, access key or hexadecimal string is that one's text.

Positions come from the pieces between matches: a match starts after all pieces and matches before it.

Edge cases: null or empty texts have no spans; rows that agree in doc_id and text are scanned once and given
back as often as they came (texts of one doc_id are told apart by length and a 64-bit hash); a null doc_id is kept; an empty table gives no rows; other columns are ignored.
Characters are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length. The first three are the base kinds.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("account", r"""((?i:client_?id|account|user_?name|login|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", 2, 4),
    ("bare", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    ("endpoint", r"""(?i:https?|ftp|postgres|postgresql|mysql|redis|amqp|mongodb|s3)://[^\x20\x09-\x0D"'<>]{4,}|(?i:endpoint|hostname)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,}""", 0, 4),
]
BASE = 3
ACCOUNT, BARE, ENDPOINT = 4, 5, 6
#: What can complete weak parts: identifiers, secrets that stand by themselves, and bare keys.
ROLES = {"identifier": (2, ACCOUNT), "secret": (1, 3), "bare": (BARE,)}


def _matches(text: Column, number: int, pattern: str, group: int) -> Column:
    """An array of (kind, pos, gap before, length, length that counts) of the pattern's matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.filter(F.arrays_zip(whole.alias("m"), counted.alias("g"), F.split(text, pattern, -1).alias("s")), lambda x: x["m"].isNotNull())
    found = F.transform(zipped, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("pos"), F.length(x["s"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["g"]).alias("counts")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,size:int,counts:int>>"))


def linked_secrets(docs: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    arrays = F.concat(*(_matches(F.col("t"), k, p, g) for k, (_, p, g, _) in enumerate(KINDS, 1)))
    scanned = rows.select("doc_id", F.xxhash64("t").alias("key"), F.length("t").alias("n"), arrays.alias("found"))
    # matches, not texts, are shuffled
    once = scanned.groupBy("doc_id", "key", "n").agg(F.first("found").alias("found"), F.count("*").alias("copies"))
    each = once.select("doc_id", "key", "n", "copies", F.explode_outer("found").alias("x")).select("doc_id", "key", "n", "copies", "x.*")

    of_text = Window.partitionBy("doc_id", "key", "n")
    in_kind = Window.partitionBy("doc_id", "key", "n", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", (F.sum("gap").over(in_kind) + F.sum("size").over(in_kind)).cast("long"))
    placed = placed.withColumn("start", F.col("end") - F.col("size"))
    least = F.lit(False)
    for k, (_, _, _, length) in enumerate(KINDS, 1):
        least = least | ((F.col("kind") == k) & (F.col("counts") >= length))
    valid = placed.where(F.col("kind").isNull() | least)
    dropped = placed.groupBy("doc_id", "key", "n").agg(F.max("copies").alias("copies"))

    base = F.col("kind") <= BASE
    so_far, onward = of_text.orderBy("start").rangeBetween(Window.unboundedPreceding, 0), of_text.orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    within = F.max(F.when(base, F.col("end"))).over(so_far) >= F.col("end")
    apart = valid.withColumn("clear", base | ~F.coalesce(within, F.lit(False))).where(F.col("kind").isNull() | F.col("clear"))

    def reached(kinds: tuple[int, ...]) -> Column:
        of_role = F.col("kind").isin(*kinds)
        before = F.max(F.when(of_role, F.col("end"))).over(so_far) >= F.col("start") - scope
        after = F.min(F.when(of_role, F.col("start"))).over(onward) <= F.col("end") + scope
        return (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).cast("int")

    seen = apart.select("*", *(reached(kinds).alias(role) for role, kinds in ROLES.items()))
    near = {role: F.col(role) == 1 for role in ROLES}
    whole = {ACCOUNT: near["secret"] | near["bare"], BARE: near["identifier"], ENDPOINT: near["secret"] | (near["bare"] & near["identifier"])}
    linked = base
    for kind, parts in whole.items():
        linked = linked | ((F.col("kind") == kind) & parts)
    kept = seen.where(linked)

    names = F.array(*(F.lit(k[0]) for k in KINDS))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    spans = kept.groupBy("doc_id", "key", "n").agg(F.array_sort(F.collect_list(span)).alias("all"))
    every = dropped.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.key") == F.col("s.key")) & (F.col("d.n") == F.col("s.n")), "left")
    told = every.select("d.doc_id", "copies", F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("all"))

    def listed(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["start"], x["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")

    out = told.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k - 1][0]}") for k in range(1, BASE + 1)),
        F.sha2(listed(F.filter("all", lambda x: x["kind"] <= BASE)), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda x: x["kind"] > BASE)).cast("long").alias("n_linked"), F.sequence(F.lit(1), F.col("copies")).alias("c"),
    )
    return out.withColumn("c", F.explode("c")).drop("c")
