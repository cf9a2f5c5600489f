"""Repair of conversations: the cheapest edits that give a system turn, if any, and then user and assistant in turn.

A conversation's rows are one letter each, for role and fault, cut into blocks of at most BLOCK rows. Each distinct
block is solved once, by memoised recursion: for every state of the wanted pattern before and after it, the least
cost and, of the cheapest, the first string of edits. Audits are joined back to the blocks, put together in order
and replayed over the rows.

Edits are K (keep, 0), R (give it the role of user or assistant, 1), D (delete, 2; a must for blank rows and those
whose role and text came before) and I (insert a user or assistant without text, 5). A truncated row that is kept
costs 5 more. An edit string tells the repaired roles, as a system turn can only be kept and only in front. Two
insertions that follow each other are never cheapest: without both, the same rows still fit.

Rows are put in order by ranges of (conv_id, turn, role, digest of the text), so a long conversation lies in several
tasks; whether a role and text came before is told by joining the first place of each, and no place comes twice. Only
the replay takes a conversation in one task, as a stream of rows in order of which it holds none.

Edge cases: null roles and texts are one space, so such a text is blank; a null conv_id is one more conversation;
null turns come first and don't count for gaps; rows of one turn are in order of role and the text's SHA-256; rows
that repeat are duplicates, all but the first; roles other than system, user and assistant are known by their first
letter, and others than s, u and a can't be kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: The most rows of a block.
BLOCK = 200
#: Where the pattern (s?(ua)+)? stands: nothing yet, after s, after u, after a; and where it may end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: Solved signatures that are broadcast, by their letters; beyond, they are joined by a shuffle in which common ones
#: are dealt over SALTS tasks.
MOST_LETTERS, SALTS = 1_000_000, 16
MOVES = "array<struct<a:int,b:int,cost:long,audit:string>>"
SPACE = r"\x20\x09-\x0D"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by a hash of conv_id and turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _clean(rows: DataFrame) -> DataFrame:
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _letter(dup: Column) -> Column:
    """x for what must go, else the role's initial or o, as a capital where the text is cut off."""
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return F.when(F.col("blank") | dup, "x").when(F.col("cut"), F.upper(initial)).otherwise(initial)


def signatures(rows: DataFrame) -> DataFrame:
    """Blocks: conv_id, part, block (their order), signature, and how many rows are blank, duplicate and truncated."""
    of_text = rows.select(
        "conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    placed = materialise(of_text.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "conversation-rows")
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    told = placed.join(first, "at", "left").withColumn("dup", F.col("first").isNull())
    told = told.select("conv_id", "at", F.shiftrightunsigned("at", 33).alias("part"), "blank", (~F.col("blank") & F.col("dup")).alias("dup"), "cut", _letter(F.col("dup")).alias("letter"))
    # a part holds a range's rows of a conversation
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at"))
    blocks = told.withColumn("block", F.floor((nth - 1) / BLOCK)).groupBy("conv_id", "part", "block")
    count = lambda c: F.sum(c.cast("long"))
    return blocks.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "").alias("signature"),
        count(F.col("blank")).alias("blank"), count(F.col("dup")).alias("duplicate"), count(F.col("cut") & (F.col("letter") != "x")).alias("truncated"),
    )


def solve(signature: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, least cost, its first edit string) of a block, for the states that can be joined."""
    memo: dict = {}

    def best(i: int, state: int, end: int, after_insert: bool) -> tuple[int, str] | None:
        key = i, state, end, after_insert
        if key in memo:
            return memo[key]
        found = []

        def then(cost: int, edit: str, j: int, to: int) -> None:
            rest = best(j, to, end, edit == "I")
            if rest:
                found.append((cost + rest[0], edit + rest[1]))

        if i == len(signature) and state == end:
            found.append((0, ""))
        if i < len(signature):
            letter = signature[i]
            low, more = letter.lower(), 5 if letter.isupper() else 0
            then(2, "D", i + 1, state)
            if letter != "x":
                if low in NEXT[state]:
                    then(more, "K", i + 1, NEXT[state][low])
                then(1 + more, "R", i + 1, ASSISTANT if state == USER else USER)
        if not after_insert:
            then(5, "I", i, ASSISTANT if state == USER else USER)
        memo[key] = min(found, default=None)
        return memo[key]

    return [(a, b, *r) for a in range(4) for b in range(4) if (r := best(0, a, b, False))]


def solve_all(signed: DataFrame) -> DataFrame:
    """signature, moves: each distinct signature solved once."""
    schema = pa.schema([("signature", pa.string()), ("moves", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                names = b.column(0).slice(at, 500)
                moves = [[dict(zip("ab", m[:2]), cost=m[2], audit=m[3]) for m in solve(s)] for s in names.to_pylist()]
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(moves, schema.field(1).type)], schema=schema)

    return signed.select("signature").distinct().mapInArrow(solved, f"signature string, moves {MOVES}")


def _with_moves(blocks: DataFrame, solved: DataFrame) -> DataFrame:
    letters = solved.agg(F.sum(F.length("signature") + 20)).first()[0] or 0
    if letters <= MOST_LETTERS:
        return blocks.join(F.broadcast(solved), "signature")
    dealt = solved.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return blocks.withColumn("salt", F.pmod(F.xxhash64("conv_id", "part", "block"), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), ["signature", "salt"]).drop("salt")


class Replay:
    """One conversation as its records come: blocks, then rows in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.best = {NONE: (0, "")}
        self.counts = [0, 0, 0]
        self.audit: str | None = None
        self.cost = self.at = self.place = self.illegal = self.turns = 0
        self.state, self.initial, self.low, self.last = NONE, None, None, None

    def add_block(self, moves: list[dict], counts: tuple[int, int, int]) -> None:
        new: dict[int, tuple[int, str]] = {}
        for m in moves:
            if m["a"] in self.best:
                cost, audit = self.best[m["a"]]
                found = (cost + m["cost"], audit + m["audit"])
                new[m["b"]] = min(new.get(m["b"], found), found)
        self.best = new
        self.counts = [x + y for x, y in zip(self.counts, counts)]

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = min(self.best[s] for s in ENDS if s in self.best)

    def give(self, role: str, text: str) -> tuple:
        self.place += 1
        self.state = NEXT[self.state][role[:1]]
        return self.place, role, text

    def wanted(self) -> str:
        return "assistant" if self.state == USER else "user"

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.give(self.wanted(), "")

    def add_row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """The repaired rows that are now settled: (place, role, text)."""
        self.settle()
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.last:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.last = turn
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.give(role if edit == "K" else self.wanted(), text)

    def close(self) -> Iterator[tuple]:
        self.settle()
        yield from self.inserted()

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.turns
        return gaps, *self.counts, self.illegal, self.cost, self.audit


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPLAYED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), *((c, pa.int64()) for c in SUMMARY), ("audit", pa.string())])
REPLAYED_SQL = "conv_id long, place long, role string, text string, " + ", ".join(f"{c} long" for c in SUMMARY) + ", audit string"


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held, now = 0, None
    empty = (None,) * (len(SUMMARY) + 1)

    def closed(r: Replay) -> Iterator[tuple]:
        yield from ((r.conv_id, *x, *empty) for x in r.close())
        yield r.conv_id, None, None, None, *r.summary()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), REPLAYED)], schema=REPLAYED)
        out.clear()
        return made

    for b in batches:
        for r in b.to_pylist():
            if now is None or now.conv_id != r["conv_id"]:
                if now is not None:
                    out.extend(closed(now))
                now = Replay(r["conv_id"])
            if r["kind"] == 1:
                now.add_block(r["moves"], (r["blank"], r["duplicate"], r["truncated"]))
            elif r["kind"] == 2:
                out.extend((now.conv_id, *x, *empty) for x in now.add_row(r["turn"], r["role"], r["text"]))
                held += len(r["text"])
            if len(out) > 10_000 or (out and held > 8 << 20):
                held = 0
                yield flush()
    if now is not None:
        out.extend(closed(now))
    if out:
        yield flush()


def replay(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """The repaired rows (conv_id, place from 1, role, text) of each conversation in order and then, with a null place,
    its gaps, counts of faults, illegal neighbours, cost and audit. Conversations lie whole in their partitions."""
    rows = _clean(rows)
    blocks = materialise(signatures(rows), "conversation-blocks")
    solved = materialise(solve_all(blocks), "conversation-audits")
    given = blocks if originals is None else originals
    records = (
        given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("kind", F.lit(0))
        .unionByName(_with_moves(blocks, solved).drop("signature").withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(rows.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    )
    ordered = records.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "block", F.col("turn").asc_nulls_first(), "role", "digest").drop("digest", "part", "block")
    return ordered.mapInArrow(_replayed, REPLAYED_SQL)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations."""
    return replay(rows).where("place IS NOT NULL").select("conv_id", "place", "role", "text")


def audits(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
    schema = pa.schema([f for f in REPLAYED if f.name not in ("place", "role", "text")] + [pa.field("repaired_sha256", pa.string())])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, some = hashlib.sha256(), False
        for b in batches:
            out = []
            for conv, place, role, text, *summary in zip(*(c.to_pylist() for c in b.columns)):
                if place is None:
                    out.append((conv, *summary, h.hexdigest()))
                    h, some = hashlib.sha256(), False
                else:
                    h.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    made = "conv_id long, " + ", ".join(f"{c} long" for c in SUMMARY) + ", audit string, repaired_sha256 string"
    return replay(rows, originals).mapInArrow(digested, made)


def oracle() -> str:
    """DuckDB SQL of the same audits over the damaged table: one row at a time, with the least cost and edits of every
    state so far, and the rows told from the edits."""
    spaces = r"[^ \t\n\x0B\f\r]"

    def plus(state: str, cost: str, edit: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} END"

    def to(state: int, low: str) -> str:
        keep = {SYSTEM: [NONE], USER: [NONE, SYSTEM, ASSISTANT], ASSISTANT: [USER]}.get(state, [])
        ways = [plus(f"v{state}", "2", "D")]
        for s in keep:
            ways.append(f"CASE WHEN NOT gone AND initial = '{low}' THEN {plus(f'v{s}', 'more', 'K')} END")
            if state != SYSTEM:
                ways.append(f"CASE WHEN NOT gone THEN {plus(f'v{s}', '(1 + more)', 'R')} END")
        return f"list_min([{', '.join(ways)}])"

    inserted = [
        "v0", "v1", f"list_min([v2, {plus('v0', '5', 'I')}, {plus('v1', '5', 'I')}, {plus('v3', '5', 'I')}])", f"list_min([v3, {plus('v2', '5', 'I')}])",
    ]
    step = ", ".join(f"{e} AS v{i}" for i, e in enumerate(inserted))
    return rf"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS b FROM conversations),
        h AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS kind FROM k, crc),
        d AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
        o AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, NOT regexp_matches(text, '{spaces}') AS blank FROM d),
        f AS MATERIALIZED (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup,
                     NOT regexp_matches(text, '[.!?][ \t\n\x0B\f\r]*\z') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM o),
        r AS MATERIALIZED (SELECT *, blank OR dup AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM f),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS rows, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
                     count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
        w AS (SELECT conv_id, 0 AS n, {step} FROM (SELECT DISTINCT conv_id, {{'c': 0, 'a': ''}} AS v0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS v1,
                     CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS v2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS v3 FROM r)
              UNION ALL SELECT conv_id, n, {step} FROM (SELECT r.conv_id, CAST(r.n AS INTEGER) AS n, {', '.join(f'{to(i, low)} AS v{i}' for i, low in enumerate(['', 's', 'u', 'a']))}
                     FROM w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = w.n + 1)),
        b AS MATERIALIZED (SELECT w.conv_id, list_min([v0, v3]).c AS cost, list_min([v0, v3]).a AS audit FROM w JOIN c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.n = c.rows),
        l AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(length(audit))) AS i FROM b WHERE audit <> ''),
        p AS (SELECT *, sum(CAST(e <> 'I' AS INTEGER)) OVER x AS n, sum(CAST(e <> 'D' AS INTEGER)) OVER x AS place FROM l WINDOW x AS (PARTITION BY conv_id ORDER BY i)),
        q AS (SELECT p.conv_id, i, place, e, r.role, CASE WHEN e = 'I' THEN '' ELSE r.text END AS text,
                     max(CAST(place = 1 AND e = 'K' AND r.initial = 's' AS INTEGER)) OVER (PARTITION BY p.conv_id) AS ahead FROM p LEFT JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.n = r.n WHERE e <> 'D'),
        s AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place + ahead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS t FROM q GROUP BY 1)
        SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN c ON g.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN b ON g.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN s ON g.conv_id IS NOT DISTINCT FROM s.conv_id
    """
