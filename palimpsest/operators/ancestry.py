"""Reachability in a commit graph without the table of all ancestors.

Commits have places in an order in which parents come before their children, by their names where these are in such
an order, else by generations. The graph lies in blocks of places, one file each. Tasks hold some questions and one
block at a time, from the top: what is reached within it, and what waits for the blocks below. Blocks that nobody
waits for aren't read, and questions that are answered wait no more.

A run is a way from a commit along commits with a single parent down to its head, which has none or several. Tables
of the 1st, 2nd, 4th .. commit below lead to any place of a run in a logarithm of joins. Whether one commit comes
before another is a question of heads and steps within a run; only the graph of heads of merges is searched.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import numbered, read_file, written

#: Parents of merges whose generations one process may work out; beyond, they are worked out by rounds of joins.
MOST_LOCAL = 200_000
#: Places of a block.
BLOCK = 100_000
#: Questions that a task searches for at once, and places that may wait before the questions are halved.
ASKED, WAITING = 4_096, 2_000_000


class CommitGraph:
    """The commits of (child, parent); parents that are null or the child itself don't count. A cycle raises."""

    def __init__(self, parents: DataFrame) -> None:
        links = written(parents.where("parent IS NOT NULL AND child <> parent").select("child", "parent").distinct())
        self.links, self.nodes = links, written(parents.select(F.col("child").alias("commit")).unionByName(links.select(F.col("parent").alias("commit"))).distinct())
        #: Whether parents come before their children by their names, as numbers given in order do.
        self.in_order = links.where("child < parent").isEmpty()
        if not self.in_order:
            self.labels  # noqa: B018  a cycle raises here

    @cached_property
    def runs(self) -> DataFrame:
        """(commit, head, steps)."""
        links, nodes = self.links, self.nodes
        single = written(links.groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("up")).where("n = 1").select(F.col("child").alias("commit"), "up"))
        #: The commit 2^k steps below, where the run is so long.
        self.lifts = [single]
        run = nodes.join(single, "commit", "left").select("commit", F.coalesce("up", "commit").alias("head"), F.col("up").isNotNull().cast("long").alias("steps"))
        run = written(run)
        while True:
            up = self.lifts[-1]
            further = written(up.join(up.select(F.col("commit").alias("up"), F.col("up").alias("upper")), "up").select("commit", F.col("upper").alias("up")))
            beyond = run.select(F.col("commit").alias("head"), F.col("head").alias("h"), F.col("steps").alias("s")).where("s > 0")
            run = written(run.join(beyond, "head", "left").select("commit", F.coalesce("h", "head").alias("head"), (F.col("steps") + F.coalesce("s", F.lit(0))).alias("steps")))
            if further.isEmpty():
                break
            if len(self.lifts) > 40:
                raise ValueError("the commits have a cycle")
            self.lifts.append(further)
        #: Parents of the commits that have several.
        self.merges = written(links.join(single.select(F.col("commit").alias("child")), "child", "left_anti").select(F.col("child").alias("head"), "parent"))
        return run

    @cached_property
    def labels(self) -> DataFrame:
        """(commit, head, steps, generation): 1 without parents, else one more than the largest of the parents'. A head
        is settled once those of all its parents' runs are."""
        run = self.runs
        waits = written(self.merges.join(run.select(F.col("commit").alias("parent"), F.col("head").alias("below"), "steps"), "parent").select("head", "below", "steps", "parent"))
        if waits.count() <= MOST_LOCAL:
            level = _levels([(r["head"], r["parent"], r["below"], r["steps"]) for r in waits.collect()])  # bounded by MOST_LOCAL
            kind = dict(run.dtypes)["head"]
            known = run.sparkSession.createDataFrame(list(level.items()), f"head {kind}, g long")
            return written(run.join(known, "head", "left").select("commit", "head", "steps", (F.coalesce("g", F.lit(1)) + F.col("steps")).alias("generation")))
        waits = waits.drop("parent")
        known = written(run.where("steps = 0").select("head").join(waits.select("head").distinct(), "head", "left_anti").select("head", F.lit(1).cast("long").alias("g")))
        while not waits.isEmpty():
            met = waits.join(known.select(F.col("head").alias("below"), "g"), "below", "left")
            new = written(met.groupBy("head").agg(F.count_if(F.col("g").isNull()).alias("open"), F.max(F.col("g") + F.col("steps") + 1).alias("g")).where("open = 0").select("head", "g"))
            if new.isEmpty():
                raise ValueError("the commits have a cycle")
            known = written(known.unionByName(new))
            waits = written(waits.join(new.select("head"), "head", "left_anti"))
        return written(run.join(known, "head").select("commit", "head", "steps", (F.col("g") + F.col("steps")).alias("generation")))

    def below(self, rows: DataFrame) -> DataFrame:
        """The rows (commit, by, ..) with ``commit`` moved so many steps down its run."""
        most = rows.agg(F.max("by")).first()[0] or 0
        for k in range(most.bit_length()):
            has = F.col("by").bitwiseAND(1 << k) != 0
            moved = rows.where(has).join(self.lifts[k], "commit").drop("commit").withColumnRenamed("up", "commit")
            rows = written(rows.where(~has).unionByName(moved))
        return rows

    @cached_property
    def places(self) -> DataFrame:
        """(commit, place): numbers from 1 in an order in which parents come before their children."""
        if self.in_order:
            return written(numbered(self.nodes, "place", "commit")[0])
        return written(numbered(self.labels.select("commit", "generation"), "place", "generation", "commit")[0].drop("generation"))

    def _placed(self, rows: DataFrame, **names: str) -> DataFrame:
        """The rows with the places of the commits in their columns; those that the graph doesn't have are left out."""
        for place, commit in names.items():
            rows = rows.join(self.places.select(F.col("commit").alias(commit), F.col("place").alias(place)), commit)
        return rows

    def is_ancestor(self, pairs: DataFrame) -> DataFrame:
        """(id, ancestor, commit, holds) of pairs (id, ancestor, commit), unique in id; a commit is its own ancestor. A
        commit that the graph doesn't have has none and is none."""
        runs = self.runs
        heads = self._placed(self.merges.select("head").distinct(), place="head")
        ways = self.merges.join(runs.select(F.col("commit").alias("parent"), F.col("head").alias("under"), "steps"), "parent")
        ways = self._placed(ways, below="under").groupBy("head").agg(F.collect_list(F.struct("below", "parent", "steps")).alias("ways"))
        blocks, tasks = _blocks(heads.join(ways, "head").select("place", "ways.below", "ways.parent", "ways.steps")), _tasks(runs)
        asked = pairs.select("id", "ancestor", "commit").join(runs.select(F.col("commit").alias("ancestor"), F.col("head").alias("a_head"), F.col("steps").alias("a_steps")), "ancestor")
        asked = written(asked.join(runs, "commit"))
        kind = {c: dict(asked.dtypes)[c] for c in ("id", "commit")}
        on_run = asked.where("head = a_head AND steps >= a_steps").select("id", "ancestor", "commit", (F.col("steps") - F.col("a_steps")).alias("by"))
        far = self._placed(asked.where("head > a_head" if self.in_order else "head <> a_head"), start="head", least="a_head").where("start > least")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = _Graph(blocks)
            for b in batches:
                schema = pa.schema([b.schema.field(0), b.schema.field(1).with_name("ancestor"), b.schema.field(1).with_name("commit"), ("by", pa.int64())])
                for k in range(0, b.num_rows, ASKED):
                    out = list(_entries(graph, list(zip(*(c.to_pylist() for c in b.slice(k, ASKED).columns), strict=True))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema, strict=True)], schema=schema)

        entered = far.select("id", "ancestor", "start", "least", "a_steps").repartitionByRange(tasks, "start").mapInArrow(search, f"id {kind['id']}, ancestor {kind['commit']}, commit {kind['commit']}, by long")
        hits = self.below(written(on_run.unionByName(entered))).where("commit = ancestor").select("id").distinct()
        return pairs.join(hits.withColumn("hit", F.lit(True)), "id", "left").select("id", "ancestor", "commit", F.coalesce("hit", F.lit(False)).alias("holds"))

    def commit_range(self, pairs: DataFrame) -> DataFrame:
        """(id, commit) of pairs (id, good, bad), unique in id: what bad reaches, itself included, and good doesn't. A
        null or unknown good takes nothing away."""
        up = self._placed(self.links, above="parent").groupBy(F.col("child").alias("commit")).agg(F.collect_list("above").alias("up"))
        blocks, tasks = _blocks(self.places.join(up, "commit", "left").select("place", "commit", F.coalesce("up", F.array().cast("array<long>")).alias("up"))), _tasks(self.places)
        asked = self._placed(pairs.select("id", "good", "bad"), last="bad")
        asked = asked.join(self.places.select(F.col("commit").alias("good"), F.col("place").alias("first")), "good", "left").select("id", "last", "first")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = _Graph(blocks)
            for b in batches:
                for k in range(0, b.num_rows, ASKED):
                    some = b.slice(k, ASKED)
                    held: list[tuple[int, pa.Array]] = []
                    for i, commits in _range(graph, some.column(1).to_pylist(), some.column(2).to_pylist()):
                        held.append((i, commits))
                        if len(commits) > 50_000 or len(held) >= 500:
                            yield _range_rows(some, held)
                            held = []
                    if held:
                        yield _range_rows(some, held)

        kinds = dict(pairs.dtypes)["id"], dict(self.nodes.dtypes)["commit"]
        return asked.repartitionByRange(tasks, "last").mapInArrow(search, f"id {kinds[0]}, commit {kinds[1]}")


def _tasks(graph: DataFrame) -> int:
    """Questions are few beside what they reach, so they are dealt over more tasks than their size would make."""
    return 4 * int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _blocks(rows: DataFrame) -> list[tuple[int, str]]:
    """(first place, file) of a graph's rows in blocks of about BLOCK by their place, one file each, in order."""
    rows = written(rows)
    cut = written(rows.repartitionByRange(max(1, rows.count() // BLOCK), "place").sortWithinPartitions("place"))
    return sorted((r["lo"], r["f"]) for r in cut.groupBy(F.input_file_name().alias("f")).agg(F.min("place").alias("lo")).collect())  # a row for each block


class _Graph:
    """The blocks of a graph, of which one is held."""

    def __init__(self, blocks: list[tuple[int, str]]) -> None:
        self.lows, self.files = [lo for lo, _ in blocks], [f for _, f in blocks]
        self.held: tuple[int, pa.Table] | None = None

    def of(self, place: int) -> int:
        return bisect.bisect_right(self.lows, place) - 1

    def block(self, k: int, make):
        if self.held is None or self.held[0] != k:
            self.held = None
            self.held = k, make(read_file(self.files[k]))
        return self.held[1]


def _lists(column: pa.ChunkedArray, *fields: pa.ChunkedArray) -> Iterator[list[tuple]]:
    """The elements of list columns with equal lengths, a list of tuples for each row."""
    ends = np.cumsum(pc.list_value_length(column).to_numpy()).tolist()
    flat = list(zip(*(pc.list_flatten(c).to_pylist() for c in (column, *fields)), strict=True))
    begin = 0
    for end in ends:
        yield flat[begin:end]
        begin = end


def _entries(graph: _Graph, asks: list[tuple]) -> Iterator[tuple]:
    """(id, ancestor, commit, by) of asks (id, ancestor, start, least, steps): places on the run whose head is at
    ``least``, where it is entered from the head at ``start`` on at least so many steps above its head, and the steps
    down to the ancestor's height."""

    def table(t: pa.Table) -> dict[int, list[tuple]]:
        return dict(zip(t.column("place").to_pylist(), _lists(t.column("below"), t.column("parent"), t.column("steps")), strict=True))

    waiting: dict[int, dict[int, set[int]]] = {}
    if not graph.lows:
        return
    for i, a in enumerate(asks):
        if (k := graph.of(a[2])) >= 0:
            waiting.setdefault(k, {})[i] = {a[2]}
    while waiting:
        k = max(waiting)
        ways, lo = graph.block(k, table), graph.lows[k]
        for i, left in waiting.pop(k).items():
            name, ancestor, _, least, steps = asks[i]
            seen, left = set(left), list(left)
            while left:
                for below, parent, at in ways.get(left.pop(), ()):
                    if below == least:
                        if at >= steps:
                            yield name, ancestor, parent, at - steps
                    elif below > least:
                        if below >= lo:
                            if below not in seen:
                                seen.add(below)
                                left.append(below)
                        elif (n := graph.of(below)) >= 0:
                            waiting.setdefault(n, {}).setdefault(i, set()).add(below)


def _reached(starts: Iterable[int], lo: int, up: list[list[int]], without: set[int]) -> tuple[set[int], set[int]]:
    """What is reached in a block that begins at ``lo`` but for ``without``, and where it goes on below."""
    seen = set(starts) - without
    left, below = list(seen), set()
    while left:
        for p in up[left.pop() - lo]:
            if p < lo:
                below.add(p)
            elif p not in seen and p not in without:
                seen.add(p)
                left.append(p)
    return seen, below


def _range(graph: _Graph, last: list[int], first: list[int | None]) -> Iterator[tuple[int, pa.Array]]:
    """(question, commits) a block at a time from the top: what the places in ``last`` reach and those in ``first``
    don't. Where the first one's ways have met all of the last one's, a question is done."""

    def table(t: pa.Table) -> tuple[list[list[int]], pa.Array]:
        ends = [0, *np.cumsum(pc.list_value_length(t.column("up")).to_numpy()).tolist()]
        flat = pc.list_flatten(t.column("up")).to_pylist()
        return [flat[a:b] for a, b in itertools.pairwise(ends)], t.column("commit").combine_chunks()

    def put(waiting: dict[int, dict[int, set[int]]], i: int, places: Iterable[int]) -> int:
        new = 0
        for p in places:
            rows = waiting.setdefault(graph.of(p), {})
            if i not in rows:
                rows[i] = set()
                new += 1
            rows[i].add(p)
        return new

    bad: dict[int, dict[int, set[int]]] = {}
    good: dict[int, dict[int, set[int]]] = {}
    for i, (b, g) in enumerate(zip(last, first, strict=True)):
        put(bad, i, [b])
        if g is not None:
            put(good, i, [g])
    jobs = [(bad, good, dict.fromkeys(range(len(last)), 1))]
    while jobs:
        bad, good, open_ = jobs.pop()  # open_: in how many blocks a question's last one waits
        while bad:
            k = max(max(bad), max(good, default=0))
            now, taken = bad.pop(k, {}), good.pop(k, {})
            taken = {i: x for i, x in taken.items() if open_[i]}
            if not now and not taken:
                continue
            (up, commits), lo = graph.block(k, table), graph.lows[k]
            for i in now.keys() | taken.keys():
                without, more = _reached(taken.get(i, ()), lo, up, set())
                if i in now:
                    found, below = _reached(now[i], lo, up, without)
                    open_[i] += put(bad, i, below) - 1
                    if found:
                        yield i, commits.take(pa.array(np.fromiter(found, np.int64, len(found)) - lo))
                if open_[i]:
                    put(good, i, more)
            if len(open_) > 1 and sum(len(x) for rows in bad.values() for x in rows.values()) > WAITING:
                half = set(list(open_)[: len(open_) // 2])
                for side in (half, open_.keys() - half):
                    some = [{k: x for k, rows in w.items() if (x := {i: p for i, p in rows.items() if i in side})} for w in (bad, good)]
                    jobs.append((*some, {i: open_[i] for i in side}))
                break


def _range_rows(asked: pa.RecordBatch, held: list[tuple[int, pa.Array]]) -> pa.RecordBatch:
    at = np.repeat([i for i, _ in held], [len(c) for _, c in held])
    return pa.RecordBatch.from_arrays([asked.column(0).take(pa.array(at)), pa.concat_arrays([c for _, c in held])], names=["id", "commit"])


def _levels(links: list[tuple]) -> dict:
    """The generation of each head, of (head, parent, head of the parent, steps)."""
    below: dict = {}
    for head, parent, under, steps in links:
        below.setdefault(head, []).append((parent, under, steps))
    level: dict = {}
    for start in below:
        left = [start]
        on_way = {start}
        while left:
            head = left[-1]
            open_ = [h for _, h, _ in below.get(head, ()) if h not in level]
            if open_:
                if open_[0] in on_way:
                    raise ValueError("the commits have a cycle")
                on_way.add(open_[0])
                left.append(open_[0])
                continue
            level[head] = max((level[h] + s + 1 for _, h, s in below.get(head, ())), default=1)
            on_way.discard(left.pop())
    return level
