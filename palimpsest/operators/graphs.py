"""Graph operators as iterated joins with a written table after each step where the state grows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import numbered, read_file, written
from ..functions.scalars import first_match


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """(seed, node, depth): nodes within ``depth`` steps of each seed with the least depth, or without one, all
    nodes that a seed reaches. A step expands only what the one before found, and keeps what wasn't known; each
    step is written, so that later ones don't repeat it."""
    e = written(edges.select("src", "dst").distinct())
    known = frontier = written(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct())
    for d in count(1) if depth is None else range(1, depth + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def bfs_subgraph(edges: DataFrame, start: int, depth: int, most_nodes: int) -> DataFrame:
    """(node, depth) around a node, both ways along edges; at most most_nodes, the nearest and then the least."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = edges.sparkSession.createDataFrame([(start,)], f"node {dict(edges.dtypes)['src']}")
    return reach(both, seeds, depth).select("node", "depth").orderBy("depth", "node").limit(most_nodes)


def impact_distance(edges: DataFrame, depth: int) -> DataFrame:
    """(node, dependent, distance): what depends on each node, directly or not, within ``depth`` steps."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return reach(back, nodes, depth).where("depth > 0 AND seed <> node").select(F.col("seed").alias("node"), F.col("node").alias("dependent"), F.col("depth").alias("distance"))


def impact(edges: DataFrame, seeds: DataFrame, depth: int, co_changes: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(seed, node, distance, direct, caller, confidence, path, co_changes): what depends on the seeds (node), directly
    or not, within ``depth`` steps along edges (src, dst, kind, confidence) of at least ``least`` confidence.

    A node keeps one way to a seed: of the shortest ones that with the widest bottleneck, which is its confidence,
    and of these the least by its nodes, each way going on from the one that the node before kept. A caller has a
    CALLS edge to the seed. ``co_changes`` (file_a, file_b, co_changes) are looked up both ways."""
    usable = edges.where(F.col("confidence") >= least)
    names = written(numbered(usable.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "place", "node")[0].select("node", "place"))
    size, named = names.count(), names.inputFiles()
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _names(named)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(pc.index_in(b.column(c), value_set=known) for c in ("dst", "src")), b.column(2), b.column(3)], names=["at", "next", "c", "calls"])

    rows = usable.select("src", "dst", F.col("confidence").cast("double").alias("c"), F.coalesce(F.col("kind") == "CALLS", F.lit(False)).alias("calls")).mapInArrow(placed, "at int, next int, c double, calls boolean")
    out = written(rows.repartition(parts, "at").groupBy("at", "next").agg(F.max("c").alias("c"), F.bool_or("calls").alias("calls")).sortWithinPartitions("at", "next"))
    into = written(out.select("at", "next", "c", "calls").repartition(parts, "next").sortWithinPartitions("next", "at")) if depth > 1 else out
    pushed, pulled = out.inputFiles(), into.inputFiles()
    start = seeds.select("node").distinct()
    if co_changes is None:
        asked = start.select("node", F.array().cast(f"array<{dict(seeds.dtypes)['node']}>").alias("others"), F.array().cast("array<long>").alias("n"))
    else:
        both = co_changes.select(F.col("file_a").alias("node"), F.col("file_b").alias("other"), "co_changes").unionByName(co_changes.select(F.col("file_b").alias("node"), F.col("file_a").alias("other"), "co_changes"))
        met = both.join(start, "node", "left_semi").groupBy("node").agg(F.collect_list(F.struct("other", F.col("co_changes").cast("long").alias("n"))).alias("x"))
        asked = start.join(met, "node", "left").select("node", F.col("x.other").alias("others"), F.col("x.n").alias("n"))
    asked, at_once = written(asked), max(1, HELD // max(1, size))
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // at_once))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _names(named)
        for b in batches:
            b = b.append_column("seed", pc.index_in(b.column(0), value_set=known)).filter(pc.is_in(b.column(0), value_set=known))
            for k in range(0, b.num_rows, at_once):
                yield from _impact(b.slice(k, at_once), known, pushed, pulled, depth)

    kind = dict(usable.dtypes)["src"]
    return asked.repartition(tasks).mapInArrow(walk, f"seed {kind}, node {kind}, distance int, direct boolean, caller boolean, confidence double, path string, co_changes long")


#: Nodes by seeds that a task holds.
HELD = 6_000_000


def _names(files: list[str]) -> pa.Array:
    """The nodes in the order of their places."""
    return pa.concat_tables(map(read_file, files)).sort_by("place").column("node").combine_chunks()


class _Ways:
    """What a seed's ways reach. A node that isn't settled has the widest way so far, and of equally wide ones the
    place of the node before it in the order of their own ways."""

    def __init__(self, seed: int, size: int) -> None:
        self.distance, self.c, self.before = np.full(size, -1, np.int8), np.full(size, -np.inf), np.full(size, -1, np.int32)
        self.rank, self.least, self.caller = np.zeros(size, np.int32), np.full(size, NEVER, np.int32), np.zeros(size, bool)
        self.order = np.array([seed], np.int32)  # the last step's nodes by their ways
        self.distance[seed], self.c[seed] = 0, 1.0

    def offer(self, at: np.ndarray, nodes: np.ndarray, c: np.ndarray) -> None:
        free = self.distance[nodes] < 0
        at, nodes = at[free], nodes[free]
        c = np.minimum(c[free], self.c[at])
        last = self.c[nodes]
        np.maximum.at(self.c, nodes, c)
        most = self.c[nodes]
        self.least[nodes[most > last]] = NEVER
        best = c == most
        np.minimum.at(self.least, nodes[best], self.rank[at[best]])

    def settle(self, d: int) -> None:
        new = np.flatnonzero((self.distance < 0) & (self.least < NEVER)).astype(np.int32)
        self.distance[new] = d
        self.before[new] = self.order[self.least[new]]
        self.order = new[np.argsort(self.least[new], kind="stable")]
        self.rank[self.order] = np.arange(len(new), dtype=np.int32)


NEVER = np.iinfo(np.int32).max


def _lines_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all lines of stretches of lines."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _stretches(file: str, by: str) -> tuple[np.ndarray, ...]:
    """(nodes, starts, sizes, at, next, c, calls) of a file of edges, in order of ``by``."""
    t = read_file(file)
    x = [t.column(c).to_numpy() for c in ("at", "next", "c", "calls")]
    nodes, starts, sizes = np.unique(x[by == "next"], return_index=True, return_counts=True)
    return nodes, starts, sizes, *x


def _impact(rows: pa.RecordBatch, names: pa.Array, pushed: list[str], pulled: list[str], depth: int) -> Iterator[pa.RecordBatch]:
    """What depends on some seeds. A step goes out from the nodes of the step before or, where these have more edges than
    those into the nodes that are left, back from the latter."""
    seeds, size = rows.column("seed").to_pylist(), len(names)
    ways, goes, comes = [_Ways(s, size) for s in seeds], np.zeros(size, np.int64), np.zeros(size, np.int64)
    for d in range(1, depth + 1):
        back = [d > 1 and goes[w.order].sum() > comes[w.distance < 0].sum() for w in ways]
        for files, by, turn in ((pushed, "at", False), (pulled, "next", True)):
            on = [w for w, b in zip(ways, back, strict=True) if b == turn and len(w.order)]
            for f in files if on else ():
                nodes, starts, sizes, at, nxt, c, calls = _stretches(f, by)
                if d == 1:
                    goes[nodes] += sizes
                    np.add.at(comes, nxt, 1)
                for w in on:
                    hit = w.distance[nodes] == (-1 if turn else d - 1)
                    if not hit.any():
                        continue
                    k = _lines_of(starts[hit], sizes[hit])
                    if turn:
                        k = k[w.distance[at[k]] == d - 1]
                    w.offer(at[k], nxt[k], c[k])
                    if d == 1:
                        w.caller[nxt[k[calls[k]]]] = True
        for w in ways:
            w.settle(d)
    text = names.cast(pa.string())
    for i, (seed, w) in enumerate(zip(seeds, ways, strict=True)):
        co = np.zeros(size, np.int64)
        if rows.column("others")[i].is_valid:
            other, n = pc.index_in(rows.column("others")[i].values, value_set=names), rows.column("n")[i].values
            co[other.drop_null().to_numpy()] = n.filter(other.is_valid()).to_numpy()
        for d in range(1, depth + 1):
            nodes = np.flatnonzero(w.distance == d)
            steps = [nodes]
            for _ in range(d):
                steps.insert(0, w.before[steps[0]])
            for k in range(0, len(nodes), 100_000):
                at = nodes[k : k + 100_000]
                path = pc.binary_join_element_wise(*(text.take(pa.array(x[k : k + 100_000])) for x in steps), ">")
                columns = [names.take(pa.array(np.full(len(at), seed))), names.take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), d == 1)), pa.array(w.caller[at] & (d == 1)), pa.array(w.c[at]), path, pa.array(co[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["seed", "node", "distance", "direct", "caller", "confidence", "path", "co_changes"])


def shortest_path(edges: DataFrame, start: int, depth: int) -> DataFrame:
    """(node, distance, path) of a shortest path from a node; of several the least by its nodes in order. Each
    step keeps one path for each node, so that paths don't multiply."""
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    known = spark.createDataFrame([(start,)], f"node {dict(edges.dtypes)['src']}").select("node", F.lit(0).alias("distance"), F.array(F.col("node").cast("long")).alias("p"))
    e, frontier = written(e), known
    for d in range(1, depth + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).groupBy("dst").agg(F.min(F.concat("p", F.array(F.col("dst").cast("long")))).alias("p")).select(F.col("dst").alias("node"), F.lit(d).alias("distance"), "p")
        frontier = written(step.join(known.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.select("node", "distance", F.array_join(F.transform("p", lambda x: x.cast("string")), ">").alias("path"))


def spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the largest of the labels (node, label) of all nodes that reach a node along edges, its own
    included, by rounds of joins in which only nodes whose label grew pass it on."""
    known = changed = written(labels.select("node", "label"))
    while not changed.isEmpty():
        passed = changed.join(edges, changed["node"] == edges["src"]).groupBy("dst").agg(F.max("label").alias("passed"))
        joined = known.join(passed, known["node"] == passed["dst"], "left").select("node", "label", "passed")
        joined = written(joined.select("node", F.coalesce(F.greatest("label", "passed"), "label").alias("label"), (F.col("passed") > F.col("label")).alias("grew")))
        known, changed = joined.select("node", "label"), joined.where("grew").select("node", "label")
    return known


#: Edges of a graph that one task may hold.
MOST_LOCAL = 200_000


def _local_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of a graph of bounded size, by depth-first search in one task."""
    kind = dict(edges.dtypes)["src"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after: dict = {}
        kind_of = None
        for b in batches:
            kind_of = b.schema.field(0).type
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                after.setdefault(x, []).append(y)
                after.setdefault(y, [])
        out = [(x, min(c)) for c in _components(after) if len(c) > 1 or c[0] in after[c[0]] for x in c]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind_of) for c in zip(*out)], names=["node", "component"])

    return edges.select("src", "dst").repartition(1).mapInArrow(found, f"node {kind}, component {kind}")


def _components(after: dict) -> Iterator[list]:
    """Strongly connected components of a graph in memory, with a stack of its own in place of recursion."""
    number: dict = {}
    low: dict = {}
    held: list = []
    on: set = set()
    for root in after:
        if root in number:
            continue
        work = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        held.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in number:
                    number[n] = low[n] = len(number)
                    held.append(n)
                    on.add(n)
                    work.append((n, iter(after[n])))
                    break
                if n in on:
                    low[node] = min(low[node], number[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    part = [held.pop()]
                    while part[-1] != node:
                        part.append(held.pop())
                    on.difference_update(part)
                    yield part


def scc_cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles: those that reach each other, by the least node. Loops of one node
    count. By colouring: each node takes the largest node that reaches it; those of a colour that reach the node of
    that colour, backwards within the colour, are its component and leave the graph, and the rest go on. Nodes
    without a way in or out leave first. No pairs of nodes are made. A graph, or a rest, of at most MOST_LOCAL edges
    is finished in one task."""
    rest = written(edges.select("src", "dst").distinct())
    if rest.count() <= MOST_LOCAL:
        return _local_components(rest)
    loops = rest.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    rest, found = written(rest.where("src <> dst")), None
    while not rest.isEmpty():
        if rest.count() <= MOST_LOCAL:
            some = written(_local_components(rest))
            found = some if found is None else found.unionByName(some)
            break
        trimmed = written(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if trimmed.count() < rest.count():
            rest = trimmed
            continue
        nodes = rest.select(F.col("src").alias("node")).distinct()
        colours = spread(rest, nodes.withColumn("label", F.col("node")))
        within = written(
            rest.join(colours.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "a")
        )
        # backwards from the roots within their colours: 1 where a root is reached
        reached = spread(within.select("src", "dst"), colours.select("node", (F.col("node") == F.col("label")).cast("int").alias("label"))).where("label = 1").select("node")
        members = colours.join(reached, "node", "left_semi").select("node", F.col("label").alias("root"))
        of_root = members.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        some = written(members.join(of_root, "root").select("node", "component"))
        found = some if found is None else found.unionByName(some)
        gone = written(reached)
        rest = written(rest.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    alone = loops if found is None else loops.join(found, "node", "left_anti")
    return alone if found is None else found.unionByName(alone)


def cycle_fingerprints(components: DataFrame) -> DataFrame:
    """(component, size, fingerprint): a digest of the sorted members, for components of two or more."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), "|")
    return components.groupBy("component").agg(F.count("*").alias("size"), F.sha2(members, 256).alias("fingerprint")).where("size > 1")


def graph_view(edges: DataFrame, metrics: DataFrame, most_nodes: int) -> DataFrame:
    """Edges among the first most_nodes nodes by degree."""
    top = metrics.orderBy((F.col("fan_in") + F.col("fan_out")).desc(), "node").limit(most_nodes).select("node")
    return edges.join(F.broadcast(top.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(top.withColumnRenamed("node", "dst")), "dst", "left_semi").select("src", "dst", "weight")


#: Layers by words of a path, in the order in which they are tried.
LAYERS = [
    ("presentation", ["ui", "views", "pages", "components", "frontend"]), ("api", ["api", "routes", "endpoints"]), ("controller", ["controller", "controllers"]),
    ("service", ["service", "services"]), ("domain", ["domain"]), ("repository", ["repository", "repositories", "dao"]),
    ("database", ["database", "db", "model", "models", "migrations"]), ("infrastructure", ["infrastructure", "infra"]), ("utility", ["util", "utils", "helpers"]),
    ("test", ["test", "tests", "spec", "specs"]),
]


def layer_of(path: Column) -> Column:
    """The layer that a path's words name, or unknown."""
    words = F.split(F.lower(path), "[^a-z0-9]+")
    return first_match([(F.arrays_overlap(words, F.array(*map(F.lit, v))), k) for k, v in LAYERS], "unknown")


def rule_violations(edges: DataFrame, rules: DataFrame, layers: DataFrame, least: float = 0.8) -> DataFrame:
    """(rule, src, dst, confidence): edges (src, dst, confidence) that break a rule (rule, kind, source, target)
    by the layers (node, layer) of their ends. forbidden: source meets target; allowed: source meets another
    target. Rules are few and written by hand; they are sent to all tasks."""
    at = layers.select("node", "layer")
    known = edges.where(F.col("confidence") >= least).join(at.select(F.col("node").alias("src"), F.col("layer").alias("src_layer")), "src").join(at.select(F.col("node").alias("dst"), F.col("layer").alias("dst_layer")), "dst")
    hit = known.join(F.broadcast(rules), F.lower("source") == F.lower("src_layer"))
    same = F.lower("target") == F.lower("dst_layer")
    return hit.where(((F.col("kind") == "forbidden") & same) | ((F.col("kind") == "allowed") & ~same)).select("rule", "src", "dst", "confidence")


def select_snapshots(commits: DataFrame, n: int, most: int) -> DataFrame:
    """Every nth commit, the first, the last and the tagged ones; of these the last ``most`` and the first."""
    rows, total = numbered(commits, "k", "moment", "commit_id")
    chosen = rows.where((F.pmod(F.col("k") - 1, F.lit(n)) == 0) | (F.col("k") == total) | F.col("tagged"))
    last = chosen.orderBy(F.desc("k")).limit(most - 1)
    return last.unionByName(chosen.where("k = 1")).distinct().select("commit_id", "moment")


def directory_rollup(files: DataFrame) -> DataFrame:
    """(directory, files, lines): each file counts in all directories above it; "" is the root."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select("lines", F.explode(above).alias("directory")).groupBy("directory").agg(F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"))


def neighbourhood(edges: DataFrame, node: int, most: int = 100) -> DataFrame:
    """(direction, other, weight) of a node's heaviest edges, at most ``most`` each way."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "weight").orderBy(F.desc("weight"), "other").limit(most)
    into = edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "weight").orderBy(F.desc("weight"), "other").limit(most)
    return out.unionByName(into)


def touching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with an end among ``targets`` (node), each once."""
    t = targets.select("node").distinct()
    return edges.join(t, edges["src"] == t["node"], "left_semi").unionByName(edges.join(t, edges["dst"] == t["node"], "left_semi")).distinct()


def expand_relations(seeds: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(kind, id): seeds and what each table of links (kind_a, a, kind_b, b) ties to what is known so far, one
    pass over the tables in their order."""
    known = seeds.select("kind", "id").distinct()
    for link in links:
        step = link.join(known, (F.col("kind_a") == F.col("kind")) & (F.col("a") == F.col("id"))).select(F.col("kind_b").alias("kind"), F.col("b").alias("id"))
        known = known.unionByName(step).distinct()
    return known


def ancestors(parents: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(commit_id, ancestor, distance) along (child, parent), within ``depth`` generations."""
    found = reach(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")), seeds.select(F.col("commit_id").alias("node")), depth)
    return found.where("depth > 0").select(F.col("seed").alias("commit_id"), F.col("node").alias("ancestor"), F.col("depth").alias("distance"))
