"""Exact n-gram Jaccard join that skips by the relations of sets.

Documents with the same set are one class. Sets are hashed once and lie in shared files, from which later steps
read them. A set's shingles are ordered by rarity, with those that many sets begin with demoted, and its first few
are indexed: sets that are similar enough share one of these.
* Lists of rare shingles are sorted by what of a set is still to come after the shingle, and cut into blocks whose
  heads say how much is to come and how large their sets are. A probe passes over the blocks whose heads rule them
  out, and leaves a list once too little is to come. What passes is verified set by set.
* Sets that share a frequent shingle go by groups. A group's members are compared with one pivot first, which
  settles most; the others are met with the group in blocks of bounded size, where the overlaps of a set with
  all others are derived from those of the set before it, by the lists of the shingles in which the two differ.
Links become components by alternating stars.

Sets and shingles are told apart by 64-bit hashes. Edge cases: null or empty texts and texts of white space have
an empty set, which links with nothing; a text with fewer words than a shingle has one shingle; a null doc_id
comes after all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hash_arrays import PAIRS_DDL, Sums, look_up, write_arrays
from .shared import batch_of, mapped, materialise, mixed, open_fs, split_batches, spread_join, text_bytes, work_dir

_LAST = (1 << 63) - 1
_DOCS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.int64()), ("path", pa.string()), ("at", pa.int64())])
_POSTINGS = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("set", pa.int64()), ("n", pa.int32()), ("left", pa.int32())])
_EDGES = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
RARE, FREQUENT = 0, 1
#: Shingles of a block of sets, all told.
BLOCK = 1 << 18


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out, digest = [], xxhash.xxh3_64_intdigest
    for t in texts:
        words = t.lower().split()
        if not words:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.fromiter(map(digest, words), np.uint64, len(words))
        x = h[: max(1, len(h) - k + 1)]
        for i in range(1, min(k, len(h))):
            x = mixed(x, h[i : i + len(x)])
        out.append(np.unique(x))
    return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class SetFiles:
    """Sets by file and place. Files are mapped where they can be; of those read, the last ones used are kept."""

    def __init__(self, most: int = 8):
        self.files: OrderedDict[str, object] = OrderedDict()
        self.most = most

    def get(self, path: str, at: int, n: int) -> np.ndarray:
        if path not in self.files:
            self.files[path] = mapped(path)
            while isinstance(self.files[path], bytes) and len(self.files) > self.most:
                self.files.popitem(last=False)
        self.files.move_to_end(path)
        return np.frombuffer(self.files[path], np.uint64, n, at)


def stored(batches, most: int = 1 << 20):
    """(set, shingles) of rows (set, path, at, n), some at a time."""
    files, held, size = SetFiles(), [], 0
    for b in batches:
        for i, path, at, n in zip(*(b.column(c).to_pylist() for c in ("set", "path", "at", "n")), strict=True):
            held.append((np.uint64(i & (1 << 64) - 1), files.get(path, at, n)))
            size += n
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def rare_pairs(token: np.ndarray, ids: np.ndarray, n: np.ndarray, left: np.ndarray, percent: int, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets in a list that may be similar enough. The arrays are sorted by token and, falling, left. Each
    entry probes its list from itself on, a block at a time, and looks into those blocks alone whose heads allow it:
    the most that is still to come, which falls from block to block, and the least and the largest set."""
    n, left, total = n.astype(np.int64), left.astype(np.int64), len(token)
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(begin, append=total)
    blocks = -(-size // block)
    first = np.repeat(begin, blocks) + (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * block
    end = np.minimum(first + block, np.repeat(begin + size, blocks))
    most, small, large, of_list = left[first], np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), token[first]
    at, here = np.arange(total), np.repeat(np.arange(len(first)), end - first)
    out_a, out_b = [], []
    while len(at):
        # a probe has at most what is to come after it in common with another: leave once that has too little
        live = 100 * most[here] >= percent * n[at]
        at, here = at[live], here[live]
        look = (100 * large[here] >= percent * n[at]) & (100 * n[at] >= percent * small[here])
        x, low, high = at[look], np.maximum(first[here[look]], at[look] + 1), end[here[look]]
        length = np.maximum(high - low, 0)
        ends = np.cumsum(length)
        y = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - length), length)
        x = np.repeat(x, length)
        least = np.minimum(left[x], left[y])
        ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((100 + percent) * least >= percent * (n[x] + n[y])) & (ids[x] != ids[y])
        out_a.append(ids[x[ok]])
        out_b.append(ids[y[ok]])
        more = here + 1 < len(first)
        more[more] = of_list[here[more] + 1] == of_list[here[more]]
        at, here = at[more], here[more] + 1
    a, b = np.concatenate([*out_a, np.empty(0, np.uint64)]), np.concatenate([*out_b, np.empty(0, np.uint64)])
    low, high = np.minimum(a, b), np.maximum(a, b)
    _, once = np.unique(mixed(low, high), return_index=True)
    return low[once], high[once]


def block_links(probes: list[np.ndarray], others: list[np.ndarray], same: bool, percent: int) -> list[tuple[int, int]]:
    """A forest of links (probe, other) that joins all that links join. The overlaps of a probe with all others
    are kept from one probe to the next, changed by the lists of the shingles that came or went."""
    parent = list(range(len(probes) + len(others)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    base = 0 if same else len(probes)
    sizes = np.array([len(s) for s in others], np.int64)
    tokens = np.concatenate(others)
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    owner = np.repeat(np.arange(len(others), dtype=np.int32), sizes)[order]
    del order

    def counted(s: np.ndarray) -> np.ndarray:
        """How often each other has one of the shingles: their lists are stretches of owner."""
        low, high = np.searchsorted(tokens, s), np.searchsorted(tokens, s, "right")
        length = high - low
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - length), length)
        return np.bincount(owner[at], minlength=len(others))

    links: list[tuple[int, int]] = []
    before, counts = np.empty(0, np.uint64), np.zeros(len(others), np.int64)
    for i in sorted(range(len(probes)), key=lambda i: (len(probes[i]), probes[i][:8].tobytes())):
        s = probes[i]
        came, went = np.setdiff1d(s, before, True), np.setdiff1d(before, s, True)
        counts = counts + counted(came) - counted(went) if len(came) + len(went) < len(s) else counted(s)
        before = s
        for j in np.flatnonzero((100 + percent) * counts >= percent * (len(s) + sizes)).tolist():
            a, b = root(i), root(base + j)
            if a != b:
                parent[a] = b
                links.append((i, j))
    return links


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85, frequent: int = 48) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: sets link when 100 * shared >= percent * joint, and
    component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    folder = work_dir(spark, "jaccard")
    shards = 1 << max(3, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def classes(batches):
        """Each row's set; the task's first row of a set has its place in the task's file."""
        out, path, at, seen = None, f"{folder}/sets-{uuid.uuid4().hex}", 0, set()
        for b in split_batches(batches, 4 << 20):
            sets = shingle_sets(b.column("text").to_pylist(), k)
            names, paths, places = [], [], []
            if len(seen) > 1_000_000:
                seen.clear()
            for x in sets:
                i = set_id(x) if len(x) else 0
                new = len(x) > 0 and i not in seen
                if new:
                    seen.add(i)
                    if out is None:
                        fs, name = open_fs(path)
                        out = fs.open_output_stream(name)
                    out.write(x.tobytes())
                names.append(i)
                paths.append(path if new else None)
                places.append(at if new else None)
                at += 8 * len(x) if new else 0
            yield batch_of(_DOCS, b.column("doc_id"), [len(x) for x in sets], _signed(names), paths, places)
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    rows = materialise(rows.mapInArrow(classes, "doc_id long, n long, set long, path string, at long"), "jaccard-docs")
    # one place for each set, dealt so that a task reads few files
    once = rows.where("path IS NOT NULL").groupBy("set").agg(F.min(F.struct("path", "at", "n")).alias("p")).select("set", "p.path", "p.at", "p.n")
    sets = materialise(once.repartitionByRange("path", "at").sortWithinPartitions("path", "at"), "jaccard-sets")

    def begun(batches):
        sums = Sums(1)
        for some in stored(batches):
            yield from sums.add(np.concatenate([x[: prefix_size(len(x), percent)] for _, x in some]))
        yield from sums.flush()

    demoted = write_arrays(sets.mapInArrow(begun, PAIRS_DDL), folder, {1: frequent}).get(1)

    def index(batches):
        for some in stored(batches):
            counts = look_up(demoted, np.concatenate([x for _, x in some]))
            out, at = [], 0
            for i, x in some:
                c = counts[at : at + len(x)]
                at += len(x)
                p = prefix_size(len(x), percent)
                first = np.argsort(c, kind="stable")[:p]
                out.append((np.where(c[first] > 0, FREQUENT, RARE), x[first], np.full(p, i, np.uint64), np.full(p, len(x)), len(x) - np.arange(p)))
            kind, token, ids, n, left = (np.concatenate(x) for x in zip(*out))
            for a in range(0, len(token), 200_000):
                z = slice(a, a + 200_000)
                yield batch_of(_POSTINGS, kind[z].astype(np.int32), _signed(token[z]), _signed(ids[z]), n[z].astype(np.int32), left[z].astype(np.int32))

    def probe(batches):
        """Rare lists give candidates of kind RARE; lists that turn out long give stars of kind FREQUENT, and
        so do frequent shingles, whose rows come one for each shingle and set."""
        held = [[b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4)] for b in batches]
        if not held:
            return
        token, ids, n, left = (np.concatenate(x) for x in zip(*held))
        token, ids = token.view(np.uint64), ids.view(np.uint64)
        order = np.lexsort((-left, token))
        token, ids, n, left = token[order], ids[order], n[order], left[order]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(start, append=len(token))
        long = np.repeat(length > 4 * frequent, length)
        heads = np.repeat(ids[start], length)
        stars = long & (ids != heads)
        some = np.unique(np.stack([ids[stars], heads[stars]]), axis=1) if stars.any() else np.empty((2, 0), np.uint64)
        found = [(FREQUENT, some[0], some[1])]
        token, ids, n, left = (x[~long] for x in (token, ids, n, left))
        cuts = np.searchsorted(token, token[np.arange(0, len(token), 500_000)]).tolist() + [len(token)]
        for a, z in zip(cuts, cuts[1:]):
            found.append((RARE, *rare_pairs(token[a:z], ids[a:z], n[a:z], left[a:z], percent)))
        for kind, a, b in found:
            for i in range(0, len(a), 200_000):
                x, y = a[i : i + 200_000], b[i : i + 200_000]
                yield batch_of(_EDGES, np.full(len(x), kind, np.int32), _signed(x), _signed(y))

    postings = sets.mapInArrow(index, "kind int, token long, set long, n int, left int")
    # a frequent shingle's sets are dealt over tasks by a salt, and its stars meet in the smallest set of each
    salt = F.when(F.col("kind") == FREQUENT, F.pmod("set", F.lit(32))).otherwise(F.lit(0))
    place = F.when(F.col("kind") == FREQUENT, F.pmod(F.xxhash64("token", salt), F.lit(shards))).otherwise(F.pmod("token", F.lit(shards)))
    placed = postings.repartitionById(shards, place.cast("int"))

    def meet(batches):
        """Splits a task's postings: rare ones are probed, frequent ones become (shingle, least set, set)."""
        rare = []
        for b in batches:
            kind = b.column(0).to_numpy(zero_copy_only=False)
            if (kind == RARE).any():
                rare.append(b.filter(pa.array(kind == RARE)))
            if (kind == FREQUENT).any():
                f = b.filter(pa.array(kind == FREQUENT))
                yield batch_of(_EDGES, np.full(f.num_rows, 2, np.int32), f.column(1), f.column(2))
        yield from probe(rare)

    met = materialise(placed.mapInArrow(meet, "kind int, a long, b long").distinct(), "jaccard-candidates")
    lists = met.where("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("set"))
    heads = lists.groupBy("token").agg(F.min("set").alias("head"))
    stars = met.where(F.col("kind") == FREQUENT).select("a", "b").unionByName(spread_join(lists, heads, "token", "set").where("set <> head").select(F.col("set").alias("a"), F.col("head").alias("b")))
    groups = materialise(connected_components(stars), "jaccard-groups")
    candidates = met.where(F.col("kind") == RARE).select("a", "b")

    places = sets.select("set", F.struct("path", "at", "n").alias("p"))

    def verify(batches):
        files = SetFiles()
        for b in batches:
            a, z = b.column(0), b.column(1)
            pa_, pb = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = []
            for x, y in zip(pa_, pb, strict=True):
                shared = overlap(files.get(x["path"], x["at"], x["n"]), files.get(y["path"], y["at"], y["n"]))
                ok.append((100 + percent) * shared >= percent * (x["n"] + y["n"]))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), z.filter(mask)], names=["a", "b"])

    def at(column: str, name: str) -> DataFrame:
        return places.select(F.col("set").alias(column), F.col("p").alias(name))

    edge = "a long, b long"
    pair_places = candidates.join(at("a", "pa"), "a").join(at("b", "pb"), "b").select("a", "b", "pa", "pb")
    rare_links = pair_places.mapInArrow(verify, edge)

    placed_nodes = materialise(groups.join(at("node", "p"), "node"), "jaccard-nodes")
    pivots = placed_nodes.where("node = component").select("component", F.col("p").alias("pivot"))
    members = materialise(spread_join(placed_nodes, pivots, "component", "node"), "jaccard-members")
    against = members.select(F.col("component").alias("a"), F.col("node").alias("b"), F.col("pivot").alias("pa"), F.col("p").alias("pb"))
    pivot_links = materialise(against.where("a <> b").mapInArrow(verify, edge), "jaccard-pivots")
    settled = pivot_links.select(F.col("a").alias("component"), F.col("b").alias("node"), F.lit(True).alias("settled"))
    told = materialise(members.where("node <> component").join(settled, ["component", "node"], "left").select("component", "node", "p", F.coalesce("settled", F.lit(False)).alias("settled")), "jaccard-told")
    # blocks of bounded size: unsettled ones meet each other and all settled ones
    per = told.groupBy("component", "settled").agg(F.sum("p.n").alias("size"))
    sizes = per.groupBy("component").agg(*(F.coalesce(F.max(F.when(F.col("settled") == s, F.ceil(F.col("size") / BLOCK))), F.lit(0)).cast("int").alias(c) for s, c in ((False, "open"), (True, "done"))))
    dealt = spread_join(told, sizes.where("open > 0"), "component", "node").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("settled"), F.col("done")).otherwise(F.col("open"))).cast("int"))
    numbers = F.when(F.col("settled"), F.transform(F.sequence(F.lit(0), F.col("open") - 1), lambda i: F.struct(i.alias("i"), (F.col("block") + F.col("open")).alias("j"), F.lit(1).alias("side")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("block")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.when(i == F.col("block"), 0).otherwise(1).alias("side"))),
            F.expr("transform(filter(sequence(0, open + done), j -> j > block and j < open + done), j -> struct(block as i, cast(j as int) as j, 0 as side))"),
        )
    )
    tasks = dealt.select("component", "node", "p", F.explode(numbers).alias("t")).select("component", "node", "p", "t.i", "t.j", "t.side")

    def block(table: pa.Table) -> pa.Table:
        files, sides = SetFiles(), ([], [])
        for node, p, side in sorted(zip(*(table.column(c).to_pylist() for c in ("node", "p", "side"))), key=lambda r: r[0]):
            sides[side].append((node, files.get(p["path"], p["at"], p["n"])))
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        x, y = sides[0], sides[0] if same else sides[1]
        found = block_links([s for _, s in x], [s for _, s in y], same, percent) if x and y else []
        return pa.table({"a": pa.array([x[i][0] for i, _ in found], pa.int64()), "b": pa.array([y[j][0] for _, j in found], pa.int64())})

    block_found = tasks.groupBy("component", "i", "j").applyInArrow(block, edge)
    links = rare_links.unionByName(pivot_links).unionByName(block_found)
    joined = connected_components(links)

    own = rows.where("n > 0").groupBy("set").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("least"))
    grouped = own.join(joined.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    grouped = materialise(grouped, "jaccard-classes")
    least = grouped.groupBy("component").agg(F.min("least").alias("low"))
    of_set = materialise(spread_join(grouped, least, "component", "set").select("set", "low"), "jaccard-least")
    out = spread_join(rows.where("n > 0"), of_set, "set", "doc_id").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("low") < _LAST, F.col("low")).alias("component_id"))
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all their columns. A row with a null
    doc_id stays when its component has no other; rows that share the doc_id that stays all stay."""
    stay = near_duplicates(docs, k, percent).where("doc_id <=> component_id").select(F.coalesce("doc_id", F.lit(_LAST)).alias("stay")).distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("stay"), F.struct("*").alias("row"))
    return rows.join(stay, "stay", "left_semi").select("row.*")
