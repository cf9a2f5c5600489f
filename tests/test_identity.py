"""Lineages, copies, names, ancestry, impact and stored tables against plain Python."""

import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ancestry as A
from palimpsest.operators import build as B
from palimpsest.operators import code as C
from palimpsest.operators import copies as K
from palimpsest.operators import graphs as G
from palimpsest.operators import lineages as L
from palimpsest.operators import names as N
from palimpsest.operators import rules as R
from palimpsest.operators import stored as S
from palimpsest.operators import temporal as T
from palimpsest.operators import validity as V
from palimpsest.operators.ancestry import CommitGraph


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def fold(changes):
    """Lineages by going through the changes in order."""
    live, out = {}, []
    for repo, pos, old, new, kind in sorted(changes, key=lambda c: (c[0], c[1])):
        old, new = old or None, new or None
        if kind in ("renamed", "modified", "deleted") and old is not None and (repo, old) in live:
            line = live[repo, old]
        else:
            line = f"{new or old or ''}@{pos}"
        if kind in ("renamed", "deleted"):
            live.pop((repo, old), None)
        if kind != "deleted" and new:
            live[repo, new] = line
        out.append((repo, pos, new or old, kind, line))
    return out


CHANGES = "repo string, pos long, old_path string, new_path string, kind string"


def test_file_lineage_is_that_of_the_fold(spark):
    r, changes = random.Random(1), []
    for repo in "abc":
        for pos in range(200):
            kind = r.choice(["added", "modified", "modified", "modified", "renamed", "renamed", "copied", "deleted"])
            old, new = f"p{r.randint(0, 7)}", f"p{r.randint(0, 7)}"
            new = old if kind == "modified" and r.random() < 0.9 else new
            changes.append((repo, pos, None if kind == "added" else old, None if kind == "deleted" else new, kind))
    changes += [("d", i, f"x{i}", f"x{i + 1}", "renamed") for i in range(1, 70)] + [("d", 0, None, "x1", "added"), ("e", 1, None, None, "modified"), ("e", 2, "", "", "added")]
    got = rows(L.file_lineage(spark.createDataFrame(changes, CHANGES)), "repo", "pos")
    assert got == fold(changes)
    assert L.file_lineage(spark.createDataFrame([], CHANGES)).count() == 0


def test_each_deleted_symbol_comes_back_once(spark):
    r = random.Random(2)
    gone = [(i, "p", r.choice("fg"), r.choice("hk"), r.randint(0, 40)) for i in range(100)]
    come = [(i, "p", r.choice("fg"), r.choice("hk"), r.randint(0, 40)) for i in range(500, 600)]
    want, left = [], list(gone)
    for new in sorted(come, key=lambda c: (c[4], c[0])):
        fit = [g for g in left if g[2:4] == new[2:4] and g[4] <= new[4]]
        if fit:
            best = max(fit, key=lambda g: (g[4], -g[0]))
            left.remove(best)
            want.append((new[0], best[0], "moved" if best[4] == new[4] else "reintroduced"))
    schema = "id long, path string, name string, body_hash string, moment long"
    assert rows(L.match_deleted(spark.createDataFrame(gone, schema), spark.createDataFrame(come, schema)), "new_id") == sorted(want)
    two = spark.createDataFrame([(1, "a", "f", "h", 1), (2, "a", "f", "h", 2)], schema)
    assert rows(L.match_deleted(two, two.select((F.col("id") + 10).alias("id"), "path", "name", "body_hash", (F.col("moment") + 5).alias("moment"))), "new_id") == [(11, 2, "reintroduced"), (12, 1, "reintroduced")]


def source_text(r, base=None):
    words = base or [r.choice(["x", "y", "foo", "bar", "=", "(", ")", "return", ";"]) + str(r.randint(0, 9)) for _ in range(r.randint(1, 60))]
    words = list(words)
    for _ in range(r.randint(0, 4)):
        words[r.randrange(len(words))] = f"w{r.randint(0, 99)}"
    return words


def test_copies_are_those_of_all_pairs(spark):
    r = random.Random(3)
    bases = [source_text(r) for _ in range(12)]
    texts = [" ".join(source_text(r, r.choice(bases))) for _ in range(90)] + ["", None, "# only a comment"]
    data = [(i, r.randint(0, 30), r.choice(["py", "js"]), r.randint(0, 50), t, r.choice([None, 10, 45])) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(data, "id long, lineage long, language string, moment long, text string, gone_at long")
    tokens = {x["id"]: x["t"] for x in frame.select("id", K.code_tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    bucket = {i: max(1, len(t) // 10) for i, t in tokens.items()}
    want = {}
    for t in data:
        best = {}
        for s in data:
            a, b = tokens[s[0]], tokens[t[0]]
            if not a or not b or s[2] != t[2] or s[1] == t[1] or s[3] >= t[3] or abs(bucket[s[0]] - bucket[t[0]]) > 1:
                continue
            like = round(SequenceMatcher(None, a, b, autojunk=False).ratio(), 6)
            if like >= 0.8:
                best[s[1]] = min(best.get(s[1], (-like, -s[3], s[0])), (-like, -s[3], s[0]))
        for like, _, s in sorted(best.values())[:10]:
            want[t[0], s] = -like
    got = {(x["target"], x["source"]): x["similarity"] for x in K.copy_candidates(frame, frame).collect()}
    assert got == want and len(want) > 50
    pairs = {}
    for a in tokens:
        for b in tokens:
            if a < b and data[a][2] == data[b][2] and tokens[a] and tokens[b] and abs(bucket[a] - bucket[b]) <= 1:
                bound = 2 * (Counter(tokens[a]) & Counter(tokens[b])).total() / (len(tokens[a]) + len(tokens[b]))
                if bound >= 0.8:
                    pairs[a, b] = round(bound, 6)
    firsts = {}
    for i, t in sorted(tokens.items()):
        firsts.setdefault((data[i][2], tuple(t)), i)
    heads = set(firsts.values())
    want = {k: v for k, v in pairs.items() if k[0] in heads and k[1] in heads} | {(h, i): 1.0 for i, t in tokens.items() if t and (h := firsts[data[i][2], tuple(t)]) != i}
    assert {(x["a"], x["b"]): x["bound"] for x in K.copy_bounds(frame).collect()} == want


def test_external_names(spark):
    names = ["numpy.linalg", "numpy", "@scope/pkg/x", "@scope", "..lib.core", "a\\b", "lodash/fp", "...", "/abs"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "t string").coalesce(1).select(B.external_name(F.col("t"))).collect()]
    assert got == ["numpy", "numpy", "@scope/pkg", "@scope", "lib", "a", "lodash", "", "/abs"]


def resolved(ref, symbols, paths, imports, most):
    """The tiers one after another."""
    _, file, name, qualified = ref
    folder = lambda f: paths[f].rpartition("/")[0]
    named = sorted((s for s in symbols if s[2] == name), key=lambda s: (s[1], s[0]))
    few = named[: most + 1]
    tiers = [
        [s for s in symbols if qualified and s[3] == qualified], [s for s in named if s[1] == file], [s for s in few if s[1] in imports[file]],
        [s for s in few if folder(s[1]) == folder(file)], few if len(named) <= most else [],
    ]
    for (tier, sure), found in zip(N.SCOPES, tiers):
        if len({s[0] for s in found}) == 1:
            return found[0][0], tier, sure
    return None


@pytest.mark.parametrize("most", [25, 2])
def test_names_are_resolved_by_the_first_scope(spark, most):
    r = random.Random(4)
    paths = {i: f"{r.choice(['a', 'a/b', 'c'])}/f{i}.py" for i in range(12)} | {99: "top.py"}
    symbols = [(f"s{i}", f, n, r.choice([None, f"m{f}.{n}", f"q{r.randint(0, 20)}"])) for i in range(60) if (f := r.choice(list(paths))) is not None and (n := f"n{r.randint(0, 25)}")]
    imports = defaultdict(set)
    for _ in range(20):
        imports[r.choice(list(paths))].add(r.choice(list(paths)))
    refs = [(i, r.choice(list(paths)), f"n{r.randint(0, 27)}", r.choice([None, f"q{r.randint(0, 20)}", "other.n1"])) for i in range(300)] + [(999, 99, None, None)]
    got = N.resolve_names(
        spark.createDataFrame(refs, "ref long, file long, name string, qualified string"), spark.createDataFrame(symbols, "symbol string, file long, name string, qualified string"),
        spark.createDataFrame(list(paths.items()), "file long, path string"), spark.createDataFrame([(f, t) for f, x in imports.items() for t in x] * 2 + [(99, None)], "file long, target long"), most,
    )
    want = {x[0]: y for x in refs if x[2] and (y := resolved(x, symbols, paths, imports, most))}
    assert {x["ref"]: (x["target"], x["tier"], x["confidence"]) for x in got.collect()} == want
    assert len({y[1] for y in want.values()}) >= (5 if most == 25 else 4)


def test_graph_of_sources(spark):
    """Imports, calls and bases from the texts of a few files."""
    texts = {
        1: ("app/base.py", "class Base:\n    def run(self):\n        return 1\n"),
        2: ("app/service.py", "from app.base import Base\nimport numpy.linalg\n\n\nclass Service(Base):\n    def load(self):\n        return helper(self.run())\n\n\ndef helper(x):\n    return x\n"),
        3: ("lib/other.py", "def helper(x):\n    return missing(x)\n"),
    }
    parsed = C.symbols(spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "file_id long, text string")).collect()
    symbols = []
    for s in parsed:
        lines = texts[s["file_id"]][1].split("\n")[s["start_line"] - 1 : s["end_line"]]
        symbols.append((f"{s['file_id']}:{s['qualified']}", s["file_id"], s["name"], s["qualified"], s["kind"], s["start_line"], lines[0], "\n".join(lines)))
    edges = N.graph_edges(
        "r", spark.createDataFrame([(i, p, p.rpartition("/")[0]) for i, (p, _) in texts.items()], "file long, path string, module string"),
        spark.createDataFrame(symbols, "symbol string, file long, name string, qualified string, kind string, first_line int, signature string, body string"),
        spark.createDataFrame([(2, "app.base", 1), (2, "numpy.linalg", None), (3, ".gone", None)], "file long, module string, target long"),
    )
    got = {(x["src"], x["dst"], x["kind"]): (x["confidence"], x["resolution"]) for x in edges.where("kind <> 'CONTAINS'").collect()}
    assert got[("symbol:2:Service", "symbol:1:Base", "INHERITS")] == (0.98, "qualified_name")
    assert got[("symbol:2:Service.load", "symbol:2:helper", "CALLS")] == (0.95, "same_file")
    assert got[("symbol:2:Service.load", "symbol:1:Base.run", "CALLS")] == (0.9, "imported_symbol")
    assert got[("file:2", "external:numpy", "IMPORTS_EXTERNAL")][0] == got[("file:2", "file:1", "IMPORTS")][0] == 1.0
    assert got[("file:2", "file:1", "DEPENDS_ON")] == (1.0, "aggregate") and not any("missing" in k[1] or ".gone" in k[1] for k in got)
    assert edges.where("kind = 'CONTAINS'").count() == 2 + 3 + len(symbols)


@pytest.mark.parametrize("local", [200_000, 0])
def test_ranges_and_ancestors(spark, monkeypatch, local):
    monkeypatch.setattr(A, "MOST_LOCAL", local)
    n = 40 if local else 14
    r = random.Random(5)
    parents = [(1, None)] + [(c, p) for c in range(2, n) for p in {r.randint(max(1, c - 4), c - 1) for _ in range(r.choice([1, 1, 1, 2, 3]))}] + [(200, None), (201, 200)]
    up = defaultdict(set)
    for c, p in parents:
        if p:
            up[c].add(p)
    closed = {}
    for c in sorted({x for x, _ in parents}):
        closed[c] = {c}.union(*(closed[p] for p in up[c]))
    graph = CommitGraph(spark.createDataFrame(parents * 2, "child long, parent long"))
    level = {}
    for c in sorted(closed):
        level[c] = 1 + max((level[p] for p in up[c]), default=0)
    assert {x["commit"]: x["generation"] for x in graph.labels.collect()} == level
    pairs = [(i, r.choice(list(closed)), r.choice(list(closed))) for i in range(300)] + [(900, 12345, 5), (901, 5, 12345)]
    got = {x["id"]: x["holds"] for x in graph.is_ancestor(spark.createDataFrame(pairs, "id long, ancestor long, commit long")).collect()}
    assert got == {i: a in closed.get(c, ()) for i, a, c in pairs}
    pairs = [(i, r.choice(list(closed)), r.choice(list(closed))) for i in range(40)] + [(900, None, n - 2), (901, 12345, n - 2)]
    got = defaultdict(set)
    for x in graph.commit_range(spark.createDataFrame(pairs, "id long, good long, bad long")).collect():
        assert x["commit"] not in got[x["id"]]
        got[x["id"]].add(x["commit"])
    assert all(got[i] == closed[b] - closed.get(g, set()) for i, g, b in pairs)
    if local:
        assert S.continues(spark.createDataFrame(parents, "child long, parent long"), 1, n - 1) and not S.continues(spark.createDataFrame(parents, "child long, parent long"), 201, n - 1)
    with pytest.raises(ValueError):
        CommitGraph(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long"))


@pytest.mark.parametrize("names", ["in order", "shuffled"])
def test_ranges_and_ancestors_by_blocks(spark, monkeypatch, names):
    for c, v in (("BLOCK", 20), ("ASKED", 7), ("WAITING", 12)):
        monkeypatch.setattr(A, c, v)
    r = random.Random(8)
    n = 90
    name = list(range(n)) if names == "in order" else r.sample(range(n), n)
    up = {c: {r.randint(max(0, c - 30), c - 1) for _ in range(r.choice([1, 1, 2]))} for c in range(1, n)}
    closed = {0: {0}}
    for c in range(1, n):
        closed[c] = {c}.union(*(closed[p] for p in up[c]))
    graph = CommitGraph(spark.createDataFrame([(name[c], name[p]) for c, ps in up.items() for p in ps], "child long, parent long"))
    assert graph.in_order == (names == "in order") and len(A._blocks(graph.places)) > 2
    pairs = [(i, r.randrange(n), r.randrange(n)) for i in range(80)]
    frame = spark.createDataFrame([(i, name[a], name[b]) for i, a, b in pairs], "id long, good long, bad long")
    monkeypatch.setattr(A, "_tasks", lambda _: 2)
    got = defaultdict(set)
    for x in graph.commit_range(frame).collect():
        assert x["commit"] not in got[x["id"]]
        got[x["id"]].add(x["commit"])
    assert all(got[i] == {name[c] for c in closed[b] - closed[a]} for i, a, b in pairs)
    held = {x["id"]: x["holds"] for x in graph.is_ancestor(frame.select("id", F.col("good").alias("ancestor"), F.col("bad").alias("commit"))).collect()}
    assert held == {i: a in closed[b] for i, a, b in pairs}


def test_ancestry_of_many_merges_takes_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(A, "MOST_LOCAL", 0)
    n, made = 300, []
    monkeypatch.setattr(A, "written", lambda df, of=A.written: made.append(1) or of(df))
    graph = CommitGraph(spark.createDataFrame([(c, p) for c in range(2, n) for p in (c - 1, c - 2)], "child long, parent long"))
    asked = spark.createDataFrame([(1, 1, n - 1), (2, n - 1, n - 2)], "id long, ancestor long, commit long")
    assert {x["id"]: x["holds"] for x in graph.is_ancestor(asked).collect()} == {1: True, 2: False} and len(made) < 30


def test_impact_keeps_the_widest_of_the_shortest_ways(spark):
    edges = spark.createDataFrame([("b", "a", "CALLS", 0.9), ("c", "a", "IMPORTS", 0.5), ("d", "b", "CALLS", 0.6), ("d", "c", "CALLS", 1.0), ("e", "d", "CALLS", 1.0), ("f", "a", "CALLS", 0.1), ("a", "e", "CALLS", 1.0)], "src string, dst string, kind string, confidence double")
    seeds = spark.createDataFrame([("a",), ("x",)], "node string")
    both = spark.createDataFrame([("a", "d", 4), ("b", "a", 2)], "file_a string, file_b string, co_changes long")
    got = rows(G.impact(edges, seeds, 3, both, 0.2).select("node", "distance", "direct", "caller", "confidence", "path", "co_changes"), "node")
    assert got == [("b", 1, True, True, 0.9, "a>b", 2), ("c", 1, True, False, 0.5, "a>c", 0), ("d", 2, False, False, 0.6, "a>b>d", 4), ("e", 3, False, False, 0.6, "a>b>d>e", 0)]


def test_impact_goes_back_from_what_is_left(spark, monkeypatch):
    r = random.Random(9)
    edges = {(a, b): (round(r.random(), 1), r.random() < 0.5) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(260)) if a != b}
    monkeypatch.setattr(G, "HELD", 100)
    frame = spark.createDataFrame([(a, b, "CALLS" if calls else "IMPORTS", c) for (a, b), (c, calls) in edges.items()] * 2, "src long, dst long, kind string, confidence double")
    got = {(x["seed"], x["node"]): (x["distance"], x["confidence"], x["path"], x["caller"]) for x in G.impact(frame, spark.range(9).withColumnRenamed("id", "node"), 4).collect()}
    want = {}
    for seed in range(9):
        known = last = {seed: (-1.0, [seed])}
        for d in range(1, 5):
            step = {}
            for (a, b), (c, _) in edges.items():
                if b in last and a not in known:
                    way = (max(last[b][0], -c), [*last[b][1], a])
                    step[a] = min(way, step.get(a, way))
            want |= {(seed, a): (d, -c, ">".join(map(str, p)), d == 1 and edges[a, seed][1]) for a, (c, p) in step.items()}
            known, last = known | step, step
    assert got == want and max(x[0] for x in want.values()) > 2


def test_impact_makes_no_row_for_each_way(spark):
    layers = [[(i, 1000 + j) for i in range(1) for j in range(60)], [(1000 + i, 2000 + j) for i in range(60) for j in range(60)], [(2000 + i, 3000 + j) for i in range(60) for j in range(60)]]
    edges = spark.createDataFrame([(b, a, "CALLS", 1.0) for x in layers for a, b in x], "src long, dst long, kind string, confidence double")
    found = G.impact(edges, spark.createDataFrame([(0,)], "node long"), 3)
    assert found.count() == 180 and "Join" not in found._jdf.queryExecution().toString()


def test_components_in_one_task_are_those_of_rounds(spark, monkeypatch):
    r = random.Random(6)
    edges = spark.createDataFrame([(r.randint(0, 40), r.randint(0, 40)) for _ in range(60)], "src long, dst long")
    local = rows(G.scc_cycles(edges), "node")
    monkeypatch.setattr(G, "MOST_LOCAL", 0)
    assert rows(G.scc_cycles(edges), "node") == local and local
    line = spark.range(20_000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 20_000).alias("dst"))
    monkeypatch.setattr(G, "MOST_LOCAL", 100_000)
    assert G.scc_cycles(line).where("component = 0").count() == 20_000


def test_drift_counts_cycles(spark):
    s = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "a", 1), (2, "a", "b", 1), (3, "a", "b", 1)], "snapshot long, src string, dst string, weight long")
    got = {x["snapshot"]: x for x in T.structural_drift(s).collect()}
    assert got[2]["cycle_distance"] == 1.0 and got[2]["drift"] == round(100 * (0.60 * 0.5 + 0.15), 2) and got[3]["drift"] == 0.0


def table(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key long, body string")


def test_versioned_table(spark, tmp_path):
    t = S.VersionedTable(spark, str(tmp_path / "t"), "key", 3)
    assert t.read() is None
    t.change(0, table(spark, (1, "a"), (2, "b")))
    t.change(1, table(spark, (2, "c"), (3, "d")), table(spark, (1, None), (3, None)))
    assert rows(t.read(), "key") == [(2, "c"), (3, "d")] and rows(t.read(1), "key") == [(1, "a"), (2, "b")]
    # cut off before it was noted: as if it had never begun, then written again
    table(spark, (9, "z")).withColumn("_gone", F.lit(False)).write.parquet(str(tmp_path / "t/change/2"))
    assert rows(t.read(), "key") == [(2, "c"), (3, "d")]
    for v in range(2, 9):
        t.change(v, table(spark, (v, "x"), (2, str(v))))
        t.change(v, table(spark, (v, "x"), (2, str(v))))  # a batch that comes again
        assert rows(t.read(), "key") == sorted([(2, str(v)), *((k, "x") for k in range(3, v + 1))]) if v > 2 else True
    kept = sorted(int(p.name) for p in (tmp_path / "t/change").iterdir() if p.name.isdigit())
    assert len(kept) < 8 and len(t.log()) <= 4 and t.log()[0][1] == "base"


def test_swap_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "s")
    table(spark, (1, "a")).write.parquet(path)
    S.swap_in(spark.read.parquet(path).unionByName(table(spark, (2, "b"))), path)
    assert rows(spark.read.parquet(path), "key") == [(1, "a"), (2, "b")]
    # written beside, not swapped: the old table stays
    table(spark, (3, "c")).write.parquet(f"{path}.new")
    S.recover(spark, path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "s.new").exists()
    # the old one moved away, the new one not there yet: the new one takes its place
    table(spark, (3, "c")).write.parquet(f"{path}.new")
    (tmp_path / "s").rename(tmp_path / "s.old")
    S.recover(spark, path)
    assert rows(spark.read.parquet(path)) == [(3, "c")] and not (tmp_path / "s.old").exists()
    # a new one that isn't whole: the old one comes back
    (tmp_path / "s").rename(tmp_path / "s.old")
    (tmp_path / "s.new").mkdir()
    S.recover(spark, path)
    assert rows(spark.read.parquet(path)) == [(3, "c")]


def test_graph_at_any_commit_is_the_one_built_anew(spark):
    r, versions = random.Random(7), {}
    for _ in range(300):
        versions[r.randint(0, 9), r.randint(0, 500)] = None if r.random() < 0.15 else [r.randint(0, 9) for _ in range(r.randint(0, 4))]
    points = [-1, 0, 500, 501, 10_000, *r.sample(range(500), 40)]
    want = set()
    for p in points:
        now = {}
        for (f, pos), targets in sorted(versions.items(), key=lambda x: x[0][1]):
            if pos <= p:
                now[f] = targets
        now = {f: t for f, t in now.items() if t is not None}
        want |= {(p, f, t) for f, ts in now.items() for t in ts if t in now and t != f}
    frame = spark.createDataFrame([(*k, t) for k, t in versions.items()], "file long, pos long, targets array<long>")
    got = rows(V.graph_at(V.edge_intervals(frame), spark.createDataFrame([(p,) for p in points * 2], "pos long")))
    assert len(got) == len(set(got)) and set(got) == want


def test_rules_choose_by_selectors(spark):
    nodes = spark.createDataFrame([("a", "module", "App/UI", "presentation", 0.9), ("b", "module", "app/db", "database", 0.9), ("c", "module", "lib", "database", 0.5), ("d", "component", "app", None, 0.0), ("e", "module", "apple", None, None)], "node string, node_type string, path string, layer string, confidence double")
    chosen = lambda kind, value: sorted(x["node"] for x in R.selected(nodes, spark.createDataFrame([("r", kind, value)], "rule string, kind string, value string")).collect())
    assert chosen("prefix", "APP/") == ["a", "b", "d"] and chosen("prefix", "app/ui") == ["a"] and chosen("module", "app") == [] and chosen("component", "app") == ["d"]
    assert chosen("layer", "Database") == ["b"] and chosen("prefix", "") == chosen("other", "app") == []
    edges = spark.createDataFrame([("a", "b", 0.95), ("b", "a", 0.85), ("a", "c", 1.0), ("a", "d", 1.0), ("e", "b", 0.5)], "src string, dst string, confidence double")
    rules = spark.createDataFrame([("f", "forbidden", "layer", "presentation", "layer", "database"), ("w", "allowed", "prefix", "app", "prefix", "app"), ("c", "forbidden_cycle", "module", "app/db", None, None), ("n", "forbidden_cycle", "module", "lib", None, None)], "rule string, kind string, source_kind string, source string, target_kind string, target string")
    got = rows(R.broken_rules(edges, nodes, rules), "rule")
    assert [x[:2] + x[3:] for x in got] == [("c", "b", 0.9), ("f", "a", 0.9), ("w", "a", 0.5)] and [x[2] for x in got][1:] == ["b", "c"]
