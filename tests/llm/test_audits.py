"""Filter audits, URL rules and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import conversation_repair as C
from palimpsest.llm import filter_audit as A
from palimpsest.llm import url_rules as U

SPACES = " \t\n\x0b\f\r"
LABELS = "doc_id long, quality int, toxic int, part string, good int, n long"


# filters


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_all_orders(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in A.adjacent_swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == np.prod(range(1, n + 1))


def audit_brute(docs, labels):
    """docs: (doc_id, text, lang), labels: (doc_id, quality, toxic)."""
    out, cases = {}, []
    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids.setdefault(t or "", []).append(i)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(f"[^{SPACES}]+", t)
        f = [len(w) < 200, 100 * len({*w}) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and min(ids[t]) < i]
        own = [x for x in labels if x[0] == i and i is not None]
        cases.append((lang or "", f, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    for part in {c[0] for c in cases}:
        rows = [c for c in cases if c[0] == part]
        shapley = Counter()
        for o in itertools.permutations(range(5)):
            left, gone = rows, []
            for k, f in enumerate(o):
                here, now = [c for c in left if c[1][f]], [c for c in left if not c[1][f]]
                out[part, "".join("ABCDE"[x] for x in o), k + 1] = [len(now), len(here), sum(c[1][f] for c in gone), sum(c[1][f] and sum(c[1]) == 1 for c in rows), sum(c[2] for c in here), sum(c[3] for c in here)]
                shapley[f] += len(here)
                left, gone = now, gone + here
        for (p, o, k), v in out.items():
            if p == part:
                v.append(shapley["ABCDE".index(o[k - 1])])
    return out


def test_filter_audit(spark):
    r = random.Random(4)
    texts = [None, "", "A B C", "plain words here", "x" * 5000, "one | two", " ".join(f"w{i}" for i in range(300)), " ".join(["same"] * 400), " ".join(f"W{i}" for i in range(250)) + " #", "É " * 300]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(150)] + [(None, texts[6], "en"), (None, None, "xx"), (7, texts[6], "en"), (7, texts[6], "en"), (-3, texts[6], "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(i, t, p, "m", 1) for i, t, p in docs], "doc_id long, text string, lang string, mask string, n int").repartition(3)
    table = spark.createDataFrame([(*x, "p", 1, 2) for x in labels], LABELS)
    got = {(x["part"], x["filter_order"], x["step"]): list(x)[3:] for x in A.audit_filters(frame, table).collect()}
    assert got == audit_brute(docs, labels)
    assert A.audit_filters(frame.limit(0), table).count() == 0
    assert {k: v[:4] + v[-1:] for k, v in got.items()} == {(x["part"], x["filter_order"], x["step"]): [x["kept"], x["removed"], x["redundant"], x["unique_fails"], x["shapley"]] for x in A.audit_filters(frame, table.limit(0)).collect()}


def test_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5), ("p", 1, 2), ("p", 3, 4)], "part string, mask int, n long")
    got = {(r["filter_order"], r["step"]): r for r in A.audit_cells(cells, "XY", []).collect()}
    assert (got["XY", 1]["removed"], got["XY", 2]["removed"], got["YX", 1]["removed"], got["YX", 2]["removed"]) == (6, 0, 4, 2)
    assert got["XY", 1]["shapley"] == 8 and got["YX", 1]["shapley"] == 4 and got["XY", 2]["redundant"] == 4
    with pytest.raises(ValueError):
        A.audit_cells(cells, "ABCDEFGH", [])


# URLs


def test_host_rules():
    index = U.Index()
    for verdict, rule in U.HOST_RULES:
        host, slash, path = rule.partition("/")
        index.hosts.setdefault(host, []).append((slash + path, rule, verdict))
        index.longest = max(index.longest, len(host))
    for url, want in {
        "http://a.com/x": ("allow", "com/"), "http://EXAMPLE.com/en/1": ("block", "example.com/en/"), "http://www.example.com/en/": ("allow", "www.example.com/en/"),
        "http://b.www.example.com/en/x": ("allow", "www.example.com/en/"), "http://notexample.com/en/": ("allow", "com/"), "http://example.com": None, "http://x.net/es/": ("block", "net/es/"),
        "http://x.net/ES/": None, "http://net/fr/?q": ("block", "net/fr/"), "http://x.org/": None, "x.com/": None, "http://x.com?/": None, "://com/": ("allow", "com/"),
    }.items():
        assert index.host_rule(*U.split_url(url)) == want, url
    assert index.host_rule("a." * 300_000 + "com", "/") == ("allow", "com/")
    assert U.split_url(None) == U.split_url("no scheme") == ("", "")
    assert U.split_url("x://Ab.C:80#/p") == ("ab.c:80", "") and U.split_url("x://h/P\nq?r") == ("h", "/P\nq")


def test_patterns():
    for pattern, hits, misses in [
        ("||ads.", ["http://ads.x/", "http://a.ads.x/", "s://u@ads.x"], ["http://bads.x/", "http://x/ads.", "http://x/?http://ads.y"]),
        ("/a*b^|", ["s://h/axxb", "s://h/abab/"], ["s://h/axxbc", "s://h/axxb//"]),
        ("|s://x^", ["s://x", "s://x/y"], ["t://s://x", "s://xy"]),
        (".zip|", ["s://h/A.ZIP"], ["s://h/a.zip?x"]),
        ("a*a*b", ["aab", "xaxaxb"], ["ab", "aba"]),
    ]:
        p = U.parse(pattern)
        for regex in (p.regex, p.plain.replace(r"\z", r"\Z")):
            assert all(re.compile(regex, re.DOTALL).match(u.translate(U.TO_LOWER)) for u in hits), (pattern, regex)
            assert not any(re.compile(regex, re.DOTALL).match(u.translate(U.TO_LOWER)) for u in misses), (pattern, regex)
    assert [U.parse(p).tokens for p in ("||ads.", "ads.", "/x/*y/", "@@|http^a", ".zip|", "^b^")] == [["ads"], [], ["x"], ["http"], ["zip"], ["b"]]
    long = "s://h/" + "a" * 200_000
    assert not re.compile(U.parse("a*a*a*b").regex, re.DOTALL).match(long)


def test_patterns_lose_no_match():
    """Both forms of random patterns find the same URLs, and each URL that a pattern fits has its tokens."""
    r = random.Random(8)
    bits = ["a", "bc", "/", ".", "-", "^", "*", "1", "?", "="]
    urls = ["s://" + "".join(r.choice(["a", "bc", "/", ".", "-", "1", "?", "=", "@"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    found = 0
    for _ in range(300):
        text = r.choice(["", "", "|s://", "||"]) + "".join(r.choice(bits) for _ in range(r.randint(1, 5))) + r.choice(["", "", "|"])
        p = U.parse(text)
        one, other = re.compile(p.regex, re.DOTALL), re.compile(p.plain.replace(r"\z", r"\Z"), re.DOTALL)
        for u in urls:
            hit = one.match(u) is not None
            assert hit == (other.match(u) is not None), (text, u)
            assert not hit or {*p.tokens} <= {*U.TOKEN.findall(u)}, (text, u)
            found += hit
    assert found > 500


def judged_brute(url, patterns):
    host, path = U.split_url(url)
    fits = [(-len(rule), verdict != "block", rule, verdict) for verdict, rule in U.HOST_RULES if (host == (h := rule.split("/")[0]) or host.endswith("." + h)) and path.startswith(rule[len(h) :])]
    if fits:
        return host, path, min(fits)[2], min(fits)[3]
    hits = [p for p in map(U.parse, patterns) if re.compile(p.plain.replace(r"\z", r"\Z"), re.DOTALL).match((url or "").translate(U.TO_LOWER))]
    return host, path, None, "allow" if not hits or any(p.allows for p in hits) else "block"


def test_urls(spark):
    r = random.Random(5)
    hosts = ["a.com", "example.com", "WWW.example.com", "x.net", "casino-win.example.org", "ads.b.org", "docs.c.org", "wiki.d.org", "", "bet-1.e.de"]
    ends = ["", "/", "/en/1", "/es/", "/fr/x?y", "/ads/about", "/ads/x", "/search?q=1", "/tag/x/page/2", "/a.zip", "/x?sessionid=1", "#/ads/", "/" + "a-" * 50_000]
    urls = [None, "", "nothing", "://", "http://"] + [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(ends)}" for _ in range(300)]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "h", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string").repartition(3)
    got = Counter((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in U.judge_urls(pages).collect())
    assert got == Counter((i if i % 50 else None, *judged_brute(u, U.PATTERNS)) for i, u in enumerate(urls))
    assert {"allow", "block"} == {k[4] for k in got if k[3] is None}
    kept = U.without_blocked(pages)
    assert kept.columns == pages.columns and kept.exceptAll(pages).isEmpty() and kept.count() == sum(n for k, n in got.items() if k[4] == "allow")
    assert U.judge_urls(pages.limit(0)).count() == 0
    bare = {x["verdict"] for x in U.judge_urls(pages, [], []).collect()}
    assert bare == {"allow"}
    index = U.build_index(pages, [], ["/common/rare/", "/ads/x^", "loose"])
    seen = Counter(t for u in urls for t in {*U.TOKEN.findall((u or "").translate(U.TO_LOWER))})
    assert seen["x"] and seen["ads"] and not seen["common"] + seen["rare"]
    assert index.by_token == {"common": [0], min("ads", "x", key=lambda t: (seen[t], -len(t))): [1]} and index.untold == [2]


# conversations


def edits_brute(rows):
    """(cost, audit) by trying all edit strings; rows: (initial, gone, cut)."""
    best = None
    for letters in itertools.product("KRD", repeat=len(rows)):
        for put in itertools.product(range(3), repeat=len(rows) + 1):
            text = "".join("I" * k + e for k, e in zip(put, [*letters, ""]))
            roles, cost, i, ok = "", 0, 0, True
            for e in text:
                if e == "I":
                    roles, cost = roles + "?", cost + 5
                    continue
                initial, gone, cut = rows[i]
                i += 1
                if e == "D":
                    cost += 2
                else:
                    ok = ok and not gone
                    roles, cost = roles + (initial if e == "K" else "?"), cost + (e == "R") + 5 * cut
            start = roles[:1] == "s"
            want = "s" * start + "ua" * ((len(roles) - start) // 2)
            if ok and len(want) == len(roles) and not (start and len(roles) == 1) and all(a in (b, "?") for a, b in zip(roles, want)):
                best = min(best or (cost, text), (cost, text))
    return best


def forward_brute(rows):
    """(cost, audit), one row at a time, with two insertions in a row allowed."""

    def put(states):
        for _ in range(2):
            new = dict(states)
            for s, (c, t) in states.items():
                to = 3 if s == 2 else 2
                new[to] = min(new.get(to, (c + 5, t + "I")), (c + 5, t + "I"))
            states = new
        return states

    states = put({0: (0, "")})
    for initial, gone, cut in rows:
        new = {}
        for s, (c, t) in states.items():
            ways = [(s, 2, "D")]
            if not gone:
                ways.append((3 if s == 2 else 2, 1 + 5 * cut, "R"))
                if initial in C.NEXT[s]:
                    ways.append((C.NEXT[s][initial], 5 * cut, "K"))
            for to, more, e in ways:
                new[to] = min(new.get(to, (c + more, t + e)), (c + more, t + e))
        states = put(new)
    return min(states[s] for s in (0, 3) if s in states)


def conversation_brute(rows):
    """The audit of rows (turn, role, text) after damage, in order."""
    seen, state, counts, roles = set(), [], Counter(), [r[:1] for _, r, _ in rows]
    for _, role, text in rows:
        fault = "blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if text.strip(SPACES)[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        state.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = forward_brute(state)
    kept, i = [], 0
    for e in audit:
        turn, role, text = rows[i] if e != "I" else (None, None, "")
        i += e != "I"
        if e != "D":
            ahead = bool(kept) and kept[0][0][:1] == "s"
            kept.append((role if e == "K" else "assistant" if (len(kept) - ahead) % 2 else "user", text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(), kept


def damaged_brute(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def test_cheapest_edits_of_short_conversations():
    r = random.Random(2)
    kinds = [(i, g, c) for i in "suao" for g in (False, True) for c in (False, True)]
    for _ in range(150):
        rows = [r.choice(kinds) for _ in range(r.randint(0, 4))]
        assert edits_brute(rows) == forward_brute(rows)
        signature = "".join("x" if g else i.upper() if c else i for i, g, c in rows)
        moves = [m[2:] for m in C.solve(signature) if m[0] == 0 and m[1] in C.ENDS]
        assert min(moves) == forward_brute(rows), signature


def test_blocks_put_together_are_the_whole():
    r = random.Random(3)
    for _ in range(60):
        signature = "".join(r.choice("suaoSUAx") for _ in range(r.randint(0, 30)))
        rows = [(x.lower(), x == "x", x.isupper()) for x in signature]
        replay, at = C.Replay(1), 0
        while at < len(signature):
            step = r.randint(1, 7)
            replay.add_block([dict(zip(("a", "b", "cost", "audit"), m)) for m in C.solve(signature[at : at + step])], (0, 0, 0))
            at += step
        replay.settle()
        assert (replay.cost, replay.audit) == forward_brute(rows)


def random_conversations(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Long. " * 50, "é ü", "Yes. \n"]
    rows = []
    for conv in range(n):
        for turn in r.sample(range(12), r.randint(1, 9)):
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(texts)))
    return rows


def order(rows):
    return sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), hashlib.sha256(x[3].encode()).digest()))


@pytest.mark.parametrize("block", [3, 200])
def test_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "MOST_LETTERS", 0 if block == 3 else C.MOST_LETTERS)
    rows = random_conversations(1, 60)
    rows += [(70, None, "user", "a."), (70, None, "user", "a."), (70, 3, "assistant", "b."), (None, 1, "user", "x."), (None, 2, "assistant", "y."), (71, None, "user", None)]
    rows += [(80, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(700)]
    frame = spark.createDataFrame([(*x, "c", 5) for x in rows], "conv_id long, turn long, role string, text string, signature string, place int").repartition(5)
    damaged = damaged_brute(rows)
    assert Counter(map(tuple, C.damage(frame).collect())) == Counter(damaged)
    want = {}
    for conv in {x[0] for x in rows}:
        want[conv] = conversation_brute([x[1:] for x in order([x for x in damaged if x[0] == conv])])
    got = {x["conv_id"]: tuple(x)[1:] for x in C.audits(C.damage(frame), frame).collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    kept = {}
    for x in C.repaired(C.damage(frame)).orderBy("conv_id", "place").collect():
        kept.setdefault(x["conv_id"], []).append((x["role"], x["text"]))
    assert kept == {k: v[-1] for k, v in want.items() if v[-1]}
    none = frame.limit(0)
    assert C.audits(C.damage(none), none).count() == 0 and C.audits(C.damage(none), frame).where("audit = '' AND cost = 0").count() == len(want)


def test_signatures_are_solved_once(spark):
    """A thousand conversations of one kind have one signature."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c}.") for c in range(1000) for t in range(4)]
    blocks = C.signatures(C._clean(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert C.solve_all(blocks).count() <= 8  # ranges may cut a conversation or two
