"""Small hand-built graphs: cycles, diamonds, dead islands, communities."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import communities, graph, resolve, traverse


def test_a_cycle_leads_back_to_the_seed_among_callers_only(edge, symbol):
    e, s = edge(("a", "b"), ("b", "c"), ("c", "a")), symbol(("a",), ("b",), ("c",))
    assert [(r["symbol_id"], r["hop"]) for r in traverse.callers(e, s, "a", max_depth=5).collect()] == [("c", 1), ("b", 2), ("a", 3)]
    assert {r["symbol_id"] for r in traverse.impact(e, "a", "upstream", 5).collect()} == {"b", "c"}


def test_a_diamond_keeps_the_strongest_edge(edge):
    e = edge(("a", "b"), ("a", "c"), ("b", "d", "CALLS", "probable"), ("c", "d", "HTTP_CALLS", "exact"))
    r = {x["symbol_id"]: x for x in traverse.impact(e, "a", "downstream", 3).collect()}
    assert (r["d"]["hop"], r["d"]["confidence"], r["d"]["via_rel"], r["d"]["direction"]) == (2, "exact", "HTTP_CALLS", "downstream")
    assert traverse.impact(e, "a", "both", 3).filter("symbol_id = 'a'").count() == 0
    assert traverse.impact(edge(("a", "b", "CALLS", "ambiguous")), "a", "downstream").count() == 0


def test_paths(edge):
    e = edge(("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("x", "y"))
    path = lambda a, b: [r["node"] for r in traverse.shortest_path(e, a, b).orderBy("pos").collect()]
    assert path("d", "a") == ["d", "b", "a"] and path("a", "a") == ["a"] and path("a", "x") == []
    assert traverse.hops(e, "a", 0).count() == 2


def test_life_and_death(edge, symbol):
    s = symbol(("main", "src/m.py"), ("used", "src/m.py"), ("x", "src/i.py"), ("y", "src/i.py"), ("t", "tests/test_a.py"), ("tested", "src/t.py"))
    e = edge(("main", "used"), ("x", "y"), ("y", "x"), ("t", "tested"))
    pool = s.filter("symbol_id <> 't'")
    assert {r[0] for r in traverse.live(s, e, pool).collect()} == {"main", "used"}
    found = {r["symbol_id"]: r for r in graph.unused_candidates(s, e, pool).collect()}
    assert set(found) == {"x", "y", "tested"} and found["x"]["finding_kind"] == "dead_subgraph" and found["tested"]["test_only"] and not found["tested"]["safe_to_delete"]
    dead = s.filter("symbol_id in ('x', 'y', 'tested')").select("symbol_id")
    assert {r[0] for r in traverse.dead_subgraph(e, dead).collect()} == {"x", "y"}


def test_life_goes_on_however_long_the_chain(edge, symbol, monkeypatch):
    monkeypatch.setattr(traverse, "MAX_ROUNDS", 2)
    monkeypatch.setattr(traverse, "LEVELS", 3, raising=False)
    names = ["main", *[f"s{i}" for i in range(8)]]
    s, e = symbol(*[(n, "src/m.py") for n in names]), edge(*zip(names, names[1:]))
    assert sorted(r[0] for r in traverse.live(s, e, s).collect()) == sorted(names)
    assert graph.unused_candidates(s, e, s).count() == 0
    with pytest.raises(RuntimeError):
        traverse.components(edge(*[(f"n{i}", f"n{i + 1}") for i in range(20)]))


def test_two_triangles_are_two_communities(edge):
    e = edge(("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("a1", "b1", "DOCUMENTED_BY"))
    c = {r["node"]: r["community"] for r in communities.communities(e).collect()}
    assert c == {"a1": "a1", "a2": "a1", "a3": "a1", "b1": "b1", "b2": "b1", "b3": "b1"}
    b = {r["node"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    assert min(b["a1"], b["b1"]) > max(b["a2"], b["b2"])


def plain_louvain(pairs):
    """Modularity of Louvain's method, one node at a time."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1.0
    k = {n: sum(x.values()) for n, x in near.items()}
    total, member, graph_, strength = sum(k.values()), {n: n for n in near}, near, dict(k)
    while True:
        comm, sums, moved, any_ = {n: n for n in graph_}, dict(strength), True, False
        while moved:
            moved = False
            for n in graph_:
                w = {}
                for o, x in graph_[n].items():
                    w[comm[o]] = w.get(comm[o], 0) + x
                own = comm[n]
                sums[own] -= strength[n]
                best, gain = own, w.get(own, 0) - strength[n] * sums[own] / total
                for c in sorted(w):
                    if w[c] - strength[n] * sums[c] / total > gain + 1e-12:
                        best, gain = c, w[c] - strength[n] * sums[c] / total
                sums[best] += strength[n]
                if best != own:
                    comm[n], moved, any_ = best, True, True
        member = {v: comm[c] for v, c in member.items()}
        if not any_:
            sums = {}
            for n, c in member.items():
                sums[c] = sums.get(c, 0) + k[n]
            return sum(x for n in near for o, x in near[n].items() if member[n] == member[o]) / total - sum((s / total) ** 2 for s in sums.values())
        merged, weights = {}, {}
        for n in graph_:
            c = comm[n]
            weights[c] = weights.get(c, 0) + strength[n]
            into = merged.setdefault(c, {})
            for o, x in graph_[n].items():
                if comm[o] != c:
                    into[comm[o]] = into.get(comm[o], 0) + x
        graph_, strength = merged, weights


def test_communities_against_plain_louvain(edge):
    rng = random.Random(5)
    planted = [(f"n{i:02}", f"n{j:02}") for i in range(48) for j in range(i + 1, 48) if rng.random() < (0.6 if i // 12 == j // 12 else 0.04)]
    cliques = [(f"c{i}{a}", f"c{i}{b}") for i in range(6) for a in range(5) for b in range(a + 1, 5)] + [(f"c{i}0", f"c{(i + 1) % 6}1") for i in range(6)]
    star = [("hub", f"s{i}") for i in range(12)]
    for pairs in (planted, cliques + [(f"x{a}", f"x{b}") for a, b in star]):
        history: list = []
        found = communities.communities(edge(*pairs), history)
        assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
        assert communities.modularity(edge(*pairs), found) >= 0.98 * plain_louvain(pairs)
        assert found.count() == len({x for p in pairs for x in p}) == found.select("node").distinct().count()


def plain_betweenness(pairs, sources=None):
    from collections import deque

    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    sources = list(near) if sources is None else sources
    for s in sources:
        paths, dist, order, queue = {s: 1.0}, {s: 0}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near.get(v, ()):
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(near, 0.0)
        for w in reversed(order):
            for v in near.get(w, ()):
                if dist.get(v) == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                total[w] += dep[w]
    return {k: v / len(sources) for k, v in total.items()}


def test_betweenness_against_plain_search(edge):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("e", "g")]
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(edge(*pairs)).collect()}
    assert got == pytest.approx(plain_betweenness(pairs), abs=1e-6)


def test_empty_graphs(edge, symbol):
    e, s = edge(("a", "b")).limit(0), symbol(("a",)).limit(0)
    for df in (traverse.callers(e, s, "a"), traverse.impact(e, "a"), traverse.components(e), communities.communities(e), graph.betweenness(e), graph.hubs(s, e), traverse.live(s, e, s), graph.unused_candidates(s, e, s)):
        assert df.count() == 0


def test_dispatch(spark):
    calls = spark.createDataFrame([("caller", "Base.run")], "source_id string, target_id string")
    inherits = spark.createDataFrame([("Derived", "Base")], "child string, parent string")
    methods = spark.createDataFrame([("Base.run", "Base", "run"), ("Derived.run", "Derived", "run"), ("Derived.stop", "Derived", "stop")], "method_id string, class_id string, name string")
    assert [tuple(r) for r in graph.dispatched(calls, inherits, methods).collect()] == [("caller", "Derived.run")]


def test_injections_and_names(spark, symbol):
    s = symbol(("m.make",), ("m.use",), ("n.use2",), ("o.make2",), ("p.make2",))
    i = spark.createDataFrame([(1, "use", "make"), (2, "use2", "make2"), (3, "nobody", "make"), (4, "use", "none")], "injection_id int, consumer_name string, provider_name string")
    assert {(r["injection_id"], r["confidence"]) for r in resolve.injected(i, s).collect()} == {(1, "probable"), (2, "ambiguous"), (4, "unresolved")}
    t = symbol(("run", "src/a.py"), ("test_run", "tests/a.py"))
    assert [tuple(r) for r in resolve.name_links(t).collect()] == [("run", "test_run")]


def test_risk_levels(spark):
    f = spark.createDataFrame([(0.5, 0, 9, 0, 99, "login", "a.login", 50), (None, 0, 0, 9, 0, "x", "x", 0)], "flow_criticality double, flow_count int, cross_community int, test_count int, caller_count int, name string, qualified_name string, churn int")
    assert [(r["risk"], r["level"]) for r in graph.change_risk(f).orderBy(F.desc("risk")).collect()] == [(1.0, "critical"), (0.05, "low")]


def test_state_of_very_many_links_does_not_overflow(spark):
    links = spark.range(40_000_000).select(F.col("id").alias("a"), F.col("id").alias("b"))
    n, h = traverse._state(links)
    assert n == 40_000_000 and h is not None
    assert traverse._state(links.filter("a <> 7")) != (n, h)
