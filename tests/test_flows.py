from collections import deque

from skein.operators import flows


def plain_flow(entry, calls, known, most, depth):
    seen, queue, path = {entry}, deque([(entry, 0)]), []
    level: list = []
    while queue and len(path) < most:
        at = queue[0][1]
        level = sorted(n for n, d in queue if d == at)
        queue.clear()
        for n in level[: most - len(path)]:
            path.append((n, at))
        if at < depth:
            nxt = sorted({t for n in level for t in calls.get(n, ()) if t in known and t not in seen})
            seen |= set(nxt)
            queue.extend((t, at + 1) for t in nxt)
    return path


def test_flows_against_a_search_for_each_entry(spark, symbol, edge):
    pairs = [(f"n{i}", f"n{(i * 7 + k * 5) % 40}") for i in range(40) for k in range(1, 4)] + [("n1", "out"), ("n1", "n1"), ("n39", "n38")]
    s, e = symbol(*[(f"n{i}", f"src/{i % 6}.py") for i in range(40)]), edge(*pairs)
    entries = spark.createDataFrame([("n0",), ("n3",), ("n3",), ("n17",), ("nobody",)], "symbol_id string")
    calls: dict = {}
    for a, b in pairs:
        calls.setdefault(a, set()).add(b)
    known = {f"n{i}" for i in range(40)}
    for most, depth in ((40, 8), (10, 8), (5, 2), (1, 3)):
        got: dict = {}
        for r in flows.flows(entries, s, e, depth, most).orderBy("entry", "place").collect():
            got.setdefault(r["entry"], []).append((r["node"], r["hop"]))
        assert got == {x: plain_flow(x, calls, known, most, depth) for x in ("n0", "n3", "n17")}


def test_criticality_and_membership(spark, symbol, edge):
    s = symbol(("main", "a.py"), ("login", "b.py"), ("save", "c.py"), ("other", "d.py"))
    e = edge(("main", "login"), ("login", "save"), ("save", "sql"), ("save", "http"), ("other", "save"))
    entries = spark.createDataFrame([("main",), ("other",)], "symbol_id string")
    found = flows.flows(entries, s, e)
    c = {r["entry"]: r for r in flows.criticalities(found, s, e).collect()}
    m = c["main"]
    assert (m["nodes"], m["depth"], m["file_count"], m["external"], m["security"]) == (3, 2, 3, 2, 1)
    assert m["criticality"] == round(0.5 * 0.3 + 0.4 * 0.2 + 0.25 / 3 + 0.075 + 0.02, 4)
    of = {r["symbol_id"]: r for r in flows.membership(found, flows.criticalities(found, s, e)).collect()}
    assert of["save"]["flow_count"] == 2 and abs(of["save"]["flow_criticality"] - m["criticality"] - c["other"]["criticality"]) < 1e-9
    hit = flows.affected(found, flows.criticalities(found, s, e), spark.createDataFrame([("login",)], "symbol_id string")).collect()
    assert [(r["entry"], r["hits"]) for r in hit] == [("main", 1)]
    assert flows.flows(entries.limit(0), s, e).count() == 0 and flows.membership(flows.flows(entries, s.limit(0), e), flows.criticalities(found, s, e)).count() == 0
