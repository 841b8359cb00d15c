import json

import pytest
from pyspark.sql import functions as F

from skein.functions import extract, text
from skein.operators import memory, report, search
from skein.sources import files, tables
from skein.streaming import relay


def test_tokenizers(spark):
    rows = ["", "a", "☃", "ي ك میں‌ها", "x" * 5000, "a.b_c dotted.path 1st"]
    got = [r["w"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(text.words(F.col("t")).alias("w")).collect()]
    assert got[:3] == [[], [], []] and got[5] == ["b_c", "dotted", "path", "st"]
    assert all(2 <= len(w) <= 64 for w in got[4])


@pytest.mark.parametrize("path,want", [("tests/a.py", True), ("a/Test/b.go", True), ("src/test_x.py", True), ("src/x_test.go", True), ("src/x.spec.ts", True), ("src/FooTest.py", True), ("src/contest.py", False), ("src/latest/x.py", False), ("a\\tests\\b.py", True), (None, False)])
def test_test_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(text.is_test_path(F.col("p"))).first()[0] is want


@pytest.mark.parametrize("glob,path,want", [("**/*.py", "a.py", True), ("**/*.py", "x/y/a.py", True), ("docs/**", "docs", True), ("docs/**", "docs/a/b.md", True), ("a/**/b.py", "a/b.py", True), ("Build", "x/build/y.py", True), ("*.md", "x/readme.md", True), ("a?.py", "ab.py", True), ("*.md", "a.mdx", False)])
def test_globs(spark, glob, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(text.matches_glob(F.col("p"), glob)).first()[0] is want


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("g", 3.0, 5, "a"), ("g", 2.0, 9, "b"), ("g", 1.0, 3, "c"), ("g", 0.5, 0, "d"), ("h", 1.0, 99, "e"), ("h", 0.1, -1, "f")], "g string, score double, cost int, id string")
    assert {r["id"] for r in memory.packed(rows, ["g"], [F.desc("score")], "cost", 8).collect()} == {"a", "c", "d"}


def test_budget_against_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.randrange(0, 40)) for i in range(600)]
    want = set()
    for g in range(3):
        used = 0
        for _, i, c in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            if used + c <= 100:
                used += c
                want.add(i)
    got = memory.packed(spark.createDataFrame(rows, "g int, id int, cost int"), ["g"], [F.asc("id")], "cost", 100).collect()
    assert {r["id"] for r in got} == want and len(got) == len(want)


def test_scopes_don_t_mix(spark):
    rows = spark.createDataFrame([("t1", "w", "p", 1), ("t2", "w", "p", 1)], "tenant_id string, workspace_id string, project_id string, id int")
    assert tables.scoped(rows, tenant_id="t1", workspace_id="w", project_id="p").count() == 1
    for bad in ({"tenant_id": "t1"}, {"tenant_id": " ", "workspace_id": "w", "project_id": "p"}):
        with pytest.raises(ValueError):
            tables.scoped(rows, **bad)


def test_repository_scan(spark, tmp_path):
    for name, body in {"a.py": "x", "sub/b.ts": "y", "sub/empty.py": "", ".git/c.py": "z", "node_modules/d.js": "z", "e.txt": "t", "gen/f.py": "g", "gen/keep.py": "k"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = files.scan(spark, str(tmp_path), exclude=("gen/**",), include_again=("**/keep.py",), content=True)
    assert [(r["relative_path"], r["language"]) for r in got.collect()] == [("a.py", "python"), ("gen/keep.py", "python"), ("sub/b.ts", "typescript")]
    assert files.scan(spark, str(tmp_path), extensions=(".py",), most_files=1).count() == 1
    marked = files.ignored(got.drop("content"), ["*.py", "!gen/keep.py", "# note", ""])
    assert {r["relative_path"]: r["ignored"] for r in marked.collect()} == {"a.py": True, "gen/keep.py": False, "sub/b.ts": False}


def test_usage_log(spark, tmp_path):
    lines = [{"ts": "2024-01-01T00:00:00Z", "client_id": "c", "tool": "t", "tokens_in": 3}, {"ts": "2024-01-03T00:00:00Z", "tool": "u"}, {"tool": "no time"}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    assert files.usage_log(spark, str(tmp_path)).count() == 2
    assert [r["tool"] for r in files.usage_log(spark, str(tmp_path), "2024-01-01 00:00:00", "2024-01-02 00:00:00").collect()] == ["t"]


def test_export_and_remap(spark, tmp_path):
    scope, other = {"tenant_id": "t", "workspace_id": "w", "project_id": "p"}, {"tenant_id": "T", "workspace_id": "W", "project_id": "P"}
    rows = spark.createDataFrame([("t", "w", "p", "sym:p:a", '{"x": "file:p:b"}'), ("t", "w", "q", "sym:q:a", "{}")], "tenant_id string, workspace_id string, project_id string, id string, j string")
    one = files.export(rows, scope, str(tmp_path / "out")).first()
    assert one["rows"] == 1 and one == files.export(rows.repartition(3), scope, str(tmp_path / "again")).first()
    moved = files.remapped(rows, scope, other, ("id",), ("j",)).filter("tenant_id = 'T' and project_id = 'P'").first()
    assert (moved["id"], moved["j"]) == ("sym:P:a", '{"x": "file:P:b"}')
    with pytest.raises(ValueError):
        files.export(rows.withColumn("j", F.lit("password = hunter2")), scope, str(tmp_path / "no"))
    left, counts = files.without_scope(rows, scope)
    assert left.count() == 1 and {r["removed"]: r["rows"] for r in counts.collect()} == {True: 1, False: 1}


def test_vectors_upserts_and_hashes(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id int, embedding array<float>")
    files.write_vectors(v, str(tmp_path / "v"), 2)
    assert files.read_vectors(spark, str(tmp_path / "v"), 2).count() == 2
    for act in (lambda: files.write_vectors(v, str(tmp_path / "w"), 3), lambda: files.read_vectors(spark, str(tmp_path / "v"), 3)):
        with pytest.raises(ValueError):
            act()
    now = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    changes = spark.createDataFrame([("a", 5, 1, False), ("a", 6, 2, False), ("b", 0, 3, True), ("c", 7, 4, False)], "k string, v int, seq int, deleted boolean")
    assert {tuple(r) for r in files.upserted(now, changes, "k", "seq").collect()} == {("a", 6), ("c", 7)}
    f = spark.createDataFrame([("a", "h1", False), ("b", "h2", True), ("c", "h3", False)], "file_path string, content_hash string, complete boolean")
    assert {r[0] for r in files.publishable_hashes(f, f.filter("file_path = 'a'")).collect()} == {"a", "b"}


def test_pages_of_rows(spark):
    rows = spark.createDataFrame([(i // 2, i) for i in range(10)], "u int, id int")
    first = [tuple(r) for r in report.page(rows, ["u", "id"], 3).collect()]
    second = [tuple(r) for r in report.page(rows, ["u", "id"], 3, first[2]).collect()]
    assert first == [(4, 9), (4, 8), (3, 7), (3, 6)] and second[0] == (3, 6)


def test_metrics(spark):
    r = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, item string, rank int")
    gold = spark.createDataFrame([("q", "b", 1.0), ("p", "z", 1.0)], "query string, item string, gain double")
    assert {x["query"]: x["ndcg"] for x in search.ndcg(r, gold).collect()} == {"q": 0.6309, "p": 0.0}
    tools = spark.createDataFrame([("search_code", "find code", False), ("delete_code", "remove code", True)], "tool string, description string, destructive boolean")
    assert [t["tool"] for t in search.tool_scores(tools, "search code").collect()] == ["search_code"]


def test_extraction(spark):
    py = '@app.get("/x")\nasync def handler(db=Depends(get_db)):\n    requests.post("http://h/y?z")\n\nclass A(Base):\n    def _run(self):\n        return helper.go()\n'
    js = "router.post('/p', save); fetch(`/q`); axios.get('/r')"
    src = spark.createDataFrame([("a.py", "python", py), ("b.js", "javascript", js), ("c.py", "python", "def broken(:"), ("d.py", "python", None)], "file_path string, language string, source string")
    assert {tuple(r) for r in extract.routes(src).collect()} == {("a.py", "GET", "/x", "handler"), ("b.js", "POST", "/p", "save")}
    assert {tuple(r) for r in extract.http_calls(src).collect()} == {("a.py", "POST", "http://h/y?z"), ("b.js", "GET", "/q"), ("b.js", "GET", "/r")}
    assert [tuple(r)[:3] for r in extract.injections(src).collect()] == [("a.py", "db", "get_db")]
    parsed = extract.python_symbols(src.filter("language = 'python'"))
    got = {r["qualified_name"]: r for r in parsed.collect() if r["file_path"] == "a.py"}
    assert set(got) == {"a", "a.handler", "a.A", "a.A._run"} and got["a.A"]["bases"] == ["Base"] and got["a.A._run"]["visibility"] == "private"
    assert {("a.A._run", "helper.go", "CALLS"), ("a.A", "Base", "INHERITS_FROM"), ("a.A", "a.A._run", "CONTAINS")} <= {tuple(r) for r in extract.python_edges(parsed).collect()}


def test_a_stream_equals_its_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for project in (relay.memories, relay.messages):
        assert sorted(map(tuple, relay.relayed(spark, sf_dir, project).collect())) == sorted(map(tuple, project(events).collect()))


def test_streamed_windows_and_dedup(spark, sf_dir):
    stream = relay.outbox(spark, sf_dir)
    for name, made in (("w", relay.windows(stream)), ("o", relay.once(stream).groupBy().count())):
        q = made.writeStream.format("memory").queryName(f"t_{name}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert sorted(map(tuple, spark.table("t_w").collect())) == sorted(map(tuple, relay.windows(batch).collect()))
    assert spark.table("t_o").first()[0] == batch.count() == relay.once(batch.union(batch)).count()


def test_front_matter(spark):
    from skein.operators import docs

    t = "---\ntitle: A\ntags: x, y\ntitle: B\n---\n# H\nbody"
    r = docs.front_matter(spark.createDataFrame([(t,), ("plain",)], "text string")).collect()
    assert r[0]["front"] == {"title": "B", "tags": "x, y"} and r[0]["body"] == "# H\nbody" and r[1]["front"] == {} and r[1]["body"] == "plain"
