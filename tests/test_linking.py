import random

import pytest
from pyspark.sql import functions as F

from skein.functions import extract, lineage
from skein.operators import code, docs, governance, graph, linking, report, resolve, rules, search, traverse
from skein.plans import explore, ingest, overview
from skein.sources import files
from skein.streaming import relay

SYMBOLS = "symbol_id string, kind string, name string, qualified_name string, file_path string, language string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def test_names_across_languages(spark):
    s = spark.createDataFrame(
        [("a", "function", "run", "pkg.mod.run", "pkg/mod.go", "go"), ("b", "class", "Tool", "app::Tool", "app/tool.rs", "rust"), ("c", "function", "dup", "x.dup", "x.py", "python"), ("d", "function", "dup", "y.dup", "y.py", "python"), ("e", "external", "run", "run", "", "")], SYMBOLS
    )
    calls = spark.createDataFrame([("1", "m", "f", "pkg/mod/run", "python"), ("2", "m", "f", "app.Tool", "rust"), ("3", "m", "f", "dup", "python"), ("4", "m", "f", "al", "python"), ("5", "m", "f", "nothing", "go"), ("6", "m", "f", "print", "python")], "call_id string, module string, file_path string, ref string, language string")
    aliases = spark.createDataFrame([("f", "al", "app/Tool")], "file_path string, alias string, full_name string")
    got = rows(linking.polyglot_calls(calls, s, aliases, spark.createDataFrame([("print",)], "ref string")), "call_id", "target", "confidence")
    assert [g for g in got if g[0] != "3"] == [("1", "a", "probable"), ("2", "b", "exact"), ("4", "b", "probable"), ("5", None, "unresolved"), ("6", None, "external")]
    assert [g for g in got if g[0] == "3"] == [("3", "c", "ambiguous")]
    resolved = linking.polyglot_calls(calls, s, aliases, spark.createDataFrame([("print",)], "ref string"))
    assert rows(linking.fanned_out(resolved, calls, s).filter("call_id = '3'")) == [("3", "c", "ambiguous"), ("3", "d", "ambiguous")]
    assert linking.polyglot_calls(calls.limit(0), s, aliases, aliases.select(F.col("alias").alias("ref"))).count() == 0


@pytest.mark.parametrize(
    "text,target,confidence,via",
    [
        ("pkg.mod.run", "a", "exact", None), ("'./pkg/mod/run'", "a", "probable", None), ("../x/tool.rs", "file:t", "probable", "file_stem"), ("./helpers.helper", "file:h", "probable", "file_stem"), ("@app", "b", "probable", "package_manifest"),
        ("./index", None, "ambiguous", None), ("one", "a1", "probable", None), ("zz", None, "unresolved", None), ("", None, "unresolved", None), (None, None, "unresolved", None),
    ],
)
def test_imports(spark, text, target, confidence, via):
    s = spark.createDataFrame(
        [("a", "function", "run", "pkg.mod.run", "pkg/mod.go", "python"), ("a1", "function", "one", "p.one", "p.py", "python"), ("b", "class", "Tool", "app.Tool", "app/t.rs", "python"), ("file:t", "file", "tool.rs", "x/tool.rs", "x/tool.rs", "python"), ("file:h", "file", "helpers.ts", "helpers.ts", "helpers.ts", "python"),
         ("file:1", "file", "index.ts", "a/index.ts", "a/index.ts", "python"), ("file:2", "file", "index.ts", "b/index.ts", "b/index.ts", "python")], SYMBOLS
    )
    aliases = spark.createDataFrame([("@app", "app.Tool")], "prefix string, replacement string")
    got = linking.imports(spark.createDataFrame([(1, text, "python")], "import_id int, text string, language string"), s, aliases).first()
    assert (got["target"], got["confidence"], got["resolved_via"]) == (target, confidence, via)


def test_dispatch_in_every_spelling(spark):
    s = spark.createDataFrame([("B", "Base", "m.Base", "class"), ("D", "Derived", "m::Derived", "class"), ("br", "run", "m.Base.run", "method"), ("dr", "run", "m.Derived.run", "method"), ("ds", "stop", "Derived.stop", "method")], "symbol_id string, name string, qualified_name string, kind string")
    inherits = spark.createDataFrame([("D", "B")], "child string, parent string")
    calls = spark.createDataFrame([("c1", "B", "run"), ("c2", "x", "m.Base.run"), ("c3", "x", "Base.run"), ("c4", "unresolved:p:Base", "stop"), ("c5", "dr", "Base.run"), ("c6", "x", "run"), ("c1", "B", "run")], "source_id string, target_id string, call_name string")
    assert rows(linking.dispatch(s, inherits, calls)) == [("c1", "dr", "run", "Base"), ("c2", "dr", "run", "Base"), ("c3", "dr", "run", "Base"), ("c4", "ds", "stop", "Base")]


def test_handlers_injections_documents_and_anchors(spark):
    s = spark.createDataFrame([(f"h{k}", "function", "many", f"m{k}.many", f"m{k}.py", "python") for k in range(7)] + [("one", "method", "only", "c.C.only", "src/c.py", "python"), ("cls", "class", "C", "c.C", "src/c.py", "python")], SYMBOLS)
    routes = spark.createDataFrame([("GET", "/a", "many"), ("GET", "/b", "only"), ("GET", "/c", "gone")], "method string, path string, handler string")
    got = rows(linking.handlers(routes, s))
    assert [g for g in got if g[0] != "route:GET:/a"] == [("route:GET:/b", "one", "exact"), ("route:GET:/c", "unresolved:gone", "unresolved")]
    assert [g[1:] for g in got if g[0] == "route:GET:/a"] == [(f"h{k}", "ambiguous") for k in range(5)]
    i = spark.createDataFrame([(1, "only", "C", "python"), (2, "many", "gone", "python"), (3, "nobody", "C", "python")], "injection_id int, consumer_name string, provider_name string, language string")
    got = rows(linking.injection_edges(i, s))
    assert got[0] == (1, "one", "cls", "probable") and {g[0] for g in got} == {1, 2} and len(got) == 6
    t = spark.createDataFrame([("d", "c.C.only"), ("d", "one"), ("d", " src/c.py :: C.only "), ("d", "src/c.py::C"), ("d", "src/c.py::none"), ("d", " "), ("d", "x::y")], "doc_id string, token string")
    found = {r["token"]: r["symbol_id"] for r in linking.document_links(t, s).collect()}
    assert found == {"c.C.only": "one", "one": "one", "src/c.py :: C.only": "one", "src/c.py::C": "cls", "src/c.py::none": None, "x::y": None}
    known = spark.createDataFrame([("cls", "doc:human:d"), ("h0", "doc:human:d"), ("h1", "doc:human:other")], "source_id string, target_id string")
    assert rows(linking.document_edges(linking.document_links(t, s), known)) == [("cls", "doc:human:d", "keep"), ("h0", "doc:human:d", "remove"), ("one", "doc:human:d", "add")]
    assert rows(linking.anchored_symbols(s, ["only"], ["m1.py"])) == [("h1",), ("one",)] and linking.anchored_symbols(s).count() == 0


def test_betweenness_takes_every_step_th_source(edge, symbol):
    from tests.test_graph import plain_betweenness

    rng = random.Random(4)
    names = [f"n{k:03d}" for k in range(41)]
    pairs = [(names[k], names[k + 1]) for k in range(30)] + [(names[rng.randrange(30, 41)], names[rng.randrange(41)]) for _ in range(25)]
    pairs = [(a, b) for a, b in pairs if a != b]
    s = symbol(*[(n, "f.py") for n in names])
    sources = sorted(names)[:: len(names) // 5][:5]
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(edge(*pairs), s, most_sources=5).collect()}
    want = plain_betweenness(pairs, sources)
    assert got == pytest.approx({n: want.get(n, 0.0) for n in names}, abs=1e-6)  # the path of 30 hops counts whole


def test_life_goes_on_for_over_100_hops(edge, symbol):
    names = ["main", *[f"s{i}" for i in range(105)]]
    s, e = symbol(*[(n, "src/m.py") for n in names]), edge(*zip(names, names[1:]))
    assert traverse.live(s, e, s).count() == len(names)


def test_scores_know_importers_and_loaders(edge, symbol):
    s = symbol(("main", "src/m.py"), ("_dead", "lib/a.py"), ("_alone", "lib2/b.py"), ("used", "lib/a.py"), ("loads", "plug/x.py"), ("late", "plug/y.py"))
    s = s.withColumns({"signature": F.lit("def f()"), "body": F.when(F.col("symbol_id") == "loads", "importlib.import_module(n)").otherwise("pass")})
    e = edge(("main", "used", "IMPORTS"), ("main", "used"))
    got = {r["symbol_id"]: r for r in graph.unused_candidates(s, e, s).collect()}
    assert got["_dead"]["score"] == 0.95 and got["_alone"]["score"] == 0.8 and got["late"]["score"] == 0.4 and not got["late"]["safe_to_delete"]


def test_community_of_a_seed(edge):
    e = edge(("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("a1", "b1", "DOCUMENTED_BY"))
    assert rows(overview.community_of(e, "a2")) == [("a1",), ("a2",), ("a3",), ("b1",)]  # b1's own friends are further than two hops away


def test_events_count_once_over_files(spark, tmp_path):
    one = spark.range(20).select(F.col("id").alias("event_id"), F.lit("signup").alias("event_type"), F.lit(1).cast("long").alias("user_id"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"), F.timestamp_seconds(F.col("id") * 86_400).cast("timestamp_ntz").alias("ts"))
    one.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    one.filter("event_id >= 15").unionByName(one.withColumn("event_id", F.col("event_id") + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = relay.relayed(spark, str(tmp_path), relay.audits)
    assert got.count() == 40 and got.select("key").distinct().count() == 40


@pytest.mark.parametrize("mass", [1, 3, 100])
def test_cochanges_with_mass_commits(spark, mass):
    rng = random.Random(mass)
    changes = [(c, f"f{rng.randrange(12)}") for c in range(14) for _ in range(rng.choice([1, 2, 6, 9]))]
    df = spark.createDataFrame(changes, "commit int, file string")
    by = {}
    for c, f in set(changes):
        by.setdefault(c, set()).add(f)
    want = {}
    for fs in by.values():
        for a in fs:
            for b in fs:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert rows(report.cochanged(df, 2, mass)) == sorted((*k, n) for k, n in want.items() if n >= 2)


@pytest.mark.parametrize("spans", [1, 3, 1000])
def test_rate_gate_in_spans(spark, spans):
    rng = random.Random(spans)
    events = [(k, rng.randrange(2), rng.randrange(900)) for k in range(300)]
    df = spark.createDataFrame(events, "event_id int, user_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["in_window"] for r in report.rate_gate(df, 3, 60, spans).collect()}
    assert got == {k: sum(v == u and t - 60 <= x <= t for _, v, x in events) for k, u, t in events}


def test_deliveries_and_quotes(spark):
    e = spark.createDataFrame([(1, "c", "i", "d"), (2, "x", None, "d"), (3, "c", "j", "e")], "event_id int, channel string, intent string, domain string")
    s = spark.createDataFrame([("all", "*", [], [], True, True), ("c", "c", ["i", "k"], [], True, True), ("e", "*", [], ["e"], True, True), ("off", "*", [], [], False, True)], "subscription_id string, channel string, intents array<string>, domains array<string>, active boolean, authorised boolean")
    assert rows(rules.delivered(e, s)) == [(1, "all"), (1, "c"), (2, "all"), (3, "all"), (3, "e")]
    names = spark.createDataFrame([("x", "a.py"), ("x", "b.py"), ("x", "b.py"), ("y", "a.py")], "name string, file_path string")
    c = spark.createDataFrame([("1", "x", "a.py"), ("2", "x", "z.py"), ("3", "y", "a.py")], "symbol_id string, name string, file_path string")
    assert rows(code.quoted_elsewhere(c, names)) == [("1", 1), ("2", 2)]


def test_pack_against_a_plain_loop(spark):
    rng = random.Random(6)
    data, score, spine = [], {}, {"s3", "s50"}
    for k in range(120):
        kind, name = ("method", f"n{k % 4}") if k % 3 == 0 else ("function", f"w{k}Handler" if k % 5 == 0 else f"w{k}")
        data.append((f"s{k}", name, f"q{k}.{name}", f"file{rng.randrange(6)}.py", kind, "sig" * rng.randrange(1, 8), "body " * rng.randrange(0, 60)))
        score[f"s{k}"] = rng.randrange(10) / 10
    s = spark.createDataFrame(data, "symbol_id string, name string, qualified_name string, file_path string, kind string, signature string, body string")
    seeds = spark.createDataFrame(list(score.items()), "symbol_id string, score double")
    for budget in (0, 300, 4000, 10**6):
        family = lambda r: "Handler" if r[1].endswith("Handler") else r[2].split(".")[-1] if r[4] == "method" else None
        order = sorted(data, key=lambda r: (r[0] not in spine, -score[r[0]], r[3], r[2]))
        by_file, used, want, members = {}, 0, [], [family(r) for r in data]
        for r in order:
            by_file.setdefault(r[3], []).append(r)
        for own in by_file.values():
            full_of = set()
            for r in own:
                g = family(r)
                large = g is not None and members.count(g) >= 3
                if r[0] in spine:
                    full = True
                elif large:
                    full = not any(x[0] in spine and family(x) == g for x in data) and g not in full_of
                else:
                    full = True
                full_of.add(g)
                body = r[6] if full else ""
                chunk = f"{r[5]}\n{body}".strip()
                if used + len(chunk) > budget and body.strip():
                    body, chunk, full = "", r[5], False
                if used + len(chunk) > budget and r[0] not in spine:
                    continue
                used += len(chunk)
                want.append((r[0], len(chunk)))
        got = explore.pack(s, seeds, spark.createDataFrame([(x,) for x in spine], "node string"), budget).orderBy("place").collect()
        assert [(r["symbol_id"], r["chars"]) for r in got] == want
    assert [explore.budget_for(n) for n in (1, 100, 500, 5000)] == [18_000, 24_000, 28_000, 32_000]


def test_fulltext_meets_words_one_letter_off(spark):
    s = spark.createDataFrame([("1", "handler", "a.handler", "", "x.py", ""), ("2", "handle", "b.handle", "handler", "y.py", ""), ("3", "cat", "c.cat", "", "z.py", "handlers")], "symbol_id string, name string, qualified_name string, signature string, file_path string, documentation string")
    assert [r["symbol_id"] for r in search.fulltext(s, "handler").collect()] == ["2", "1", "3"]  # name, qualified name and signature; name and qualified name; documentation
    assert [r["symbol_id"] for r in search.fulltext(s, "car").collect()] == []  # short words are exact
    assert search.fulltext(s, " ").count() == 0


def test_profiles_metadata_and_schemas(spark):
    a = spark.createDataFrame([("p", 1, "activate", "x", None), ("p", 2, "activate", "x", None), ("p", 3, "activate", "y", None), ("p", 4, "rollback", None, 5), ("p", 5, "rollback", None, 2), ("q", 1, "rollback", None, 1)], "project string, seq int, action string, profile string, steps int")
    assert rows(governance.active_profiles(a)) == [("p", governance.DEFAULT_PROFILE, 0), ("q", governance.DEFAULT_PROFILE, 0)]
    found = governance.schema_fingerprint(spark, {"a": a, "b": a.drop("seq")})
    wanted = governance.schema_fingerprint(spark, {"a": a.drop("steps"), "b": a.drop("seq"), "c": a})
    assert rows(governance.missing_tables(found, wanted)) == [("a", "differs"), ("c", "missing")]
    good = {f: "x" for f in governance.SYMBOL_REQUIRED} | {"confidence_score": "0.9"}
    m = spark.createDataFrame([(good, {"confidence_score": "0", "k": "v"}), ({**good, "file_id": " ", "confidence_score": "2"}, None), ({}, {})], "record map<string,string>, metadata map<string,string>")
    got = governance.merged_metadata(m, "symbol").collect()
    assert [len(r["errors"]) for r in got] == [0, 2, 6] and got[0]["metadata"] == {"k": "v", "confidence_score": "0.9"}


def test_documents_are_scanned_and_catalogued(spark, tmp_path):
    for name, body in {"docs/a.md": "---\ntitle: A\ntags: [x, 'y']\n---\n# A", "docs/sub/b.MD": "plain", "docs/c.txt": "no", "other/d.md": "---\ntitle: D\ntags: x\n---\n", "docs/node_modules/e.md": "no", "docs/empty.md": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    root = str(tmp_path)
    assert [r[0] for r in files.scan_documents(spark, root).select("relative_path").collect()] == ["docs/a.md", "other/d.md"]
    assert [r[0] for r in files.scan_documents(spark, root, ("docs/**/*",)).select("relative_path").collect()] == ["docs/a.md", "docs/sub/b.MD"]
    assert files.scan_documents(spark, root, ("none/**",)).count() == 0 and files.scan_documents(spark, root, most_files=1).count() == 1
    assert files.literal_directories(("docs/**/*.md", "./a/b/*.md", "docs/x.md")) == ("docs", "a/b") and files.literal_directories(("docs/*", "**/*.md")) == ()
    texts = files.scan_documents(spark, root, content=True).select(F.col("relative_path").alias("path"), F.col("content").cast("string").alias("text"))
    entries = docs.catalogue_entries(texts)
    assert [(r["path"], r["title"], r["tags"]) for r in entries.collect()] == [("docs/a.md", "A", ["x", "y"]), ("other/d.md", "D", ["x"])]
    assert [tuple(r) for r in docs.observed(entries).collect()] == [("tags", "x", 2), ("tags", "y", 1)]


def test_routes_and_injections_of_frameworks(spark):
    src = spark.createDataFrame(
        [("app/urls.py", "python", "urlpatterns = [path('a/', views.index), re_path(r'^b$', views.Home.as_view()), path('c/', include('c.urls'))]"), ("lib/other.py", "python", "path('x', y)"),
         ("web/app/(g)/users/[id]/route.ts", "typescript", "export async function GET(r) {}\nexport function POST(r) {}"), ("pages/api/users/index.js", "javascript", "export default function handler(req, res) {}"),
         ("n.ts", "typescript", "@Injectable()\nexport class Cats {\n constructor(private readonly db: Db, @Inject(X) public log: Log) {}\n}"), ("S.java", "java", "class Shop {\n @Autowired\n private Repo<Item> repo;\n}"),
         ("d.py", "python", "async def f(a: int, db: Annotated[S, Depends(get_db)], u=Depends(auth.user)):\n    pass")], "file_path string, language string, source string"
    )
    assert rows(extract.routes(src)) == [("app/urls.py", "ANY", "/^b$", "Home"), ("app/urls.py", "ANY", "/a/", "index"), ("pages/api/users/index.js", "ANY", "/api/users", "handler"), ("web/app/(g)/users/[id]/route.ts", "GET", "/users/[id]", "GET"), ("web/app/(g)/users/[id]/route.ts", "POST", "/users/[id]", "POST")]
    assert rows(extract.injections(src)) == [("S.java", "repo", "Repo", "Shop"), ("d.py", "db", "get_db", "f"), ("d.py", "u", "auth.user", "f"), ("n.ts", "db", "Db", "Cats"), ("n.ts", "log", "Log", "Cats")]


def test_aliases_of_packages(spark):
    m = spark.createDataFrame(
        [("pyproject.toml", '[project]\nname = "my-lib"\n'), ("go.mod", "module ex.com/m\nreplace ex.com/a => ../local/a\nreplace ex.com/b => ex.com/c v1\n"), ("c/Cargo.toml", '[package]\nname = "my-crate"\n[dependencies]\nfoo-x = { path = "crates/foo" }\n'),
         ("package.json", '{"name": "@o/pkg", "imports": {"#u/*": "./src/u.ts"}, "dependencies": {"l": "file:../l2", "r": "^1"}}'), ("tsconfig.json", '{ // note\n "compilerOptions": {"paths": {"@app/*": ["./src/app/*"]}}}'), ("bad/package.json", "{"), ("x.txt", "module no")], "file_path string, source string"
    )
    assert dict(rows(extract.package_aliases(m))) == {"my-lib": "my_lib", "my_lib": "my_lib", "ex.com/m": "ex.com/m", "ex.com/a": "a", "ex.com/b": "ex.com/c", "my-crate": "my_crate", "my_crate": "my_crate", "foo-x": "foo", "foo_x": "foo", "@o/pkg": "o.pkg", "#u": "u", "l": "l2", "@app": "src/app"}


def test_pushes(spark):
    s = spark.createDataFrame([("a.py", "def a(): pass"), ("b.py", "def b2(): pass"), ("bad.py", "def (")], "file_path string, source string")
    known = s.filter("file_path = 'a.py'").select("file_path", F.sha2("source", 256).alias("content_hash")).union(spark.createDataFrame([("b.py", "old"), ("c.py", "kept")], "file_path string, content_hash string"))
    old = extract.python_symbols(spark.createDataFrame([("a.py", "def a_old(): pass"), ("b.py", "def b1(): pass"), ("c.py", "def c(): pass")], "file_path string, source string"))
    symbols_, hashes = ingest.pushed(s, known, old)
    assert rows(symbols_.filter("kind = 'function'"), "file_path", "name") == [("a.py", "a_old"), ("b.py", "b2"), ("c.py", "c")]
    assert {r["file_path"] for r in hashes.collect()} == {"a.py", "b.py", "bad.py", "c.py"}


def test_prefixes_are_joined_anew(spark):
    refs = spark.createDataFrame([("@app/x/y",), ("@app",), ("@apple",), ("./@app/x",)], "ref string")
    p = spark.createDataFrame([("@app", "src")], "prefix string, replacement string")
    assert dict(rows(resolve.rewritten(refs, p, joined="/"))) == {"@app/x/y": "src/x/y", "@app": "src", "@apple": "@apple", "./@app/x": "./@app/x"}


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from skein.functions import lineage

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        lineage.shared_folder(Session)


def test_tables_are_written_once(spark, tmp_path):
    from skein.functions import lineage

    made = []
    at = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(at)
    build = lambda: made.append(1) or spark.read.parquet(at).withColumn("x", F.lit(1))
    assert [lineage.stored(spark, "t", [at], build).count() for _ in range(2)] == [3, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(at)
    assert lineage.stored(spark, "t", [at], build).count() == 5 and len(made) == 2


def test_linking_broadcasts_nothing_that_grows(spark, sf_dir, monkeypatch):
    plans = []
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ingest, "checkpointed", lambda df: plans.append(plan_of(df)) or lineage.checkpointed(df))
    plans.append(plan_of(ingest.u07_linked(spark, sf_dir)))
    assert len(plans) == 3 and not any("Broadcast" in p for p in plans)  # sizes are guessed before a query runs: its parsed texts are larger than the file of their keys
