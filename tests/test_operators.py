import re
import subprocess

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.functions import text as tx
from lodeworks.functions import vectors
from lodeworks.operators import architecture as arch
from lodeworks.operators import chunking, extraction, graph, search
from lodeworks.sources import files, git_log, registry, schema, snapshot, star
from lodeworks.streaming import watcher


def symbols(spark, names):
    return spark.createDataFrame([(n, n, "Class", f"/src/{n}.cs", 1, 10, n, None, None) for n in names], schema.SYMBOLS)


def edges(spark, pairs, kind="References"):
    return spark.createDataFrame([(f"{a}->{b}:{kind}", a, b, kind) for a, b in pairs], schema.RELATIONSHIPS)


def start(spark, x):
    return spark.createDataFrame([(x,)], "id string")


@pytest.mark.parametrize(
    ("pairs", "x", "direction", "depth", "want"),
    [
        ([("A", "L"), ("A", "C")], "A", "upstream", 1, {"L", "C"}),
        ([("S1", "T"), ("S2", "T")], "T", "downstream", 1, {"S1", "S2"}),
        ([("A", "B"), ("B", "A")], "A", "upstream", 3, {"B", "A"}),
        ([("R", "L1"), ("L1", "L2"), ("L2", "L3"), ("L3", "L4")], "R", "upstream", 5, {"L1", "L2", "L3"}),
        ([("A", "B")], "Z", "both", 2, set()),
    ],
)
def test_trace(spark, pairs, x, direction, depth, want):
    got = graph.trace(edges(spark, pairs), start(spark, x), direction, depth).collect()
    assert {r["node"] for r in got} == want and len(got) == len({(r["edge_id"], r["direction"]) for r in got})


def test_trace_equals_breadth_first(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 30, (70, 2))})
    got = {(r["edge_id"], r["level"]) for r in graph.trace(edges(spark, pairs), start(spark, "n0"), "upstream", 3).collect()}
    want, frontier, seen = set(), {"n0"}, {"n0"}
    for level in (1, 2, 3):
        step = [(a, b) for a, b in pairs if a in frontier]
        want |= {(f"{a}->{b}:References", level) for a, b in step}
        frontier = {b for _, b in step} - seen
        seen |= frontier
    assert got == want


def breadth_first(pairs, starts, depth):
    want, frontier, seen = set(), set(starts), set(starts)
    for level in range(1, depth + 1):
        step = [(a, b) for a, b in pairs if a in frontier]
        want |= {(f"{a}->{b}:References", level) for a, b in step}
        frontier = {b for _, b in step} - seen
        seen |= frontier
    return want


@pytest.mark.parametrize("words", [64, 2**12])
def test_trace_of_large_frontiers(spark, monkeypatch, words):
    """Through the hash filter, full to the brim or hardly used: no edge more, none less; null ends match nothing."""
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(graph, "MOST_WORDS", words)
    rng = np.random.default_rng(2)
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 4000, (6000, 2))})
    starts = [f"n{i}" for i in range(0, 4000, 4)]
    e = edges(spark, pairs).union(spark.createDataFrame([("x", None, "n0", "References"), ("y", "n0", None, "References")], "id string, source_symbol_id string, target_symbol_id string, relationship_type string"))
    got = graph.trace(e, spark.createDataFrame([(x,) for x in starts], "id string"), "upstream", 3).collect()
    assert {(r["edge_id"], r["level"]) for r in got} == breadth_first(pairs, starts, 3) | {("y", 1)} and len(got) == len({r["edge_id"] for r in got})


def test_trace_both_computes_its_starts_once(spark):
    met = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            met.add(len(f))
            yield f

    starts = start(spark, "A").mapInPandas(seen, "id string")
    got = graph.trace(edges(spark, [("A", "B"), ("B", "C"), ("D", "A"), ("C", "D")]), starts, "both", 2).collect()
    assert {(r["edge_id"][:4], r["level"], r["direction"]) for r in got} == {("A->B", 1, "upstream"), ("B->C", 2, "upstream"), ("D->A", 1, "downstream"), ("C->D", 2, "downstream")}
    assert met.value == 1


@pytest.mark.parametrize("few", [100_000, 0])
def test_trace_shuffles_matching_edges_alone(spark, sf_dir, monkeypatch, few):
    """The frontier meets the line items below the DISTINCT that makes edges of them."""
    monkeypatch.setattr(graph, "FEW", few, raising=False)
    starts = spark.createDataFrame([("o:1",), ("o:2",)], "id string")
    plan = graph.trace(star.relationships(spark, sf_dir), starts, "upstream", 1)._jdf.queryExecution().executedPlan().toString()
    scans = [m.start() for m in re.finditer(r"FileScan parquet \[l_orderkey", plan)]
    assert len(scans) == 2 and all(plan.rindex("LeftSemi", 0, at) > plan.rindex("Exchange hashpartitioning", 0, at) for at in scans)


def test_test_coverage_prefers_stored_edges(spark):
    s = symbols(spark, ["A", "ATests", "B", "BTest"])
    e = edges(spark, [("ATests", "A"), ("BTest", "B")]).unionByName(edges(spark, [("B", "A")], "TestCoverage"))
    got = graph.test_coverage(e, s, spark.createDataFrame([("A",), ("B",)], "id string")).collect()
    assert {(r["start"], r["node"]) for r in got} == {("A", "B"), ("B", "BTest")}


def test_clusters(spark):
    m = spark.createDataFrame([("s1", "src"), ("s2", "lib"), ("s3", "lib")], "id string, component string")
    matrix = arch.coupling_matrix(edges(spark, [("s1", "s2"), ("s1", "s3"), ("s2", "s1")]), m)
    assert arch.coupling_pairs(matrix).first()["coupling"] == 1.0
    row = arch.cluster_cohesion(arch.clusters(m, arch.coupling_pairs(matrix), 0.3), matrix).collect()
    assert [(r["name"], r["cohesion"]) for r in row] == [("lib+src", 1.0)]
    alone = spark.createDataFrame([("a",), ("b",), ("c",)], "component string")
    none = spark.createDataFrame([], "a string, b string, coupling double")
    assert arch.clusters(alone, none, 0.0).select("cluster").distinct().count() == 3


def test_similarity_equals_duckdb(spark, sf_dir, duck):
    """To the last bit of a FLOAT for every vector, so that rounding and ties agree too; extreme lengths fall back to double."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {r["vec_id"]: r["similarity"] for r in search.scored(v, v.where("vec_id = 0").first()["embedding"]).collect()}
    want = dict(duck.execute("SELECT vec_id, list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)) FROM embeddings").fetchall())
    assert got == want
    odd = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1e-30, 0.0]), (2, [0.0, 0.0]), (3, None)], "id int, embedding array<float>")
    assert [round(r["similarity"], 6) for r in search.scored(odd, [1.0, 1.0]).orderBy("id").collect()] == [0.707107, 0.707107, 0.0, 0.0]


def test_vectors(spark):
    e0 = [1.0] + [0.0] * 7
    df = spark.createDataFrame([("same", e0), ("opposite", [-x for x in e0]), ("other", [0.0, 1.0] + [0.0] * 6), ("none", None)], "id string, embedding array<float>")
    got = search.top_k(df, [0.9 * x for x in e0], 3).collect()
    assert got[0]["id"] == "same" and got[0]["similarity"] > 0.99 and len(got) == 3
    assert [r["id"] for r in search.top_k(df, e0, 9, min_similarity=0.5).collect()] == ["same"]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        search.top_k(df, [1.0, 0.0, 0.0], 1).collect()
    v = vectors.embed("hello world")
    assert abs(float(np.linalg.norm(v)) - 1) < 1e-5 and not vectors.embed("").any() and (vectors.embed("hello world") == v).all()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aé€😀 "), max_size=12), min_size=1, max_size=5), st.integers(4, 12))
def test_truncate_utf8(spark, texts, most):
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.truncate_utf8(F.col("t"), most)).collect()]
    assert got == [t.encode()[:most].decode("utf-8", "ignore") for t in texts]


@pytest.mark.parametrize(
    ("rules", "path", "want"),
    [
        ("bin/", "bin/a.cs", True), ("bin/", "x/bin/a.cs", True), ("bin/", "bin.cs", False), ("*.txt", "a/b.txt", True), ("/a.txt", "b/a.txt", False), ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/b", True),
        ("*.txt\n!keep.txt", "keep.txt", False), ("!keep.txt\n*.txt", "keep.txt", True), ("# no\n\n", "no", False), ("file[0-9].c", "file7.c", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ],
)
def test_ignore(spark, rules, path, want):
    row = spark.createDataFrame([(path,)], "p string").select(tx.IgnoreRules(rules).matches(F.col("p"))).first()
    assert row[0] is want


def test_like_compat(spark):
    df = spark.createDataFrame([("MyClass",), ("Helper",), (None,)], "n string")
    count = lambda c: df.where(c).count()
    assert count(tx.like_compat(F.col("n"), "My%")) == 1 and count(tx.like_compat(F.col("n"), "%er")) == 1 and count(tx.like_compat(F.col("n"), "%l%")) == 2
    assert count(tx.like_compat(F.col("n"), "elp")) == 1 and count(tx.like_compat(F.col("n"), "elp", "equals")) == 0
    assert count(tx.not_equal_compat(F.col("n"), "Helper")) == 2


CS = """using System;
namespace Demo;

/// <summary>Handles auth</summary>
public class AuthService : BaseService, IAuth
{
    private readonly Store store;
    public string Name { get; set; }
    public event Handler Changed;
    public AuthService(Store store) { this.store = store; }
    public bool Login(string user)
    {
        var token = new Token();
        return Check(user);
    }
}
public enum Mode { A, B }
"""


def test_extraction_of_csharp():
    got, refs = extraction.extract(CS, "CSharp")
    kinds = {(s["full_name"], s["kind"]) for s in got}
    assert {("Demo.AuthService", "Class"), ("Demo.AuthService.Login", "Method"), ("Demo.AuthService.Name", "Property"), ("Demo.AuthService.Changed", "Event"), ("Demo.AuthService.store", "Field"), ("Demo.Mode", "Enum")} <= kinds or {("AuthService", "Class"), ("AuthService.Login", "Method"), ("AuthService.Name", "Property"), ("AuthService.Changed", "Event"), ("AuthService.store", "Field"), ("Mode", "Enum")} <= kinds
    auth = next(s for s in got if s["name"] == "AuthService" and s["kind"] == "Class")
    assert auth["documentation"] == "Handles auth" and auth["line_end"] == 16
    assert {(r["target"], r["relationship_type"]) for r in refs} >= {("BaseService", "Inherits"), ("IAuth", "Implements"), ("Token", "References"), ("Check", "Calls")}


def test_extraction_of_other_languages():
    py, refs = extraction.extract("class A(B):\n    '''Doc'''\n    def m(self):\n        run()\nX = 1\n", "Python")
    assert [(s["full_name"], s["kind"]) for s in py] == [("A", "Class"), ("A.m", "Method"), ("X", "Variable")] and ("B", "Inherits") in {(r["target"], r["relationship_type"]) for r in refs}
    go, _ = extraction.extract("type S struct {\n}\nfunc (s *S) Run() error {\n}\nfunc main() {\n}\n", "Go")
    assert {(s["name"], s["kind"]) for s in go} == {("S", "Struct"), ("Run", "Method"), ("main", "Function")}
    rs, refs = extraction.extract("pub trait T {}\npub struct P {}\nimpl T for P {\n    fn go(&self) -> u8 { 1 }\n}\n", "Rust")
    assert {s["name"] for s in rs} >= {"T", "P", "go"} and ("T", "Implements") in {(r["target"], r["relationship_type"]) for r in refs}
    ts, _ = extraction.extract("export interface I {\n}\nexport class C implements I {\n  open(): void {\n  }\n}\n", "TypeScript")
    assert {(s["name"], s["kind"]) for s in ts} >= {("I", "Interface"), ("C", "Class"), ("open", "Method")}
    _, refs = extraction.extract("type Base struct {\n}\ntype S struct {\n    *pkg.Base\n    n int\n}\nfunc (s *S) Run(a Arg) Result {\n}\n", "Go")
    assert {(r["source"], r["target"], r["relationship_type"]) for r in refs} >= {("S", "Base", "Inherits"), ("S.Run", "Arg", "References"), ("S.Run", "Result", "References")}
    assert extraction.extract("def broken(:", "Python") == ([], []) and extraction.extract(None, "Go") == ([], [])
    assert extraction.extract('<p id="x">', "Html")[0][0]["name"] == "x"


def test_extraction_spreads_files_of_one_split(spark):
    f = spark.range(200).coalesce(1).select(F.concat(F.lit("a"), "id", F.lit(".py")).alias("file_path"), F.lit("def f():\n    g()\n").alias("content"), F.lit("Python").alias("language"))
    for found in (extraction.extract_symbols(f), extraction.extract_references(f)):
        rows = found.select("file_path", F.spark_partition_id().alias("task")).collect()
        assert len(rows) == 200 and len({r["task"] for r in rows}) >= spark.sparkContext.defaultParallelism


def test_chunks(spark):
    f = spark.createDataFrame([("a.cs", CS, "CSharp"), ("n.txt", "note\nmore", "Text"), ("blank.txt", "  ", "Text")], "file_path string, content string, language string")
    s = extraction.with_symbol_ids(extraction.extract_symbols(f.where("language = 'CSharp'")))
    got = chunking.symbol_chunks(f, s).collect()
    assert chunking.symbol_chunks(f, s).select("id").distinct().count() == len(got)
    by = {r["metadata"]["scope"] for r in got}
    assert by == {"type", "member", "file"}
    assert next(r for r in got if "class AuthService" in r["content"] and r["metadata"]["scope"] == "type")["content"].startswith("using System;")
    assert all(r["content"].startswith("// Parent: ") for r in got if r["metadata"]["scope"] == "member")


def test_crawl_index_and_watch(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"src/a.py": "class A:\n    def run(self):\n        helper()\n", "src/b.py": "def helper():\n    pass\n", "bin/c.py": "def no(): pass\n", ".git/d.py": "x = 1\n", "n.md": "hi"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    found = files.crawl(spark, str(root), ["py"], "bin/")
    assert {r["file_path"]: r["language"] for r in found.collect()} == {"src/a.py": "Python", "src/b.py": "Python"}
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/store")
    watcher.index_files(found, store)
    assert {r["full_name"] for r in store.read("symbols").collect()} == {"A", "A.run", "helper"}
    assert store.read("relationships").count() == 1
    changes = spark.createDataFrame([("src/b.py", 1, False, "def helper():\n    return 1\n\ndef more():\n    helper()\n", "Python"), ("src/b.py", 0, True, None, "Python")], "file_path string, seq long, deleted boolean, content string, language string")
    watcher.apply_changes(changes, store)
    assert {r["full_name"] for r in store.read("symbols").collect()} == {"A", "A.run", "helper", "more"}
    edges_now = store.read("relationships").collect()
    ids = {r["id"]: r["full_name"] for r in store.read("symbols").collect()}
    assert {(ids[e["source_symbol_id"]], ids[e["target_symbol_id"]]) for e in edges_now} == {("A.run", "helper"), ("more", "helper")}
    watcher.apply_changes(spark.createDataFrame([("src/b.py", 2, True, None, "Python")], changes.schema), store)
    assert {r["full_name"] for r in store.read("symbols").collect()} == {"A", "A.run"} and store.read("relationships").count() == 0
    store.delete_files(["src/a.py"])
    assert store.read("symbols").count() == 0
    store.vacuum()
    store.clear()
    assert store.read("chunks").count() == 0


def test_crawl_reads_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "b.py").write_text("y = '\ufffd'\n")
    assert {r["file_path"]: r["content"] for r in files.crawl(spark, str(tmp_path), ["py"]).collect()} == {"a.py": "x = ''\n", "b.py": "y = '\ufffd'\n"}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    def put(rows, name):
        spark.createDataFrame(rows, "k int, seq int, v string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{name}")

    def drain():
        source = spark.readStream.schema("k int, seq int, v string").parquet(f"file://{tmp_path}/in/*")
        return {r["k"]: r["v"] for r in watcher.upsert_stream(spark, source, "k", ["seq"], ["v"], f"file://{tmp_path}/table", f"file://{tmp_path}/progress").collect()}

    put([(1, 1, "a"), (2, 1, "b")], "one")
    assert drain() == {1: "a", 2: "b"} == drain()
    put([(3, 1, "c"), (1, 0, "late"), (2, 2, "new")], "two")
    assert drain() == {1: "a", 2: "new", 3: "c"}


def test_components_of_build_files(spark):
    paths = ["go.mod", "main.go", "lib/a.csproj", "lib/package.json", "lib/x/y.cs", "web/package.json", "web/app/i.ts"]
    found = arch.discover_components(spark.createDataFrame([(p,) for p in paths], "file_path string"))
    assert {(r["prefix"], r["build_file"], r["component"]) for r in found.collect()} == {("", "go.mod", "root"), ("lib", "a.csproj", "lib"), ("web", "package.json", "web")}
    rows = spark.createDataFrame([("lib/x/y.cs",), ("main.go",), ("web/app/i.ts",)], "file_path string")
    assert {r["file_path"]: r["component"] for r in arch.with_component(rows, found).collect()} == {"lib/x/y.cs": "lib", "main.go": "root", "web/app/i.ts": "web"}
    assert {r["component"] for r in arch.with_component(rows, found.where("prefix = 'lib'")).collect()} == {"lib", "main.go", "web"}


def test_host(spark, tmp_path):
    """From a configured path to answers: index with embeddings, components, rescan, failed clones."""
    from lodeworks.plans.hosting import Host

    root = tmp_path / "repo"
    for name, text in {"auth/pyproject.toml": "x", "auth/a.py": "class AuthService:\n    def login(self):\n        connect()\n", "db/b.py": "def connect():\n    return 'database connection'\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    host = Host(spark, registry.Registry(), f"file://{tmp_path}/stores", str(tmp_path / "clones"), dim=64)
    assert host.bootstrap({"One": str(root), "Two": f"file://{tmp_path}/nothing"}) == ["one"]
    assert host.enqueue("One").result() and host.registry.get("one").index_status == "Done"
    host._under_way.add("one")
    assert host.enqueue("ONE") is None
    host._under_way.clear()
    tools = host.repositories["one"]
    assert tools.semantic_search("database connection", 1)[0]["symbol_name"] == "connect"
    got = tools.sql_query("SELECT FilePath FROM ChunkRecord WHERE Content LIKE '%database connection%' ORDER BY Similarity LIMIT 1")
    assert [r["FilePath"] for r in got["rows"]] == ["db/b.py"], got
    assert {r["component"] for r in tools.get_architecture_overview()["components"]} == {"auth"}
    (root / "db/b.py").write_text("def other():\n    pass\n")
    old = tools.symbols
    assert tools.rescan_repository()["symbols"] == 3 and {r["name"] for r in tools.symbols.collect()} == {"AuthService", "login", "other"}
    assert old.count() == 3
    assert not host.enqueue("Two").result() and host.registry.get("two").clone_status == "Failed"


def test_upsert(spark):
    current = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, n int")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, n int")
    assert {(r["id"], r["v"]) for r in snapshot.upsert(current, batch, "id", "n").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    assert snapshot.delete_where_in(current, "v", []).count() == 2 and snapshot.delete_where_in(current, "v", ["a"]).count() == 1
    with pytest.raises(Exception, match="dimensions"):
        snapshot.check_dimension(spark.createDataFrame([([1.0],)], "embedding array<float>"), 2).collect()


def test_git_log(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=ann", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True).stdout
    run("init", "-q")
    for i in range(2):
        (tmp_path / "f.txt").write_text(str(i))
        run("add", ".")
        run("commit", "-qm", f"change {i}")
    got = git_log.read_git(spark, str(tmp_path))
    assert [(r["author"], r["path"]) for r in got.collect()] == [("ann", "f.txt")] * 2
    exported = tmp_path / "log.txt"
    exported.write_text(run("log", git_log.FORMAT, "--date=short", "--name-only"))
    assert {tuple(r) for r in git_log.read_log(spark, f"file://{exported}").collect()} == {tuple(r) for r in got.collect()}
    assert git_log.read_git(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "@types").mkdir()
    for name in ("@types/a b.ts", "é.txt"):
        (tmp_path / name).write_text("x")
    run("add", ".")
    run("commit", "-qm", "@tab\there")
    want = {("@tab\there", "@types/a b.ts"), ("@tab\there", "é.txt")}
    exported.write_text(run("-c", "core.quotePath=false", "log", git_log.FORMAT, "--date=short", "--name-only"))
    for found in (git_log.read_git(spark, str(tmp_path)), git_log.read_log(spark, f"file://{exported}")):
        assert {(r["subject"], r["path"]) for r in found.collect()} >= want and found.count() == 4 and found.where("date IS NULL").count() == 0


def test_registry(spark, tmp_path):
    r = registry.Registry(str(tmp_path / "repos.jsonl"))
    r.add(registry.Repo("One", "/one"))
    with pytest.raises(ValueError, match="exists"):
        r.add(registry.Repo("one", "/other"))
    r.update("ONE", index_status="Done")
    again = registry.Registry(str(tmp_path / "repos.jsonl"))
    assert again.get("one").last_indexed_at and again.frame(spark).count() == 1 and again.delete("One") and again.list() == []
