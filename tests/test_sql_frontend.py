import pytest

from lodeworks.functions import vectors
from lodeworks.plans.frontend import Engine, Rejected, respell
from lodeworks.plans.tools import Tools
from lodeworks.sources import schema

S = [
    ("s:MyClass", "MyClass", "Class", "/src/MyClass.cs", 1, 50, "MyClass", "public", None),
    ("s:MyMethod", "MyMethod", "Method", "/src/MyClass.cs", 10, 20, "MyClass.MyMethod", "public", None),
    ("s:Helper", "Helper", "Class", "/src/Helper.cs", 1, 30, "Helper", "internal", None),
    ("s:IOld", "IOld", "Interface", "/src/IOld.cs", 1, 10, "IOld", "public", None),
    ("s:_private", "_private", "Field", "/src/MyClass.cs", 5, 5, "MyClass._private", "private", None),
]
R = [("r1", "s:IOld", "s:MyClass", "References"), ("r2", "s:Helper", "s:MyClass", "References"), ("r3", "s:IOld", "s:Helper", "References")]
DIM = 128


@pytest.fixture(scope="module")
def engine(spark):
    chunks = [(i, s, f, t, "CSharp", 1, 9, {"scope": "type"}, [float(x) for x in vectors.embed(t, DIM)]) for i, s, f, t in [("c:auth", "s:MyClass", "/src/Auth.cs", "public class AuthService handles authentication"), ("c:db", "s:Helper", "/src/Db.cs", "public class DbService manages database connection")]]
    return Engine(spark, {"symbols": spark.createDataFrame(S, schema.SYMBOLS), "relationships": spark.createDataFrame(R, schema.RELATIONSHIPS), "chunks": spark.createDataFrame(chunks, schema.CHUNKS)}, dim=DIM, compat=True)


def values(engine, sql):
    r = engine.query(sql)
    assert r.success, r.error
    return [tuple(row.values()) for row in r.rows]


def test_filter_group_having(engine):
    assert values(engine, "SELECT Name FROM SymbolRecord WHERE Kind = 'Class' ORDER BY 1") == [("Helper",), ("MyClass",)]
    got = values(engine, "SELECT FilePath, COUNT(*) AS cnt FROM SymbolRecord GROUP BY FilePath ORDER BY cnt DESC, FilePath")
    assert got == [("/src/MyClass.cs", 3), ("/src/Helper.cs", 1), ("/src/IOld.cs", 1)]
    for having in ("COUNT(*) > 1", "cnt > 1"):
        assert values(engine, f"SELECT FilePath, COUNT(*) AS cnt FROM SymbolRecord GROUP BY FilePath HAVING {having}") == [("/src/MyClass.cs", 3)]


def test_distinct_order_limit(engine):
    assert [k for (k,) in values(engine, "SELECT DISTINCT Kind FROM SymbolRecord ORDER BY Kind")] == ["Class", "Field", "Interface", "Method"]
    assert len(values(engine, "SELECT DISTINCT Kind, FilePath FROM SymbolRecord")) == 5
    assert values(engine, "SELECT Name FROM SymbolRecord LIMIT 0") == []
    assert [n for (n,) in values(engine, "SELECT Name FROM SymbolRecord ORDER BY LineEnd")] == ["_private", "IOld", "MyMethod", "Helper", "MyClass"]


def test_expressions_and_names(engine):
    r = engine.query("SELECT LineEnd - LineStart FROM SymbolRecord WHERE Name = 'MyClass'")
    assert r.columns == ["LineEnd - LineStart"] and r.rows[0]["LineEnd - LineStart"] == 49
    assert values(engine, "SELECT (LineEnd + LineStart) AS a, (LineEnd - LineStart) * 2 AS b FROM SymbolRecord WHERE Name = 'MyClass'") == [(51, 98)]
    assert engine.query("SELECT s.Name FROM SymbolRecord s").columns == ["s.Name"]
    assert values(engine, "SELECT Name || ':' || Kind AS l FROM SymbolRecord WHERE Kind = 'Class' ORDER BY l") == [("Helper:Class",), ("MyClass:Class",)]
    assert values(engine, "SELECT CAST(LineStart AS TEXT) AS t FROM SymbolRecord WHERE Name = '_private'") == [("5",)]
    assert values(engine, "SELECT ISNULL(Documentation, 'none') AS d FROM SymbolRecord WHERE Name = 'IOld'") == [("none",)]


def test_joins(engine):
    want = [("MyClass", 2), ("Helper", 1)]
    for sql in ("FROM SymbolRecord s, RelationshipRecord r WHERE r.TargetSymbolId = s.Id", "FROM RelationshipRecord r JOIN SymbolRecord s ON r.TargetSymbolId = s.Id"):
        assert values(engine, f"SELECT s.Name, COUNT(*) AS n {sql} GROUP BY s.Name ORDER BY n DESC") == want
    assert len(values(engine, "SELECT t.Name, s.Name, r.RelationshipType FROM RelationshipRecord r JOIN SymbolRecord t ON r.TargetSymbolId = t.Id JOIN SymbolRecord s ON r.SourceSymbolId = s.Id")) == 3
    left = values(engine, "SELECT s.Name, COUNT(r.Id) AS n FROM SymbolRecord s LEFT JOIN RelationshipRecord r ON r.TargetSymbolId = s.Id GROUP BY s.Name ORDER BY s.Name")
    assert ("IOld", 0) in left and len(left) == 5


def test_cte_shadows_a_table(engine):
    assert values(engine, "WITH SymbolRecord AS (SELECT 'x' AS Name FROM RelationshipRecord LIMIT 1) SELECT Name FROM SymbolRecord") == [("x",)]


@pytest.mark.parametrize(
    "sql",
    [
        "", "DELETE FROM SymbolRecord", "SELECT 1; SELECT 2", "SELECT 1", "SELECT Name FROM SymbolRecord UNION SELECT Name FROM SymbolRecord", "SELECT * FROM (SELECT Name FROM SymbolRecord)",
        "WITH RECURSIVE a AS (SELECT 1 AS n) SELECT n FROM a", "SELECT Name FROM NoSuchTable", "SELECT NoFunction(Name) FROM SymbolRecord", "SELEC Name", "WITH a AS (SELECT Name FROM SymbolRecord), a AS (SELECT Name FROM SymbolRecord) SELECT * FROM a",
        "SELECT s.Id FROM ChunkRecord s, SymbolRecord t WHERE s.Content LIKE '%x%' ORDER BY Similarity", "SELECT DISTINCT FilePath FROM ChunkRecord WHERE Content LIKE '%x%' ORDER BY Similarity", "SELECT Name FROM SymbolRecord WHERE Name LIKE '%x%' ORDER BY Similarity",
    ],
)
def test_refused(engine, sql):
    r = engine.query(sql)
    assert not r.success and r.error


def test_order_by_similarity(engine):
    r = engine.query("SELECT FilePath FROM ChunkRecord WHERE Content LIKE '%authentication service%' ORDER BY Similarity LIMIT 2")
    assert r.success, r.error
    assert [x["FilePath"] for x in r.rows] == ["/src/Auth.cs", "/src/Db.cs"] and r.rows[0]["__score"] > r.rows[1]["__score"]
    r = engine.query("WITH c AS (SELECT Id, FilePath FROM ChunkRecord) SELECT FilePath FROM c WHERE Content LIKE '%database%' ORDER BY Similarity LIMIT 1")
    assert r.success and r.rows[0]["FilePath"] == "/src/Db.cs", r.error


def test_default_mode_is_a_superset(spark, engine):
    free = Engine(spark, engine.tables, dim=DIM)
    assert free.query("SELECT Name FROM SymbolRecord UNION ALL SELECT Name FROM SymbolRecord").row_count == 10
    with pytest.raises(Rejected):
        free.frame("DROP TABLE x")


def test_division_by_zero_is_null(spark, engine):
    assert values(engine, "SELECT 7 / (LineStart - LineStart) AS a, 7 % (LineStart - 1) AS b FROM SymbolRecord WHERE Name = 'MyClass'") == [(None, None)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_compat_predicates(spark, engine):
    assert [n for (n,) in values(engine, "SELECT Name FROM SymbolRecord WHERE Name LIKE 'Method'")] == ["MyMethod"]
    assert [n for (n,) in values(engine, "SELECT Name FROM SymbolRecord WHERE Name LIKE '_%'")] == ["_private"]
    assert len(values(engine, "SELECT Name FROM SymbolRecord WHERE Documentation <> 'x'")) == 5
    free = Engine(spark, engine.tables, dim=DIM)
    assert free.query("SELECT Name FROM SymbolRecord WHERE Name LIKE '_%'").row_count == 5
    assert free.query("SELECT Name FROM SymbolRecord WHERE Documentation <> 'x'").row_count == 0


@pytest.mark.parametrize(
    "source",
    ["SymbolRecord p JOIN SymbolRecord c ON c.FullName LIKE p.FullName || '.%'", "SymbolRecord p, SymbolRecord c WHERE c.FullName LIKE p.FullName || '.%' AND p.Kind = 'Class'"],
)
def test_like_prefix_join_is_an_equi_join(engine, source):
    sql = f"SELECT p.Name AS parent, c.Name AS child FROM {source}"
    assert sorted(values(engine, sql)) == [("MyClass", "MyMethod"), ("MyClass", "_private")]
    plan = engine.frame(sql)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    left = "SELECT p.Name AS parent, COUNT(c.Id) AS n FROM SymbolRecord p LEFT JOIN SymbolRecord c ON c.FullName LIKE p.FullName || '.%' GROUP BY p.Name ORDER BY n DESC LIMIT 1"
    assert values(engine, left) == [("MyClass", 2)]
    assert "__prefix" not in engine.frame(f"SELECT * FROM {source}").columns


def test_engines_do_not_see_each_other(spark, engine):
    other = Engine(spark, {"symbols": engine.tables["symbols"].where("kind = 'Class'")})
    a, b = engine.frame("SELECT Name FROM SymbolRecord"), other.frame("SELECT Name FROM SymbolRecord")
    assert (a.count(), b.count()) == (5, 2)
    assert not other.query("SELECT Id FROM ChunkRecord").success
    spark.range(3).createOrReplaceTempView("symbols")
    assert engine.query("SELECT name FROM symbols").row_count == 5 and spark.table("symbols").count() == 3
    spark.catalog.dropTempView("symbols")


def test_bounds_and_simple_shape(spark, engine, tmp_path):
    small = Engine(spark, engine.tables, dim=DIM, most=2, simple=True, failed=str(tmp_path / "failed.txt"))
    assert small.query("SELECT Name FROM SymbolRecord LIMIT 4").row_count == 2 and small.query("SELECT Kind, COUNT(*) AS n FROM SymbolRecord GROUP BY Kind ORDER BY n", 9).row_count == 2
    for sql in ("SELECT Id FROM ChunkRecord", "SELECT s.Name FROM SymbolRecord s, RelationshipRecord r", "SELECT s.Name FROM SymbolRecord s JOIN RelationshipRecord r ON r.Id = s.Id", "WITH a AS (SELECT Name FROM SymbolRecord) SELECT * FROM a", "SELECT Name FROM (SELECT Name FROM SymbolRecord) x"):
        assert not small.query(sql).success
    assert len((tmp_path / "failed.txt").read_text().splitlines()) == 5
    assert not engine.query("SELECT FilePath FROM ChunkRecord WHERE Content LIKE '%x%' ORDER BY Similarity, FilePath").success


def test_respell_leaves_strings():
    assert respell("SELECT 'CAST(x AS TEXT)', CAST(x AS TEXT) FROM t") == "SELECT 'CAST(x AS TEXT)', CAST(x AS STRING) FROM t"


def test_tools(spark, engine):
    commits = spark.sql("SELECT * FROM VALUES ('h1', 'ann', DATE'2024-01-01', 'one', '/src/MyClass.cs'), ('h2', 'bob', DATE'2024-02-01', 'two', '/src/MyClass.cs'), ('h2', 'bob', DATE'2024-02-01', 'two', '/src/Helper.cs') AS c(hash, author, date, subject, path)")
    t = Tools(spark, engine.tables, commits, dim=DIM, root="/repo")
    assert t.semantic_search("authentication", 1)[0]["symbol_name"] == "MyClass"
    assert {r["symbol_name"] for r in t.trace_dependency("MyClass", "downstream")["chain"]} == {"IOld", "Helper"}
    assert {r["id"] for r in t.find_related_code("Helper")} == {"r2", "r3"}
    impact = t.impact_analysis("MyClass")
    assert impact["files"] == ["/src/Helper.cs", "/src/IOld.cs"]
    context = t.get_edit_context("MyClass")
    assert "AuthService" in context["source"] and "no tests found" in context["warnings"]
    assert t.get_edit_context("nothing")["target"] is None
    assert t.get_architecture_overview()["total_symbols"] == 5
    assert sum(c["size"] for c in t.get_component_clusters()) >= 1
    assert t.get_symbol_history("MyClass")["total_commits"] == 2
    assert t.get_hotspots(1) == [{"path": "/src/MyClass.cs", "commits": 2, "authors": 2, "first_date": commits.first()["date"], "last_date": t.get_symbol_history("MyClass")["last_date"]}]
    assert t.sql_query("SELECT Name FROM SymbolRecord")["row_count"] == 5
    assert t.ping()["status"] == "ready" and t.rescan_repository()["status"] == "unavailable" and t.get_repository_root()["root"] == "/repo"
    assert "SymbolRecord" in t.describe_schema()
