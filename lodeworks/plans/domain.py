"""Queries of the repository-intelligence operators over the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..operators import architecture as arch
from ..operators import chunking, extraction, graph, history, names, search
from ..sources import snapshot, star
from ..sources.catalog import table
from ..sources.files import select_files
from ..session import cut, shared_dir
from ..streaming import watcher
from .frontend import Engine
from .relational import plain

EXTENSIONS = ["cs", "ts", "js", "java", "py", "go", "rs", "c", "h", "cpp", "hpp", "html", "tsx", "jsx", "mjs", "cc", "cxx", "hxx", "htm", "md", "txt"]
IGNORE = "bin/\nsrc1*/\n*.txt\n!src11/\n/src2/*.py\n"
SQL: dict[str, str] = {}
QUERIES: dict[str, object] = {}

_SYMBOLS = f"symbols AS ({plain(star.SYMBOLS_SQL)})"
_EDGES = f"edges AS ({plain(star.EDGES_SQL)})"
_FILES = "files AS (SELECT doc_id, source || '/' || doc_id || '.' || [" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "][doc_id % 21 + 1] AS file_path, text AS content FROM documents)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/doc_id.ext."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 21 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), ext)).alias("file_path"), F.col("text").alias("content"))


def _query_vector(vecs: DataFrame) -> list[float]:
    return vecs.where("vec_id = 0").first()["embedding"]


# lookups and edges


@query(f"WITH {_SYMBOLS} SELECT id, name, full_name FROM symbols WHERE full_name = 'NATION_3' OR name = 'NATION_3' ORDER BY CASE WHEN full_name = 'NATION_3' THEN 0 ELSE 1 END, id LIMIT 1")
def lookup_name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve(star.symbols(spark, sf_dir), "NATION_3").select("id", "name", "full_name")


@query(f"WITH {_SYMBOLS}, r AS (SELECT full_name FROM symbols WHERE id = 'n:3') SELECT s.id, s.full_name FROM symbols s, r WHERE starts_with(s.full_name, r.full_name || '.')")
def prefix_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star.symbols(spark, sf_dir)
    root = s.where("id = 'n:3'").first()["full_name"]
    return graph.descendants(s, root).select("id", "full_name")


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE source_symbol_id = 'o:7'")
def edges_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_out(star.relationships(spark, sf_dir), "o:7")


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE target_symbol_id = 's:2'")
def edges_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_in(star.relationships(spark, sf_dir), "s:2")


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE source_symbol_id = 's:2' UNION ALL SELECT * FROM edges WHERE target_symbol_id = 's:2'")
def edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_all(star.relationships(spark, sf_dir), "s:2")


@query(f"""WITH {_SYMBOLS}, {_EDGES} SELECT e.id, coalesce(s.name, e.target_symbol_id) AS symbol_name, coalesce(s.file_path, '') AS file_path, coalesce(s.kind, e.relationship_type) AS kind
  FROM edges e LEFT JOIN symbols s ON e.target_symbol_id = s.id""")
def edges_with_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_payload(star.relationships(spark, sf_dir), star.symbols(spark, sf_dir), "target_symbol_id").select("id", "symbol_name", "file_path", "kind")


@query("""SELECT a.r_name AS parent, b.n AS child FROM region a JOIN (SELECT r_name || '.' || n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey) b ON b.n LIKE a.r_name || '.%'""")
def join_like_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents by dotted prefix, through the SQL front end: LIKE over a join becomes an equi-join of prefixes."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    child = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(".", "r_name", "n_name").alias("name"))
    return Engine(spark, {"parents": region.select(F.col("r_name").alias("name")), "children": child}).frame("SELECT a.name AS parent, b.name AS child FROM parents a JOIN children b ON b.name LIKE a.name || '.%'")


# graph


_BELOW = f"(WITH {_SYMBOLS}, root AS (SELECT id, full_name FROM symbols WHERE name = 'NATION_3') SELECT id FROM root UNION SELECT s.id FROM symbols s, root WHERE starts_with(s.full_name, root.full_name || '.'))"


def _trace_sql(direction: str, start: str, depth: int) -> str:
    """start: SQL that selects the ids to begin with."""
    here, there = ("source_symbol_id", "target_symbol_id") if direction == "upstream" else ("target_symbol_id", "source_symbol_id")
    parts = [f"e AS MATERIALIZED (WITH {_EDGES} SELECT * FROM edges)", f"f1 AS MATERIALIZED {start}"]
    for k in range(1, depth + 1):
        parts.append(f"t{k} AS MATERIALIZED (SELECT {k} AS level, e.id AS edge_id, '{direction}' AS direction, e.{there} AS node, e.relationship_type FROM e JOIN f{k} ON e.{here} = f{k}.id)")
        met = " UNION ALL ".join(f"SELECT id FROM f{i}" for i in range(1, k + 1))
        parts.append(f"f{k + 1} AS MATERIALIZED (SELECT DISTINCT node AS id FROM t{k} ANTI JOIN ({met}) m ON t{k}.node = m.id)")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(1, depth + 1))


def _start(spark: SparkSession, node: str) -> DataFrame:
    return spark.range(1).select(F.lit(node).alias("id"))


@query(_trace_sql("downstream", "(SELECT 'p:3' AS id)", 2))
def graph_trace_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace(star.relationships(spark, sf_dir), _start(spark, "p:3"), "downstream", 2)


@query(_trace_sql("upstream", _BELOW, 3))
def graph_trace_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a symbol and everything below it."""
    return graph.trace(star.relationships(spark, sf_dir), graph.with_descendants(star.symbols(spark, sf_dir), "NATION_3"), "upstream", 3)


@query(f"SELECT * FROM ({_trace_sql('upstream', _BELOW, 2)}) UNION ALL SELECT * FROM ({_trace_sql('downstream', _BELOW, 2)})")
def graph_trace_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace(star.relationships(spark, sf_dir), graph.with_descendants(star.symbols(spark, sf_dir), "NATION_3"), "both", 2)


@query(f"""WITH {_SYMBOLS}, {_EDGES}, root AS (SELECT id, full_name FROM symbols WHERE name = 'NATION_3'), own AS (SELECT id FROM root UNION SELECT s.id FROM symbols s, root WHERE starts_with(s.full_name, root.full_name || '.')),
  t AS (SELECT e.*, o.id AS own FROM edges e JOIN own o ON e.source_symbol_id = o.id UNION ALL SELECT e.*, o.id FROM edges e JOIN own o ON e.target_symbol_id = o.id),
  u AS (SELECT id, source_symbol_id, target_symbol_id, relationship_type, min(own) AS own FROM t WHERE lower(relationship_type) = 'in' GROUP BY ALL)
  SELECT u.id, coalesce(s.name, u.target_symbol_id) AS symbol_name, coalesce(s.file_path, '') AS file_path, coalesce(s.kind, u.relationship_type) AS kind, u.relationship_type,
  CASE WHEN source_symbol_id = own THEN target_symbol_id ELSE source_symbol_id END AS other_symbol FROM u LEFT JOIN symbols s ON u.target_symbol_id = s.id""")
def graph_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(star.relationships(spark, sf_dir), star.symbols(spark, sf_dir), "NATION_3", "IN")


@query(f"""WITH {_SYMBOLS}, {_EDGES}, n AS (SELECT 'n:3' AS start, source_symbol_id AS node FROM edges WHERE target_symbol_id = 'n:3' UNION ALL SELECT 'n:3', target_symbol_id FROM edges WHERE source_symbol_id = 'n:3')
  SELECT DISTINCT n.start, n.node, s.file_path FROM n JOIN symbols s ON n.node = s.id WHERE regexp_matches(split_part(s.file_path, '/', -1), '[13579]$')""")
def test_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.test_coverage(star.relationships(spark, sf_dir), star.symbols(spark, sf_dir), _start(spark, "n:3"), stem="[13579]$")


_IMPACT = f"WITH {_SYMBOLS}, t AS ({_trace_sql('downstream', "(SELECT 'r:1' AS id)", 3)}), f AS (SELECT DISTINCT s.file_path FROM t JOIN symbols s ON t.node = s.id WHERE s.file_path <> '')"


def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = graph.trace(star.relationships(spark, sf_dir), _start(spark, "r:1"), "downstream", 3)
    return graph.impact_files(traced, star.symbols(spark, sf_dir))


@query(f"{_IMPACT} SELECT file_path FROM f")
def impact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir)


@query(f"{_IMPACT} SELECT split_part(file_path, '/', 1) AS component, count(*) AS files FROM f GROUP BY 1")
def impact_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact_components(_impact(spark, sf_dir))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS source FROM conversations GROUP BY conv_id")
def edit_context_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk texts of each symbol in order, joined by newlines."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("source"))


# architecture


@query(f"WITH {_SYMBOLS} SELECT split_part(file_path, '/', 1) AS component, count(DISTINCT file_path) AS files, count(*) AS symbols FROM symbols WHERE kind IN ('Supplier', 'Customer', 'Nation') GROUP BY 1")
def arch_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.overview(star.symbols(spark, sf_dir), F.split("file_path", "/")[0], kinds=("Supplier", "Customer", "Nation"))


@query("""WITH p AS (SELECT page_id, string_split(regexp_extract(url, '://(.*)$', 1), '/') AS s FROM pages)
  SELECT page_id, CASE WHEN len(s) > 2 THEN array_to_string(s[1:2], '/') ELSE s[-1] END AS component FROM p""")
def component_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", arch.component_at_depth(F.regexp_extract("url", "://(.*)$", 1), 2).alias("component"))


_PREFIXES = [("src1", "one"), ("src1/10.h", "exact"), ("src2", "two"), ("src", "none")]


@query(f"WITH {_FILES}, p(prefix, component) AS (VALUES {', '.join(map(str, _PREFIXES))}) SELECT f.doc_id, f.file_path, arg_max(p.component, length(p.prefix)) AS component FROM files f LEFT JOIN p ON f.file_path = p.prefix OR starts_with(f.file_path, p.prefix || '/') GROUP BY ALL")
def component_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, _PREFIXES))} AS p(prefix, component)")
    return arch.component_by_longest_prefix(_files(spark, sf_dir).select("doc_id", "file_path"), prefixes)


@query(f"""WITH {_FILES}, b AS (SELECT regexp_replace(file_path, '/?[^/]*$', '') AS prefix, split_part(file_path, '/', -1) AS file FROM files),
  r AS (SELECT *, CASE WHEN file LIKE '%.java' THEN 0 WHEN file LIKE '%.py' THEN 1 WHEN file LIKE '%7.%' THEN 2 END AS rank FROM b)
  SELECT prefix, file AS build_file, split_part(prefix, '/', -1) AS component FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY rank, file) = 1""")
def component_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.discover_components(_files(spark, sf_dir), ["*.java", "*.py", "*7.*"])


_MATRIX = """m AS (SELECT 'nation_' || c_nationkey AS a, 'nation_' || s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
_PAIRS = f"""{_MATRIX}, rows_ AS (SELECT a, sum(n) AS r FROM m GROUP BY a), q AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(n) AS n FROM m WHERE a <> b GROUP BY 1, 2),
  pairs AS (SELECT q.a, q.b, q.n / (coalesce(x.r, 0) + coalesce(y.r, 0)) AS coupling FROM q LEFT JOIN rows_ x ON q.a = x.a LEFT JOIN rows_ y ON q.b = y.a)"""
_CLUSTERS = f"""WITH RECURSIVE {_PAIRS}, comps AS (SELECT DISTINCT 'nation_' || n_nationkey AS component FROM nation), l AS (SELECT a, b FROM pairs WHERE coupling >= 0.06 UNION ALL SELECT b, a FROM pairs WHERE coupling >= 0.06),
  reach AS (SELECT component, component AS other FROM comps UNION SELECT r.component, l.b FROM reach r JOIN l ON r.other = l.a), mem AS (SELECT component, min(other) AS cluster FROM reach GROUP BY component)"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to nation by line items: an edge list and its members, through the general operator."""
    t = lambda n: table(spark, sf_dir, n)
    bought = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = bought.select(F.concat(F.lit("c:"), "o_custkey").alias("source_symbol_id"), F.concat(F.lit("s:"), "l_suppkey").alias("target_symbol_id"))
    members = t("customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.concat(F.lit("nation_"), "c_nationkey").alias("component")).union(t("supplier").select(F.concat(F.lit("s:"), "s_suppkey"), F.concat(F.lit("nation_"), "s_nationkey")))
    return arch.coupling_matrix(edges, members)


def _members(spark: SparkSession, sf_dir: str, matrix: DataFrame) -> DataFrame:
    comps = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("component"))
    return arch.clusters(comps, arch.coupling_pairs(matrix), 0.06)


@query(f"WITH {_MATRIX} SELECT * FROM m")
def coupling_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@query(f"WITH {_PAIRS} SELECT a, b, round(coupling, 6) AS coupling FROM pairs")
def coupling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.coupling_pairs(_matrix(spark, sf_dir)).withColumn("coupling", F.round("coupling", 6))


@query(f"{_CLUSTERS} SELECT component, cluster FROM mem")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir, cut(_matrix(spark, sf_dir)))


@query(f"""{_CLUSTERS}, t AS (SELECT ma.cluster AS k, sum(n) AS total, sum(CASE WHEN ma.cluster = mb.cluster THEN n ELSE 0 END) AS inside FROM m JOIN mem ma ON m.a = ma.component JOIN mem mb ON m.b = mb.component GROUP BY 1),
  g AS (SELECT cluster, string_agg(component, '+' ORDER BY component) AS name, count(*) AS size FROM mem GROUP BY cluster)
  SELECT g.cluster, g.name, g.size, CASE WHEN size = 1 THEN 1.0 ELSE round(coalesce(inside / total, 0), 6) END AS cohesion FROM g LEFT JOIN t ON g.cluster = t.k""")
def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = cut(_matrix(spark, sf_dir))
    return arch.cluster_cohesion(_members(spark, sf_dir, matrix), matrix).withColumn("cohesion", F.round("cohesion", 6))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as commits: of a user, to a path that is the type."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("hash"), F.col("user_id").alias("author"), F.col("ts").alias("date"), F.col("event_type").alias("path"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
  SELECT event_type, count(*) AS commits, count(DISTINCT user_id) AS authors, min(ts)::DATE AS first_date, max(ts)::DATE AS last_date, list(event_id ORDER BY r) FILTER (WHERE r <= 10) AS newest FROM t GROUP BY event_type""")
def entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.history(_commits(spark, sf_dir)).withColumnRenamed("path", "event_type")
    return found.withColumn("first_date", F.col("first_date").cast("date")).withColumn("last_date", F.col("last_date").cast("date"))


@query("SELECT event_type AS path, COUNT(*) AS commits, COUNT(DISTINCT user_id) AS authors, CAST(MIN(ts) AS DATE) AS first_date, CAST(MAX(ts) AS DATE) AS last_date FROM events GROUP BY event_type ORDER BY commits DESC, path LIMIT 10")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.hotspots(_commits(spark, sf_dir), 10)
    return found.withColumn("first_date", F.col("first_date").cast("date")).withColumn("last_date", F.col("last_date").cast("date"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watcher.latest_per_key(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


# vectors


def _rounded(score: str) -> Column:
    """Five digits of a score in single precision, rounded as SQL rounds a FLOAT: scaled in double."""
    return (F.round(F.col(score).cast("float").cast("double") * 1e5) / 1e5).alias(score)


_SIM = "list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id, round({_SIM}, 5) AS similarity FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.top_k(v, _query_vector(v), 10, "vec_id", most=50).select("vec_id", _rounded("similarity"))


@query(f"SELECT vec_id, round(1 - {_SIM}, 5) AS distance FROM embeddings WHERE {_SIM} >= 0.2 ORDER BY {_SIM} DESC, vec_id LIMIT 50")
def vector_min_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.top_k(v, _query_vector(v), 50, "vec_id", min_similarity=0.2).select("vec_id", _rounded("distance"))


@query(f"SELECT vec_id, label, round({_SIM}, 5) AS similarity FROM embeddings WHERE label = 3 ORDER BY {_SIM} DESC, vec_id LIMIT 10")
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.top_k(v, _query_vector(v), 10, "vec_id", where=F.col("label") == 3).select("vec_id", "label", _rounded("similarity"))


@query(f"WITH ids AS (SELECT doc_id AS vec_id FROM documents), s AS (SELECT vec_id, {_SIM} AS s FROM embeddings) SELECT ids.vec_id, round(coalesce(s, 0), 5) AS similarity FROM ids LEFT JOIN s ON ids.vec_id = s.vec_id")
def vector_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return search.rerank(ids, v, _query_vector(v), "vec_id").select("vec_id", _rounded("similarity"))


@query(f"WITH t AS (SELECT vec_id, {_SIM} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 10) SELECT t.vec_id, coalesce('quality ' || l.quality, 'doc ' || t.vec_id) AS symbol_name FROM t LEFT JOIN labels l ON t.vec_id = l.doc_id")
def search_with_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    hits = search.top_k(v, _query_vector(v), 10, "vec_id").select("vec_id")
    return hits.join(table(spark, sf_dir, "labels"), F.col("vec_id") == F.col("doc_id"), "left").select("vec_id", F.coalesce(F.concat(F.lit("quality "), "quality"), F.concat(F.lit("doc "), "vec_id")).alias("symbol_name"))


@query()
def sql_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORDER BY Similarity through the SQL front end; the text comes from the LIKE, rows-only."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(tx.chunk_id(F.col("source"), F.col("text"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("symbol_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), vectors.embed_column(F.col("text"), 256).alias("embedding"))
    return Engine(spark, {"chunks": chunks}, dim=256).frame("SELECT FilePath, Language FROM ChunkRecord WHERE Content LIKE '%the worthless idiot%' AND Language = 'en' ORDER BY Similarity LIMIT 10")


# text


@query("""WITH l(k, v) AS (VALUES ('cs', 'CSharp'), ('ts', 'TypeScript'), ('tsx', 'TypeScript'), ('js', 'JavaScript'), ('jsx', 'JavaScript'), ('mjs', 'JavaScript'), ('java', 'Java'), ('py', 'Python'), ('go', 'Go'), ('rs', 'Rust'), ('c', 'C'),
  ('cpp', 'Cpp'), ('cc', 'Cpp'), ('cxx', 'Cpp'), ('hpp', 'Cpp'), ('hxx', 'Cpp'), ('html', 'Html'), ('htm', 'Html'), ('md', 'Text'), ('txt', 'Text')), """ + _FILES + """
  SELECT f.doc_id, CASE WHEN l.v IS NOT NULL THEN l.v WHEN regexp_matches(left(f.content, 4096), 'class|namespace|template|::') THEN 'Cpp' ELSE 'C' END AS language FROM files f LEFT JOIN l ON split_part(f.file_path, '.', -1) = l.k""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", tx.detect_language(F.col("file_path"), F.col("content")).alias("language"))


_IGNORED = "CASE WHEN regexp_matches(file_path, '^src2/[^/]*\\.py$') THEN true WHEN starts_with(file_path, 'src11/') THEN false WHEN ends_with(file_path, '.txt') THEN true WHEN starts_with(file_path, 'src1') THEN true ELSE false END"


@query(f"WITH {_FILES} SELECT doc_id, file_path, {_IGNORED} AS ignored FROM files")
def ignore_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", "file_path", tx.IgnoreRules(IGNORE).matches(F.col("file_path")).alias("ignored"))


@query(f"WITH {_FILES} SELECT doc_id, file_path FROM files WHERE NOT ({_IGNORED}) AND split_part(file_path, '.', -1) IN ('cs', 'py', 'go')")
def crawl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_files(_files(spark, sf_dir), [".cs", "py", "Go"], IGNORE).select("doc_id", "file_path")


@query("SELECT doc_id, sha256(concat_ws('|', source, text, source || '/' || doc_id))[1:32] AS chunk_id FROM documents")
def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.chunk_id(F.col("source"), F.col("text"), path).alias("chunk_id"))


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 4096 THEN text ELSE left(text, list_max(list_filter(range(1000, 4097), lambda n: strlen(left(text, n)) <= 4096))) END AS text FROM documents""")
def truncate_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at 4096 bytes on a character border."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate_utf8(F.col("text"), 4096).alias("text"))


@query("SELECT doc_id, sha256('' || '|' || text || '|' || source || '/' || doc_id)[1:32] AS id, len(string_split(text, chr(10))) AS line_end FROM documents WHERE length(trim(text)) > 0")
def chunk_file_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"))
    return chunking.file_chunks(d).select(F.substring_index("file_path", "/", -1).cast("long").alias("doc_id"), "id", F.col("line_end").cast("long").alias("line_end"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS body FROM documents")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunking.lines_between(F.col("text"), F.lit(2), F.lit(4)).alias("body"))


@query("SELECT conv_id, turn, '// Parent: ' || conv_id || chr(10) || text AS content FROM conversations")
def chunk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", chunking.with_header(F.col("conv_id").cast("string"), F.col("text")).alias("content"))


@query(f"""WITH {_SYMBOLS}, s AS (SELECT * FROM symbols), refs AS (SELECT s_suppkey AS ref_id, CASE s_suppkey % 3 WHEN 0 THEN 'NATION_' || s_nationkey WHEN 1 THEN s_name ELSE 'REGION.' || s_name END AS target FROM supplier),
  k AS (SELECT id, 1 AS rule, full_name AS k FROM s UNION ALL SELECT id, 2, name FROM s UNION ALL SELECT id, 3, split_part(name, '(', 1) FROM s)
  SELECT refs.ref_id, refs.target, k.id AS symbol_id, k.rule FROM refs JOIN k ON refs.target = k.k QUALIFY row_number() OVER (PARTITION BY refs.ref_id ORDER BY k.rule, k.id) = 1""")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star.symbols(spark, sf_dir)
    kind = F.col("s_suppkey") % 3
    refs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref_id"), F.when(kind == 0, F.concat(F.lit("NATION_"), "s_nationkey")).when(kind == 1, F.col("s_name")).otherwise(F.concat(F.lit("REGION."), "s_name")).alias("target"))
    return names.resolve_names(refs, s)


@query("""WITH s AS (SELECT 's' || conv_id || ':' || turn AS id, 'f' || (conv_id % 5) AS f, conv_id % 37 AS a, conv_id % 37 + 3 * turn + length(role) AS b FROM conversations), p AS (SELECT DISTINCT 'f' || (conv_id % 5) AS f, turn * 4 AS line FROM conversations)
  SELECT p.f AS file_path, p.line, arg_min(s.id, (b - a, s.id)) AS symbol_id FROM p JOIN s ON p.f = s.f AND p.line BETWEEN s.a AND s.b GROUP BY 1, 2""")
def containing_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = table(spark, sf_dir, "conversations"), F.concat(F.lit("f"), F.col("conv_id") % 5)
    a = F.col("conv_id") % 37
    s = c.select(F.concat(F.lit("s"), "conv_id", F.lit(":"), "turn").alias("id"), f.alias("file_path"), a.alias("line_start"), (a + 3 * F.col("turn") + F.length("role")).alias("line_end"))
    return names.containing(c.select(f.alias("file_path"), (F.col("turn") * 4).alias("line")).distinct(), s)


#: By p_partkey % 4: extension, language, and a source file in which # stands for the key.
SOURCES = [
    ("py", "Python", "class Part#(Base):\n    def run(self):\n        start()\n\nLIMIT = #\n"),
    ("cs", "CSharp", "namespace Geo;\n\npublic class Part# : IThing\n{\n    private int count;\n    public string Name { get; set; }\n    public void Run(string text)\n    {\n        Writer.Print(text);\n    }\n}\n"),
    ("go", "Go", "package main\n\ntype Part# struct {\n    port int\n}\n\nfunc (s *Part#) Run() error {\n    return listen(s.port)\n}\n"),
    ("ts", "TypeScript", "export interface Named# {\n  name: string;\n}\nexport class Part# implements Named# {\n  open(): void {\n    unlock();\n  }\n}\n"),
]
#: Of each kind of file: kind, full name, first and last line of what it declares.
DECLARED = [
    (0, "Class", "Part#", 1, 3), (0, "Method", "Part#.run", 2, 3), (0, "Variable", "LIMIT", 5, 5),
    (1, "Class", "Part#", 3, 11), (1, "Field", "Part#.count", 5, 5), (1, "Property", "Part#.Name", 6, 6), (1, "Method", "Part#.Run", 7, 10),
    (2, "Struct", "Part#", 3, 5), (2, "Method", "Part#.Run", 7, 9),
    (3, "Interface", "Named#", 1, 3), (3, "Field", "Named#.name", 2, 2), (3, "Class", "Part#", 4, 8), (3, "Method", "Part#.open", 5, 7),
]


@query(f"""WITH d(k, kind, full_name, line_start, line_end) AS (VALUES {', '.join(map(str, DECLARED))}), x(k, ext) AS (VALUES {', '.join(f"({i}, '{e}')" for i, (e, _, _) in enumerate(SOURCES))})
  SELECT 'src/part' || p_partkey || '.' || ext AS file_path, kind, replace(full_name, '#', p_partkey::VARCHAR) AS full_name, line_start, line_end FROM part JOIN d ON p_partkey % 4 = d.k JOIN x ON x.k = d.k""")
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of a source file for each part, in four languages."""
    key, pick = F.col("p_partkey").cast("string"), lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in SOURCES]), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("src/part"), key, F.lit("."), pick(0)).alias("file_path"), pick(1).alias("language"), F.replace(pick(2), F.lit("#"), key).alias("content"))
    return extraction.with_symbol_ids(extraction.extract_symbols(files)).select("file_path", "kind", "full_name", "line_start", "line_end")


# sinks and streams


@query("""SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value FROM events WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
  UNION ALL SELECT * FROM (SELECT user_id, event_id, value FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    current = snapshot.last_wins(e.where("event_id % 2 = 0"), "user_id", "event_id")
    return snapshot.upsert(current, e.where("event_id % 2 = 1"), "user_id", "event_id")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src7')")
def delete_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.delete_where_in(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["src1", "src7"])


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE source_symbol_id NOT IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_acctbal < 0)")
def delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"))
    return snapshot.delete_where_in(star.relationships(spark, sf_dir), "source_symbol_id", gone)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream, drained through foreachBatch; equals the batch result."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events*.parquet")
    return watcher.upsert_stream(spark, source, "user_id", ["ts", "event_id"], ["event_id", "event_type"], f"{root}/table", f"{root}/progress").select("user_id", "event_id", "event_type")
