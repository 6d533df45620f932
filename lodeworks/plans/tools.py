"""The tool surface: each tool takes plain arguments and returns plain dicts."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import architecture as arch
from ..operators import graph, history, search
from ..session import cut
from ..sources import schema
from .frontend import Engine

RELATIONS = ("Imports", "Calls", "Inherits", "Implements", "References", "TestCoverage")


class Tools:
    """Questions to one repository: its three tables, and its commits where there are any.

    An answer holds at most ``most`` rows of a kind, the first in its order;
    ``chain_frame``, ``related_frame`` and ``impact_frame`` give all of them as
    DataFrames. ``components`` (prefix, component) are those of build files; paths
    outside them belong to their folder. History answers are kept for ``keep``
    seconds.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], commits: DataFrame | None = None, dim: int = vectors.DIM, root: str = "", reindex: Callable[[], dict[str, DataFrame] | None] | None = None, all_kinds: bool = False, components: DataFrame | None = None, most: int = 1000, keep: float = 300):
        self.spark, self.commits, self.dim, self.root, self.reindex = spark, commits, dim, root, reindex
        self.components, self.most, self.keep = components, most, keep
        self.kinds = None if all_kinds else arch.KINDS
        self.indexing, self.indexed_at = False, None
        self._use(tables)

    def _use(self, tables: dict[str, DataFrame]) -> None:
        self.tables, self.symbols, self.edges = tables, tables["symbols"], tables["relationships"]
        self._kept: dict[tuple, tuple[float, object]] = {}

    def _cached(self, key: tuple, make: Callable[[], object]) -> object:
        at, found = self._kept.get(key, (0.0, None))
        if found is None or time.monotonic() - at > self.keep:
            found = make()
            self._kept[key] = (time.monotonic(), found)
        return found

    def _first(self, df: DataFrame) -> list[dict]:
        return _dicts(df.limit(self.most))

    def ping(self) -> dict:
        return {"status": "indexing" if self.indexing else "ready", "last_indexed_at": self.indexed_at}

    def semantic_search(self, query: str, max_results: int = 10, minimum_similarity: float = 0.0) -> list[dict]:
        chunks = self.tables["chunks"]
        q = [float(x) for x in vectors.embed(query, self.dim)]
        hits = search.top_k(chunks.where("embedding IS NOT NULL"), q, max_results, min_similarity=minimum_similarity or None, most=50)
        names = self.symbols.select(F.col("id").alias("sid"), "name")
        rows = hits.join(names, F.col("symbol_id") == F.col("sid"), "left").select(F.coalesce("name", "symbol_id").alias("symbol_name"), "file_path", "language", "line_start", "line_end", "similarity", "distance")
        return [r.asDict() for r in rows.orderBy(F.desc("similarity"), "file_path").collect()]

    def _start(self, path: str) -> DataFrame:
        return graph.with_descendants(self.symbols, path)

    def trace_dependency(self, symbol_path: str, direction: str = "downstream", relation_type: str = "all", depth: int = 1, include_tests: bool = False) -> dict:
        chain = self.chain_frame(symbol_path, direction, depth)
        out = {"symbol": symbol_path, "direction": direction, "chain": self._first(chain.orderBy("level", "edge_id", "direction")), "related": self.find_related_code(symbol_path, relation_type)}
        if include_tests:
            out["tests"] = self._tests(symbol_path)
        return out

    def chain_frame(self, symbol_path: str, direction: str = "downstream", depth: int = 1) -> DataFrame:
        return graph.with_payload(graph.trace(self.edges, self._start(symbol_path), direction.lower(), depth), self.symbols)

    def related_frame(self, symbol_path: str, relation_type: str = "all") -> DataFrame:
        return graph.related(self.edges, self.symbols, symbol_path, relation_type)

    def impact_frame(self, symbol_path: str, depth: int = 2) -> DataFrame:
        return graph.impact_files(graph.trace(self.edges, self._start(symbol_path), "downstream", depth), self.symbols)

    def find_related_code(self, symbol_path: str, relation_type: str = "all") -> list[dict]:
        return self._first(self.related_frame(symbol_path, relation_type).orderBy("id"))

    def _tests(self, symbol_path: str) -> list[dict]:
        return self._first(graph.test_coverage(self.edges, self.symbols, self._start(symbol_path)).select("node", "file_path").distinct().orderBy("node"))

    def impact_analysis(self, symbol_path: str, depth: int = 2) -> dict:
        files = cut(self.impact_frame(symbol_path, depth))
        components = arch.with_component(files, self.components).groupBy("component").agg(F.count(F.lit(1)).alias("files"))
        return {"symbol": symbol_path, "files": [r["file_path"] for r in self._first(files.orderBy("file_path"))], "components": self._first(components.orderBy("component")), "tests": self._tests(symbol_path)}

    def get_edit_context(self, symbol_path: str, include_dependencies: bool = True, depth: int = 1, include_source_code: bool = True) -> dict:
        target = graph.resolve(self.symbols, symbol_path)
        found = _dicts(target)
        if not found:
            return {"symbol": symbol_path, "target": None, "warnings": [f"no symbol {symbol_path!r}"]}
        out: dict = {"symbol": symbol_path, "target": found[0], "warnings": []}
        if include_source_code:
            chunks = self.tables["chunks"].where(F.col("symbol_id") == found[0]["id"]).orderBy("line_start", "id").select("content").collect()
            out["source"] = "\n".join(r[0] for r in chunks)
            if not chunks:
                out["warnings"].append("no source is indexed")
        if include_dependencies:
            out["dependencies"] = self.trace_dependency(symbol_path, "both", depth=depth)["chain"]
            out["related"] = self.find_related_code(symbol_path)
        out["tests"] = self._tests(symbol_path)
        if not out["tests"]:
            out["warnings"].append("no tests found")
        return out

    def get_architecture_overview(self, path: str | None = None, depth: int = 1) -> dict:
        comps = arch.overview(arch.with_component(self.symbols, self.components, depth), F.col("component"), path, self.kinds)
        files = self.tables["chunks"].select("file_path", "language").distinct()
        if path:
            files = files.where(F.lower("file_path").startswith(path.lower()))
        languages = files.groupBy("language").agg(F.countDistinct("file_path").alias("files")).orderBy(F.desc("files"), "language")
        rows = _dicts(comps)
        return {"components": rows, "languages": _dicts(languages), "total_files": sum(r["files"] for r in rows), "total_symbols": sum(r["symbols"] for r in rows)}

    def get_component_clusters(self, threshold: float = 0.3, depth: int = 1) -> list[dict]:
        symbols = self.symbols.where(F.col("kind").isin(*self.kinds)) if self.kinds else self.symbols
        members = arch.with_component(symbols.select("id", "file_path"), self.components, depth).select("id", "component")
        matrix = cut(arch.coupling_matrix(self.edges, members))
        grouped = arch.clusters(members, arch.coupling_pairs(matrix), threshold)
        return _dicts(arch.cluster_cohesion(grouped, matrix).orderBy(F.desc("cohesion"), "name"))

    def get_symbol_history(self, symbol_path: str, max_commits: int = 5) -> dict:
        return self._cached(("history", symbol_path, max_commits), lambda: self._history(symbol_path, max_commits))

    def _history(self, symbol_path: str, max_commits: int) -> dict:
        target = _dicts(graph.resolve(self.symbols, symbol_path))
        if not target or self.commits is None:
            return {"symbol": symbol_path, "total_commits": 0, "newest": []}
        own = self.commits.where(F.col("path") == target[0]["file_path"])
        total = own.agg(F.countDistinct("hash").alias("total_commits"), F.countDistinct("author").alias("unique_authors"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).first().asDict()
        newest = own.select("hash", "author", "date", "subject").distinct().orderBy(F.desc("date"), F.desc("hash")).limit(min(max_commits, 10))
        return {"symbol": symbol_path, **total, "newest": _dicts(newest)}

    def get_hotspots(self, top: int = 10, max_commits: int = 25) -> list[dict]:
        if self.commits is None:
            return []
        recent = self.commits.select("hash", "date").distinct().orderBy(F.desc("date"), "hash").limit(max_commits * 10)
        return self._cached(("hotspots", top, max_commits), lambda: _dicts(history.hotspots(self.commits.join(recent.select("hash"), "hash", "left_semi"), top)))

    def sql_query(self, query: str, max_results: int = 100) -> dict:
        return Engine(self.spark, self.tables, self.dim).query(query, min(max(max_results, 1), 10_000)).dict()

    def rescan_repository(self) -> dict:
        """Index anew. ``reindex`` writes new snapshots and returns the tables that read them; they replace the old ones
        at once, and answers under way keep those they have opened."""
        if self.reindex is None:
            return {"status": "unavailable"}
        self.indexing = True
        try:
            tables = self.reindex()
            self._use(tables or self.tables)
            self.indexed_at = datetime.now().isoformat()
        finally:
            self.indexing = False
        return {"status": "complete", "symbols": self.symbols.count()}

    def get_repository_root(self) -> dict:
        return {"root": self.root}

    def describe_schema(self) -> str:
        return schema.describe()


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Repositories:
    """Several repositories behind one surface; each call names its own."""

    def __init__(self):
        self.tools: dict[str, Tools] = {}

    def add(self, name: str, tools: Tools) -> None:
        self.tools[name.lower()] = tools

    def __getitem__(self, name: str) -> Tools:
        return self.tools[name.lower()]

    def names(self) -> list[str]:
        return sorted(self.tools)
