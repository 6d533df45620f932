"""The SQL front end: one SELECT over the logical tables, with a result envelope.

Spark parses, plans and runs the statement. The front end checks its shape on
Spark's own unresolved plan, spells a few dialect differences Spark's way, and
turns ORDER BY Similarity into a vector search. Failures come back as data.
"""

from __future__ import annotations

import logging
import re
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import search
from ..sources import schema

log = logging.getLogger(__name__)
_TOKEN = re.compile(r"'(?:''|[^'])*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_][\w]*|\d+(?:\.\d+)?|\s+|--[^\n]*|.", re.S)
_VIRTUAL = "similarity"


class Rejected(ValueError):
    """A statement this engine doesn't run."""


@dataclass
class Result:
    success: bool
    row_count: int = 0
    execution_time_ms: float = 0.0
    columns: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    error: str | None = None

    def dict(self) -> dict:
        return asdict(self)


def tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith("--")]


def _words(parts: list[str]) -> list[str]:
    return [p.upper() for p in parts if re.match(r"[A-Za-z_]", p)]


def respell(sql: str) -> str:
    """TEXT as STRING in casts; ISNULL(a, b) as coalesce(a, b), NVL and IFNULL of several arguments too."""
    parts, out, i = tokens(sql), [], 0
    while i < len(parts):
        p = parts[i]
        rest = "".join(parts[i + 1 :]).lstrip()
        if p.upper() == "TEXT" and out and _last(out) == "AS" and rest.startswith(")"):
            p = "STRING"
        elif p.upper() in ("ISNULL", "NVL", "IFNULL") and rest.startswith("(") and _arguments(parts, i + 1) >= 2:
            p = "coalesce"
        out.append(p)
        i += 1
    return "".join(out)


def compat_predicates(sql: str) -> str:
    """LIKE with only a leading and a trailing % as wildcards (without either the text is contained), and <> that holds for nulls."""
    parts, out, i = tokens(sql), [], 0
    while i < len(parts):
        two = "".join(parts[i : i + 2])
        if two in ("<>", "!="):
            out.append(" IS DISTINCT FROM ")
            i += 2
            continue
        p = parts[i]
        if p.startswith("'") and _last(out) in ("LIKE", "ILIKE"):
            text = p[1:-1]
            head, tail = text.startswith("%"), text.endswith("%") and len(text) > 1
            core = re.sub(r"([%_\\])", r"\\\\\1", text[head : len(text) - tail])
            p = f"'{'%' if head or not tail else ''}{core}{'%' if tail or not head else ''}'"
        out.append(p)
        i += 1
    return "".join(out)


_COLUMN = r"(?:(\w+)\.)(\w+)"
_PREFIX = re.compile(rf"(?<![\w.]){_COLUMN}\s+LIKE\s+{_COLUMN}\s*\|\|\s*'([^%_'\\]+)%'", re.I)


def prefix_joins(sql: str) -> str:
    """Joins ON b.x LIKE a.y || '.%' as equi-joins: b gives a row for each proper prefix of x that ends before the separator.

    What a.y holds is taken as it is written, so % and _ in it are no wildcards.
    Only where b is a table that an inner or comma join brings in, or the right
    side of a left join, and the predicate stands in a conjunction: there each
    row of b meets a.y in one of its prefixes at most, and as many rows come out.
    """
    m = _PREFIX.search(sql)
    if not m or re.search(r"\b(OR|NOT|RIGHT|FULL|CASE|UNION|WITH)\b", sql, re.I) or _PREFIX.search(sql, m.end()):
        return sql
    b, x, a, y, sep = m.groups()
    source = re.search(rf"\b(FROM|JOIN|,)\s*(\w+)\s+(?:AS\s+)?{b}\b", sql, re.I)
    if not source or a.lower() == b.lower() or (source[1].upper() == "FROM" and re.search(r"\bLEFT\b", sql, re.I)):
        return sql
    n = len(sep)
    cuts = f"filter(sequence(1, length({x})), i -> substring({x}, i, {n}) = '{sep}')"
    table = f"{source[1]} (SELECT *, explode_outer(transform({cuts}, i -> substring({x}, 1, i - 1))) AS __prefix FROM {source[2]}) {b}"
    out = sql[: m.start()] + f"{b}.__prefix = {a}.{y}" + sql[m.end() :]
    return out.replace(source[0], table, 1)


def _last(parts: list[str]) -> str:
    return next((p.upper() for p in reversed(parts) if p.strip()), "")


def _arguments(parts: list[str], at: int) -> int:
    depth, n = 0, 1
    for p in parts[at:]:
        depth += p in "([" and len(p) == 1
        depth -= p in ")]" and len(p) == 1
        if p == "," and depth == 1:
            n += 1
        if depth == 0 and p == ")":
            return n
    return n


def _split(parts: list[str], word: tuple[str, ...], start: int = 0) -> int:
    """Where a top-level clause of these words begins, or -1."""
    depth = 0
    solid = [(i, p.upper()) for i, p in enumerate(parts) if p.strip()]
    for k, (i, p) in enumerate(solid):
        depth += p == "("
        depth -= p == ")"
        if depth == 0 and i >= start and tuple(x for _, x in solid[k : k + len(word)]) == word:
            return i
    return -1


def _conjuncts(parts: list[str]) -> list[str]:
    out, depth, between = [[]], 0, False
    for p in parts:
        u = p.upper()
        depth += p == "("
        depth -= p == ")"
        between = between or (u == "BETWEEN" and depth == 0)
        if u == "AND" and depth == 0 and not between:
            out.append([])
            continue
        if u == "AND" and between:
            between = False
        out[-1].append(p)
    return ["".join(x).strip() for x in out if "".join(x).strip()]


_CONTENT = re.compile(r"^\(?\s*(?:\w+\.)?Content\s+I?LIKE\s+'((?:''|[^'])*)'(?:\s+OR\s+(?:\w+\.)?Content\s+I?LIKE\s+'((?:''|[^'])*)')*\s*\)?$", re.I)


class Engine:
    """SQL over symbols, relationships and chunks.

    ``compat`` restores strict shape rules (set operations and recursive CTEs are
    refused, a derived table needs an alias) and the older LIKE and <>.
    ``simple`` accepts one SELECT from symbols or relationships alone. The default
    accepts whatever Spark SQL can do in one SELECT. Division by zero is NULL.

    Further tables may have any name. Names are bound while a statement is
    analysed and not longer, so engines on one session don't see each other's
    tables. ``failed`` is a file to which failed statements are appended.
    """

    _binding = threading.RLock()

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], dim: int = vectors.DIM, compat: bool = False, max_results: int = 100, simple: bool = False, most: int = 10_000, failed: str | None = None):
        self.spark, self.tables, self.dim, self.compat, self.max_results = spark, tables, dim, compat, max_results
        self.simple, self.most, self.failed = simple, most, failed

    @contextmanager
    def _bound(self) -> Iterator[None]:
        """The tables as views, with the session's own views of these names put back afterwards; x / 0 is NULL meanwhile."""
        with self._binding:
            catalog, conf = self.spark.catalog, self.spark.conf
            views = schema.views(self.tables) | {"__ranked": None}
            own = {v.name.lower() for v in catalog.listTables() if v.isTemporary}
            before = {name: self.spark.table(name) for name in views if name.lower() in own}
            ansi = conf.get("spark.sql.ansi.enabled")
            conf.set("spark.sql.ansi.enabled", "false")
            try:
                for name, df in views.items():
                    if df is not None:
                        df.createOrReplaceTempView(name)
                yield
            finally:
                conf.set("spark.sql.ansi.enabled", ansi)
                for name in views:
                    catalog.dropTempView(name)
                for name, df in before.items():
                    df.createOrReplaceTempView(name)

    def _check(self, sql: str) -> None:
        bare = [t for t in tokens(sql) if t.strip()]
        while bare and bare[-1] == ";":
            bare.pop()
        if not bare:
            raise Rejected("the statement is empty")
        if ";" in bare:
            raise Rejected("one statement only")
        words = _words(bare)
        if not words or words[0] not in ("SELECT", "WITH"):
            raise Rejected("only SELECT statements are supported")
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan("".join(bare_join(sql)))
        except Exception as e:
            raise Rejected(f"syntax error: {str(e).strip().splitlines()[0]}") from None
        shape = plan.toString()
        if "OneRowRelation" in shape.splitlines()[-1] and "FROM" not in words:
            raise Rejected("SELECT needs a FROM clause")
        if re.search(r"^\s*[:+\- ]*'?(InsertInto|Create|Drop|Delete|Update|Merge)", shape, re.M):
            raise Rejected("only SELECT statements are supported")
        if self.simple:
            upper = [t.upper() for t in bare]
            source = upper.index("FROM") + 1 if "FROM" in upper else len(upper)
            if words[0] != "SELECT" or words.count("SELECT") != 1 or words.count("FROM") != 1 or {"JOIN", "UNION", "INTERSECT", "EXCEPT"} & set(words) or "," in upper[source : next((i for i, t in enumerate(upper) if i > source and t in ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT")), None)]:
                raise Rejected("a simple SELECT from one table is expected")
            if source >= len(upper) or upper[source] not in ("SYMBOLRECORD", "RELATIONSHIPRECORD"):
                raise Rejected("only SymbolRecord and RelationshipRecord can be queried here; use semantic search for chunks")
        if self.compat:
            if re.search(r"'?(Union|Intersect|Except)\b", shape) or words.count("UNION") or words.count("INTERSECT") or words.count("EXCEPT"):
                raise Rejected("set operations are not supported; use a simple SELECT")
            if "RECURSIVE" in words:
                raise Rejected("recursive CTEs are not supported")
            if "__auto_generated_subquery_name" in shape:
                raise Rejected("a derived table needs an alias")

    def frame(self, sql: str) -> DataFrame:
        """The statement as a DataFrame, not run yet. Raises Rejected, or Spark's analysis errors."""
        text = respell(sql.strip().rstrip(";"))
        self._check(text)
        if self.compat:
            text = compat_predicates(text)
        with self._bound():
            return self._frame(text)

    def _frame(self, text: str) -> DataFrame:
        parts = tokens(text)
        at = _split(parts, ("ORDER", "BY"))
        keys = [p for p in parts[at + 1 :] if p.strip()] if at >= 0 else []
        if at >= 0 and len(keys) > 1 and keys[1].lower() == _VIRTUAL:
            rest = [k.upper() for k in keys[2:]]
            if rest[:1] in ([","], ["ASC"]) or rest[:2] == ["DESC", ","]:
                raise Rejected("ORDER BY Similarity is descending and takes no further keys")
            return self._by_similarity(parts, at)
        if _VIRTUAL in [p.lower() for p in parts] and "chunkrecord" in [p.lower() for p in parts]:
            raise Rejected("Similarity can only be ordered by")
        joined = prefix_joins(text)
        return _named(self.spark.sql(joined).drop("__prefix"), parts)

    def _by_similarity(self, parts: list[str], order_at: int) -> DataFrame:
        """Top-k of chunks, or of a CTE joined to its chunks, by the text of Content LIKE."""
        select, limit_at = _split(parts, ("SELECT",)), _split(parts, ("LIMIT",), order_at)
        source, where_at = _split(parts, ("FROM",), select), _split(parts, ("WHERE",), select)
        end = where_at if where_at >= 0 else order_at
        tables = [p for p in parts[source + 1 : end] if p.strip()]
        if "," in tables or "JOIN" in _words(tables):
            raise Rejected("ORDER BY Similarity works on one table")
        if _split(parts, ("GROUP", "BY")) >= 0 or "DISTINCT" in _words(parts[select:source]) or re.search(r"\b(COUNT|SUM|AVG|MIN|MAX)\s*\(", "".join(parts[select:source]), re.I):
            raise Rejected("ORDER BY Similarity can't be combined with DISTINCT, GROUP BY or aggregates")
        where = _conjuncts(parts[where_at + 1 : order_at]) if where_at >= 0 else []
        texts = [c for c in where if _CONTENT.match(c)]
        if not texts:
            raise Rejected("ORDER BY Similarity needs Content LIKE '%text%'")
        wanted = " ".join(x.replace("''", "'").strip("%") for c in texts for x in re.findall(r"'((?:''|[^'])*)'", c))
        rest = [c for c in where if c not in texts]
        k = int("".join(parts[limit_at + 1 :]).split()[0]) if limit_at >= 0 else self.max_results
        query = [float(x) for x in vectors.embed(wanted, self.dim)]
        name = tables[0]
        chunks = self.tables["chunks"]
        scores = chunks.select(F.col("id").alias("__id"), "embedding")
        prefix = "".join(parts[:select])
        body = f"{prefix} SELECT * FROM {''.join(parts[source + 1 : end])}" + (f" WHERE {' AND '.join(rest)}" if rest else "")
        rows = self.spark.sql(body)
        id_col = next((c for c in rows.columns if c.lower() == "id"), None)
        if id_col is None:
            raise Rejected(f"{name} has no Id to rank by")
        scored = search.scored(scores, query).select("__id", "similarity")
        if name.lower() in ("chunkrecord", "chunks"):
            ranked = rows.join(scored, F.col(id_col) == F.col("__id")).where("similarity IS NOT NULL")
        elif prefix.strip():
            ranked = rows.join(scored, F.col(id_col) == F.col("__id"), "left")
        else:
            raise Rejected("ORDER BY Similarity works on chunks, or on a CTE with their Id")
        ranked = ranked.withColumn("__score", F.coalesce("similarity", F.lit(0.0))).drop("similarity", "__id")
        top = ranked.orderBy(F.desc("__score"), id_col).limit(k)
        items = "".join(parts[select + 1 : source]).strip()
        view = "__ranked"
        top.createOrReplaceTempView(view)
        alias = tables[-1] if len(tables) > 1 else name
        shown = f"SELECT * FROM {view}" if items == "*" else f"SELECT {items}, __score FROM {view} AS {alias}"
        return self.spark.sql(shown)

    def query(self, sql: str, max_results: int | None = None) -> Result:
        """Run and collect at most ``max_results`` rows (the statement's own LIMIT wins, up to ``most``) into the envelope; ``frame`` gives all rows."""
        began = time.perf_counter()
        try:
            df = self.frame(sql)
            limited = _split(tokens(sql), ("LIMIT",)) >= 0
            rows = df.limit(self.most if limited else min(max_results or self.max_results, self.most)).collect()
            return Result(True, len(rows), (time.perf_counter() - began) * 1000, df.columns, [r.asDict(recursive=True) for r in rows])
        except Exception as e:  # an error is an answer, too
            message = str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__
            log.warning("query failed: %s: %s", message, sql)
            if self.failed:
                with self._binding, open(self.failed, "a") as out:
                    print(f"{message}\t{' '.join(sql.split())}", file=out)
            return Result(False, execution_time_ms=(time.perf_counter() - began) * 1000, error=message)


def bare_join(sql: str) -> list[str]:
    return [t for t in tokens(sql)]


def _named(df: DataFrame, parts: list[str]) -> DataFrame:
    """Output names of unaliased items: ``s.Name`` keeps its alias, other expressions their text; equal names get a number."""
    select = _split(parts, ("SELECT",))
    source = _split(parts, ("FROM",), select)
    if select < 0 or source < 0:
        return df
    items, depth, item = [], 0, []
    for p in parts[select + 1 : source]:
        depth += p == "("
        depth -= p == ")"
        if p == "," and depth == 0:
            items.append("".join(item).strip())
            item = []
        else:
            item.append(p)
    items.append("".join(item).strip())
    if items:
        items[0] = re.sub(r"^DISTINCT\s+", "", items[0], flags=re.I)
    if len(items) != len(df.columns) or any(x.endswith("*") for x in items):
        return df
    names, seen = [], {}
    for text, have in zip(items, df.columns, strict=True):
        aliased = re.search(r"(?:\s+AS\s+|\s+|\))[`\"]?" + re.escape(have) + r"[`\"]?$", text, re.I) and text.lower() != have.lower()
        name = have if aliased or re.fullmatch(r"\w+", text) else text
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)
