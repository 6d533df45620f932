"""Components, languages, coupling and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Kinds of symbols that count, unless all are asked for.
KINDS = ("Class", "Interface", "Struct", "Enum", "Record", "Method", "Property", "Field", "Event")


#: Names of files that make their folder a component, best first.
BUILD_FILES = ["*.csproj", "*.vbproj", "*.fsproj", "pom.xml", "package.json", "Cargo.toml", "go.mod", "build.gradle", "build.gradle.kts", "pyproject.toml", "CMakeLists.txt", "*.cabal"]


def component_at_depth(path: Column, depth: int) -> Column:
    """The first ``depth`` directories of a path; of a shallower path, the last segment."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")).otherwise(F.element_at(parts, -1))


def component_by_longest_prefix(files: DataFrame, prefixes: DataFrame, path_col: str = "file_path") -> DataFrame:
    """files with the component of the longest prefix(prefix, component) that begins their path, at a directory border.

    Each path is expanded into its directories, which meet the prefixes in an
    equi-join; a path that no prefix begins has a null component. The empty
    prefix, that of a build file in the root, begins every path.
    """
    parts = F.split(F.col(path_col), "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    tries = files.select(path_col).distinct().select(path_col, F.explode(dirs).alias("dir"))
    best = tries.join(prefixes, F.col("dir") == F.col("prefix")).groupBy(F.col(path_col).alias("__path")).agg(F.max_by("component", F.length("prefix")).alias("component"))
    return files.join(best, F.col(path_col) == F.col("__path"), "left").drop("__path")


def with_component(rows: DataFrame, prefixes: DataFrame | None, depth: int = 1, path_col: str = "file_path") -> DataFrame:
    """rows with their component: that of the nearest build file above, else the folder at ``depth``."""
    by_depth = component_at_depth(F.col(path_col), depth)
    if prefixes is None:
        return rows.withColumn("component", by_depth)
    return component_by_longest_prefix(rows, prefixes.select("prefix", "component"), path_col).withColumn("component", F.coalesce("component", by_depth))


def discover_components(files: DataFrame, patterns: list[str] | None = None, path_col: str = "file_path", root: str = "root") -> DataFrame:
    """Build files give components: prefix (their directory), component (its name); of several in one directory the first pattern wins.

    The root's prefix is empty, its component is called ``root``.
    """
    patterns = BUILD_FILES if patterns is None else patterns
    name, folder = F.substring_index(path_col, "/", -1), F.regexp_replace(path_col, "/?[^/]*$", "")
    rank = F.coalesce(*[F.when(name.rlike("^" + p.replace(".", r"\.").replace("*", ".*") + "$"), i) for i, p in enumerate(patterns)])
    ranked = files.select(folder.alias("prefix"), name.alias("file"), rank.alias("rank")).where("rank IS NOT NULL")
    return ranked.groupBy("prefix").agg(F.min_by("file", F.struct("rank", "file")).alias("build_file")).withColumn("component", F.when(F.col("prefix") == "", F.lit(root)).otherwise(F.substring_index("prefix", "/", -1)))


def overview(symbols: DataFrame, component: Column, path: str | None = None, kinds: tuple[str, ...] | None = KINDS) -> DataFrame:
    """component, files, symbols; most symbols first."""
    if kinds:
        symbols = symbols.where(F.col("kind").isin(*kinds))
    if path:
        symbols = symbols.where(F.lower("file_path").startswith(path.lower()))
    per = symbols.groupBy(component.alias("component")).agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))
    return per.orderBy(F.desc("symbols"), "component")


def coupling_matrix(edges: DataFrame, members: DataFrame) -> DataFrame:
    """a, b, n: edges from component a to component b; members has id and component."""
    src, dst = members.select(F.col("id").alias("sid"), F.col("component").alias("a")), members.select(F.col("id").alias("tid"), F.col("component").alias("b"))
    return edges.join(src, F.col("source_symbol_id") == F.col("sid")).join(dst, F.col("target_symbol_id") == F.col("tid")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def coupling_pairs(matrix: DataFrame) -> DataFrame:
    """a < b, coupling = (n_ab + n_ba) / (row_a + row_b)."""
    rows = matrix.groupBy("a").agg(F.sum("n").alias("row"))
    both = matrix.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"))
    r1, r2 = rows.select(F.col("a").alias("ra"), F.col("row").alias("row_a")), rows.select(F.col("a").alias("rb"), F.col("row").alias("row_b"))
    total = F.coalesce("row_a", F.lit(0)) + F.coalesce("row_b", F.lit(0))
    return both.join(r1, F.col("a") == F.col("ra"), "left").join(r2, F.col("b") == F.col("rb"), "left").select("a", "b", (F.col("n") / total).alias("coupling"))


def clusters(components: DataFrame, pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """component, cluster: connected components of the pairs at or over the threshold (clamped to 0.01..1).

    The number of components is that of directories, not of rows: label
    propagation by joins, at most as many rounds as the longest chain.
    """
    threshold = min(max(threshold, 0.01), 1.0)
    strong = pairs.where(F.col("coupling") >= threshold).select("a", "b")
    links = cut(strong.union(strong.select("b", "a")).toDF("a", "b").distinct())
    labels = components.select("component").distinct().withColumn("cluster", F.col("component"))
    while True:
        near = links.join(labels, F.col("b") == F.col("component")).groupBy("a").agg(F.min("cluster").alias("near"))
        after = cut(labels.join(near, F.col("component") == F.col("a"), "left").select("component", F.least("cluster", F.coalesce("near", "cluster")).alias("new"), "cluster"))
        if after.where("new <> cluster").isEmpty():
            return after.select("component", F.col("new").alias("cluster"))
        labels = after.select("component", F.col("new").alias("cluster"))


def cluster_cohesion(members: DataFrame, matrix: DataFrame) -> DataFrame:
    """cluster, name (members joined by +), size, cohesion = internal / all edges of its members; 1 for singletons."""
    a, b = members.select(F.col("component").alias("ca"), F.col("cluster").alias("ka")), members.select(F.col("component").alias("cb"), F.col("cluster").alias("kb"))
    counted = matrix.join(a, F.col("a") == F.col("ca")).join(b, F.col("b") == F.col("cb"))
    per = counted.groupBy(F.col("ka").alias("k")).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("ka") == F.col("kb"), F.col("n")).otherwise(0)).alias("inside"))
    named = members.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("component")), "+").alias("name"), F.count(F.lit(1)).alias("size"))
    ratio = F.when(F.col("size") == 1, F.lit(1.0)).otherwise(F.coalesce(F.col("inside") / F.col("total"), F.lit(0.0)))
    return named.join(per, F.col("cluster") == F.col("k"), "left").select("cluster", "name", "size", ratio.alias("cohesion"))
