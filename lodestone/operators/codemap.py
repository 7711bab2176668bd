"""Statistics of a corpus, directory tree, dependency edges and import matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = ["0-5", "5-10", "10-20", "20-50", "50+"]


def totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")
    )


def overview(files: DataFrame) -> DataFrame:
    """One row (files, size, tokens, average, languages) in one pass over the files: average complexity of those that have any; languages, an array of (value, n)."""
    some = F.when(F.col("complexity") > 0, F.col("complexity"))
    per = files.groupBy("language").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("token_count").alias("tokens"), F.sum(some).alias("c"), F.count(some).alias("rated")
    )
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        whole("n").alias("files"), whole("size").alias("size"), whole("tokens").alias("tokens"), F.coalesce(F.try_divide(F.sum("c"), F.sum("rated")), F.lit(0.0)).alias("average"),
        F.array_sort(F.collect_list(F.struct(F.col("language").alias("value"), "n"))).alias("languages"),
    )


def counts(files: DataFrame) -> DataFrame:
    """Rows (kind, value, n): files by language and by file type, in one pass by grouping sets."""
    g = files.groupingSets([["language"], ["file_type"]], "language", "file_type")
    kind = F.when(F.grouping("language") == 0, "language").otherwise("file_type")
    return g.agg(F.count("*").alias("n"), kind.alias("kind")).select("kind", F.coalesce("language", "file_type").alias("value"), "n")


def import_counts(files: DataFrame) -> DataFrame:
    """Rows (path, imports, imported_by): the import matrix's row and column sums, of files that have any."""
    e = dependency_edges(files)
    one = lambda c, k: e.groupBy(F.col(c).alias("path")).agg(F.count("*").alias(k))
    both = one("src", "imports").join(one("dst", "imported_by"), "path", "full")
    return both.select("path", F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("imported_by", F.lit(0)).alias("imported_by"))


def complexity_stats(files: DataFrame) -> DataFrame:
    c = F.when(F.col("complexity") > 0, F.col("complexity"))
    return files.agg(F.coalesce(F.avg(c), F.lit(0.0)).alias("average"), F.coalesce(F.max(c), F.lit(0.0)).alias("maximum"))


def bin_of(c: Column) -> Column:
    return F.when(c < 5, 0).when(c < 10, 1).when(c < 20, 2).when(c < 50, 3).otherwise(4)


def complexity_histogram(files: DataFrame) -> DataFrame:
    """Rows (bin, n) with empty bins; files of complexity 0 (without a parser) aren't counted."""
    spark = files.sparkSession
    names = spark.createDataFrame(list(enumerate(BINS)), "b int, bin string")
    n = files.where("complexity > 0").groupBy(bin_of(F.col("complexity")).alias("b")).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(n, "b", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_dependencies(files: DataFrame) -> DataFrame:
    d = files.select(F.explode(F.concat(
        F.transform("internal_dependencies", lambda x: F.struct(F.lit("i").alias("k"), x.alias("d"))),
        F.transform("external_dependencies", lambda x: F.struct(F.lit("e").alias("k"), x.alias("d"))),
    )).alias("x"))
    return d.agg(
        F.countDistinct(F.when(F.col("x.k") == "i", F.col("x.d"))).alias("internal"),
        F.countDistinct(F.when(F.col("x.k") == "e", F.col("x.d"))).alias("external"),
    )


def top_imports(files: DataFrame, n: int = 10) -> DataFrame:
    each = files.select(F.explode("imports").alias("import"))
    return each.groupBy("import").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "import").limit(n)


def extremes(files: DataFrame, n: int = 5) -> DataFrame:
    """Rows (kind, rank, path, value): the largest and the most complex files."""
    out = None
    for kind, col in (("largest", "size"), ("most_complex", "complexity")):
        few = files.select("path", F.col(col).cast("double").alias("value")).orderBy(F.desc("value"), "path").limit(n)
        w = Window.orderBy(F.desc("value"), "path")  # over n rows
        part = few.select(F.lit(kind).alias("kind"), F.row_number().over(w).alias("rank"), "path", "value")
        out = part if out is None else out.unionByName(part)
    return out


def tree(files: DataFrame) -> DataFrame:
    """Rows (path, parent, name, depth, is_last) of all folders and files, each once."""
    p = F.split("path", "/")
    at = F.explode(F.sequence(F.lit(1), F.size(p))).alias("depth")
    nodes = files.select(p.alias("p"), at).select(
        F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("path"),
        F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), "/").alias("parent"),
        F.element_at("p", F.col("depth")).alias("name"), "depth",
    ).distinct()
    w = Window.partitionBy("parent").orderBy("name")
    return nodes.withColumn("is_last", F.lead("name").over(w).isNull())


def tree_text(files: DataFrame) -> DataFrame:
    """Rows (path, line): the tree drawn, a line per node; in order of path parts."""
    nodes = tree(files)
    up = nodes.select("path", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("d"), F.split("path", "/").alias("p"))
    anc = up.select("path", "d", F.array_join(F.slice("p", F.lit(1), F.col("d")), "/").alias("a"))
    marked = anc.join(nodes.select(F.col("path").alias("a"), "is_last"), "a")
    seq = marked.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("d", "is_last"))).alias("m"))
    lead = F.transform(F.slice("m", F.lit(1), F.size("m") - 1), lambda x: F.when(x["is_last"], F.lit("    ")).otherwise(F.lit("│   ")))
    own = F.when(F.element_at("m", -1)["is_last"], F.lit("└── ")).otherwise(F.lit("├── "))
    return seq.select("path", F.concat(F.array_join(lead, ""), own, F.element_at(F.split("path", "/"), -1)).alias("line"))


def _grams(c: Column, q: Column) -> Column:
    """Hashes of the distinct substrings of q characters."""
    at = F.sequence(F.lit(1), F.length(c) - q + 1)
    return F.when(F.length(c) >= q, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.substring(c, i, q))))).otherwise(F.array().cast("array<long>"))


#: Lengths of grams. A name has those of the greatest length that isn't above its own, half of it at least (up to 192 characters).
_Q = (1, 2, 3, 6, 12, 24, 48, 96)


def candidates(names: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (dep, dst): for a name (dep) all targets (dst) that may contain it.

    What contains a name contains all its grams. A name looks only under the one of its grams that the fewest targets have; as a
    gram is at least half of its name, these are few more than the targets that have the name. Grams that collide only add to them.
    """
    dep, dst = F.col("dep"), F.col("dst")
    q = F.greatest(*[F.when(F.length(dep) >= n, n) for n in _Q], F.lit(1))
    keyed = names.select("dep", q.alias("q")).select("dep", "q", _grams(dep, F.col("q")).alias("own"))
    used = keyed.agg(F.collect_set("q").alias("sizes"))  # one row of at most eight numbers
    grams = F.flatten(F.transform("sizes", lambda n: _grams(dst, n)))
    index = targets.select("dst").distinct().join(F.broadcast(used), F.lit(True)).select("dst", F.explode(F.array_distinct(grams)).alias("gram"))
    counted = index.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no target has rules its name out.
    each = keyed.select("dep", F.size("own").alias("of"), F.explode("own").alias("gram")).join(counted, "gram")
    rare = each.groupBy("dep", "of").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("found")).where("found = of")
    return rare.join(index, "gram").select("dep", "dst")


def containing(names: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (dep, dst) of all names (dep) that occur in a target (dst): exact, without comparing every name with every target."""
    return candidates(names, targets).where(F.col("dst").contains(F.col("dep")))


def dependency_edges(files: DataFrame) -> DataFrame:
    """Distinct edges (src, dst): a dependency occurs in a file's path. (That it is the stem of the file's name is one case of this.)

    An edge is made under the first of its source's dependencies that occurs in its target, so edges needn't be shuffled to be distinct.
    """
    own = files.groupBy(F.col("path").alias("src")).agg(F.array_distinct(F.flatten(F.collect_list("imports"))).alias("deps"))
    dep = own.select("src", "deps", F.posexplode("deps").alias("i", "dep")).where("dep <> ''")
    inside = containing(dep.select("dep").distinct(), files.select(F.col("path").alias("dst")))
    before = F.filter(F.slice("deps", F.lit(1), F.col("i")), lambda x: x != "")
    each = dep.select("src", "dep", before.alias("before")).join(inside, "dep")
    return each.where((F.size("before") == 0) | ~F.exists("before", lambda x: F.col("dst").contains(x))).select("src", "dst")


def import_matrix(files: DataFrame) -> DataFrame:
    """Rows (src, dst, imports, total) for all pairs of files, and how many of all pairs are imports: a report on few files."""
    e = dependency_edges(files).withColumn("hit", F.lit(True))
    a, b = files.select(F.col("path").alias("src")), files.select(F.col("path").alias("dst"))
    every = a.crossJoin(b).join(e, ["src", "dst"], "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("imports"))
    total = e.agg(F.count("*").alias("total"))  # one row
    return every.join(F.broadcast(total), F.lit(True))


def export_edges(files: DataFrame) -> DataFrame:
    """Distinct edges (src, dst): a file imports a symbol that another exports; the last exporter by path has it."""
    owner = files.select(F.explode("exports").alias("symbol"), "path").groupBy("symbol").agg(F.max("path").alias("dst"))
    uses = files.select(F.col("path").alias("src"), F.explode("imports").alias("symbol"))
    return uses.join(owner, "symbol").where("src <> dst").select("src", "dst").distinct()


def module_clusters(files: DataFrame) -> DataFrame:
    """Rows (module, n, paths): files by their module path less its last part; files of one part are in none."""
    m = F.regexp_extract("module_path", r"^(.+)\.[^.]*$", 1)
    named = files.where(m != "")
    return named.groupBy(m.alias("module")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))


def top_importers(edges: DataFrame, n: int = 10, shown: int = 3) -> DataFrame:
    """Rows (src, targets, more): the files with most targets, a few of them named."""
    g = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("t"))
    few = g.orderBy(F.size("t").desc(), "src").limit(n)
    return few.select("src", F.slice("t", 1, shown).alias("targets"), F.greatest(F.size("t") - shown, F.lit(0)).alias("more"))
