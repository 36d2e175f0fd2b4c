"""Facts about modules: exports, re-exports, importers, norms, test signals, candidates of whole files and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import directory, top_directory
from quillspan.operators.modules import IMPORT, NORM, first_callers, module_imports

DECLARED = r"(?m)^\s*export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|interface|type|enum|const|let|var|namespace)\s+([\w$]+)"
DEFAULT = r"(?m)^\s*export\s+default\b"
LISTED = r"""(?m)^\s*export\s+(?:type\s+)?\{([^}]*)\}(?:\s*from\s*['"]([^'"]+)['"])?"""
WILDCARD = r"""(?m)^\s*export\s+\*\s*(?:as\s+([\w$]+)\s+)?from\s*['"]([^'"]+)['"]"""
BARE = r"""(?m)^\s*import\s*['"]([^'"]+)['"]"""
INDEX = r"(^|/)index\.[cm]?[jt]sx?$"
TEST = r"\.(test|spec)\.[cm]?[jt]sx?$|(^|/)__tests__/"
FIXTURE = r"(^|/)(fixtures?|__fixtures__|mocks?|__mocks__|testdata)/"
#: Packages that run tests or belong to those that do.
RUNNERS = ("vitest", "jest", "@jest/globals", "mocha", "chai", "ava", "tap", "tape", "uvu", "jasmine", "node:test", "bun:test", "cypress", "@playwright/test", "supertest", "sinon")
TITLED = r"""(?m)^\s*(describe|it|test)(\.\w+)?\s*\(\s*['"`]"""
#: How many importers are named, and how many incoming edges.
MOST_IMPORTERS, MOST_EDGES = 12, 40
#: Fixed value: with fewer source files no module has facts.
LEAST_FILES = 10


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("source", F.lit(pattern), F.lit(group))


def _listed(names: Column) -> Column:
    """The exported names of a list in braces."""
    parts = F.filter(F.split(names, ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.element_at(F.split(F.regexp_replace(F.trim(x), r"^type\s+", ""), r"\s+as\s+"), -1))


def exports(files: DataFrame) -> DataFrame:
    """(file_path, name, kind) of what each file exports: `default`, `*` for a wildcard, `list` as the kind of listed names."""
    one = lambda name, kind: F.struct(name.alias("name"), kind.alias("kind"))
    declared = F.zip_with(_all(DECLARED, 2), _all(DECLARED, 1), one)
    listed = F.transform(F.flatten(F.transform(_all(LISTED, 1), _listed)), lambda n: one(n, F.lit("list")))
    wild = F.transform(_all(WILDCARD, 1), lambda n: one(F.when(n == "", "*").otherwise(n), F.lit("wildcard")))
    default = F.transform(F.slice(_all(DEFAULT, 0), 1, 1), lambda _: one(F.lit("default"), F.lit("default")))
    rows = files.select("file_path", F.explode(F.concat(declared, listed, wild, default)).alias("e"))
    return rows.groupBy("file_path", "e.name").agg(F.min("e.kind").alias("kind"))


def reexports(files: DataFrame) -> DataFrame:
    """(file_path, specifier, name) of names that a file hands on from another, `*` for all."""
    listed = F.zip_with(_all(LISTED, 1), _all(LISTED, 2), lambda names, s: F.transform(_listed(names), lambda n: F.struct(s.alias("specifier"), n.alias("name"))))
    wild = F.zip_with(_all(WILDCARD, 1), _all(WILDCARD, 2), lambda n, s: F.struct(s.alias("specifier"), F.when(n == "", "*").otherwise(n).alias("name")))
    rows = files.select("file_path", F.explode(F.concat(F.flatten(listed), wild)).alias("e"))
    return rows.select("file_path", "e.*").where("specifier <> ''").distinct()


def specifiers(files: DataFrame) -> DataFrame:
    """(file_path, specifier) of imports, imports for effect, and re-exports."""
    return files.select("file_path", F.explode(F.array_distinct(F.concat(_all(IMPORT, 5), _all(BARE, 1), _all(LISTED, 2), _all(WILDCARD, 2)))).alias("specifier")).where("specifier <> ''")


def edges_in(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(target, source, position, total, truncated): the first importers of each file by path."""
    rows = first_callers(edges.select("target", "source").distinct(), ["target"], ["source"], most)
    return rows.withColumn("truncated", F.col("total") > most)


def importers(imports: DataFrame, most: int = MOST_IMPORTERS) -> DataFrame:
    """(owner, file_path, symbols): the first importers of each file with the names that they bind."""
    by_file = imports.where("resolved is not null and resolved <> file_path").groupBy(F.col("resolved").alias("owner"), "file_path").agg(F.array_sort(F.collect_set("imported")).alias("symbols"))
    return by_file.withColumn("position", F.row_number().over(W.partitionBy("owner").orderBy("file_path"))).where(F.col("position") <= most)


def barrel_norm(files: DataFrame) -> DataFrame:
    """One row: directories, how many have an index file, and whether most do."""
    dirs = files.groupBy(directory(F.col("file_path")).alias("dir")).agg(F.max(F.col("file_path").rlike(INDEX)).alias("indexed"))
    return _share(dirs.agg(F.count("*").alias("n"), F.count_if("indexed").alias("holding")))


def placement_norm(files: DataFrame) -> DataFrame:
    """One row: tests, how many have their subject in their directory, and whether most do."""
    stem = F.regexp_replace(F.regexp_replace("file_path", "^.*/", ""), r"(\.(test|spec))?\.[cm]?[jt]sx?$", "")
    f = files.select(directory(F.col("file_path")).alias("dir"), stem.alias("stem"), F.col("file_path").rlike(TEST).alias("test"))
    subjects = f.where("not test").select("dir", "stem", F.lit(True).alias("near")).distinct()
    return _share(f.where("test").join(subjects, ["dir", "stem"], "left").agg(F.count("*").alias("n"), F.count("near").alias("holding")))


def _share(row: DataFrame) -> DataFrame:
    return row.withColumn("is_norm", (F.col("n") > 0) & (F.col("holding") * 10 >= F.col("n") * int(NORM * 10)))


def test_files(files: DataFrame) -> DataFrame:
    """(file_path): files that are tests by name, or that import a runner or make titled test calls."""
    root = F.regexp_extract("specifier", r"^((?:@[^/]+/)?[^/]+)", 1)
    runs = module_imports(files).where(root.isin(*RUNNERS) | F.col("specifier").isin(*RUNNERS)).select("file_path")
    named = files.where(F.col("file_path").rlike(TEST) | F.col("source").rlike(TITLED)).select("file_path")
    return named.unionByName(runs).distinct()


def callers_by_test(calls: DataFrame, tests: DataFrame) -> DataFrame:
    """(owner, target, production, test): how many call sites of each function stand in tests and elsewhere."""
    flagged = calls.join(tests.select("file_path", F.lit(True).alias("_test")), "file_path", "left")
    return flagged.groupBy("owner", "target").agg(F.count_if(F.col("_test").isNull()).alias("production"), F.count("_test").alias("test"))


def module_rows(files: DataFrame, edges: DataFrame, new_files: DataFrame | None = None) -> DataFrame:
    """One row of facts a module: exports, imports, importers, importing areas, and the habits of the tree.

    None with fewer than LEAST_FILES files; none for a new file without a sibling in its directory.
    """
    e = edges.where("source <> target").select("source", "target").distinct()
    incoming = e.groupBy(F.col("target").alias("file_path")).agg(F.count("*").alias("importers"), F.count_distinct(top_directory(F.col("source"))).alias("areas"))
    outgoing = e.groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("imports"))
    names = exports(files).groupBy("file_path").agg(F.array_sort(F.collect_set("name")).alias("exports"))
    siblings = files.groupBy(directory(F.col("file_path")).alias("dir")).agg(F.count("*").alias("in_directory"))
    n = files.agg(F.count("*").alias("files")).where(F.col("files") >= LEAST_FILES)
    habits = barrel_norm(files).select(F.col("is_norm").alias("barrels")).join(placement_norm(files).select(F.col("is_norm").alias("tests_beside")), F.lit(True)).join(n, F.lit(True))
    out = files.select("file_path", directory(F.col("file_path")).alias("dir"), F.col("file_path").rlike(INDEX).alias("is_barrel"))
    for part, key in ((incoming, "file_path"), (outgoing, "file_path"), (names, "file_path"), (siblings, "dir")):
        out = out.join(part, key, "left")
    if new_files is not None:
        out = out.join(new_files.select("file_path", F.lit(True).alias("_new")), "file_path", "left").where("_new is null or in_directory > 1").drop("_new")
    return out.join(F.broadcast(habits), F.lit(True)).fillna(0, ["importers", "areas", "imports"])


def module_candidates(files: DataFrame) -> DataFrame:
    """One candidate for each file, with the shape of span texts."""
    return files.select("file_path", F.lit("module").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("module").alias("id"), "source").withColumnRenamed("source", "text")


def change_candidate(changes: DataFrame, ranges: DataFrame) -> DataFrame:
    """One candidate for a whole change: its first file that is not new (else its first), from its first changed line to its last."""
    first = changes.agg(F.min(F.struct(F.col("old_source").isNull().alias("new"), "file_path")).alias("x")).select(F.col("x.file_path").alias("file_path")).where("file_path is not null")
    lines = ranges.groupBy("file_path").agg(F.min("start").alias("start_line"), F.max("end").alias("end_line"))
    met = first.join(lines, "file_path", "left")
    return met.select("file_path", F.lit("change").alias("kind"), F.coalesce("start_line", F.lit(1)).cast("int").alias("start_line"), F.coalesce("end_line", F.lit(1)).cast("int").alias("end_line"), F.lit("change").alias("id"), F.lit("").alias("text"))
