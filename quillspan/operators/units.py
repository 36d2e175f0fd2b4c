"""Units of a tree: the nearest manifest above each file, what it declares, and what reaches over its border."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import blanked, code_lines, directory, top_directory
from quillspan.operators.modules import manifest_dependencies
from quillspan.operators.references import IMPORTING
from quillspan.operators.relation_rules import INDEX_FILE, is_test_file, package

MANIFEST = r"(^|/)package\.json$"
HOST = r"https?://([A-Za-z0-9.-]+(?::\d+)?)"
OUTBOUND = r"fetch\s*\(|axios|XMLHttpRequest|WebSocket|EventSource|createConnection|net\.connect|\.get\s*\(|\.post\s*\(|\.request\s*\("
CARE = r"(?i)\b(retry|timeout|signal|AbortController|trace|span|otel|metric|log)\b"
WRAPPER = r"(?i)(client|http|api|transport|fetch|request)[^/]*$"
LOCAL = r"^(localhost|127\.0\.0\.1|::1|example\.(com|org|net))(:\d+)?$|\.test(:\d+)?$"
WRITE = r"(?<![\w$.])([A-Za-z_$][\w$]*)(?:(?:\.[\w$]+|\[[^\]\n]*\])*\s*(?:[-+*/|&?]{0,2}=(?![=>])|\+\+|--)|(?:\.[\w$]+)*\.(?:push|set|add|delete|clear|splice|assign)\()"
SETTER = r"^export\s+(?:async\s+)?(?:function\s+|const\s+)(?:set|update|replace|reset|register)[A-Z]"
#: Fixed value: files of a unit that are named as fellow users of a package.
MOST_SIBLINGS = 10


def ancestors(path: Column) -> Column:
    """The directories above a path, the root (an empty text) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def nearest(paths: DataFrame, units: DataFrame) -> DataFrame:
    """(path, unit): the deepest of `units` (directories, column unit) above each path; paths without one have no row.

    Directories are looked up, not paths, each with the directories above it; the root, which stands above all,
    is no key of the join but what is left where no deeper unit is found.
    """
    dirs = paths.select(directory(F.col("path")).alias("dir")).distinct()
    above = dirs.select("dir", F.explode(ancestors(F.concat("dir", F.lit("/")))).alias("unit")).where("unit <> ''")
    known = units.select("unit").distinct()
    found = above.join(known.where("unit <> ''"), "unit").groupBy("dir").agg(F.max_by("unit", F.length("unit")).alias("unit"))
    root = known.where("unit = ''").agg(F.max("unit").alias("_root"))  # one row, null without a manifest at the root
    met = dirs.join(found, "dir", "left").join(F.broadcast(root), F.lit(True))
    met = met.select("dir", F.coalesce("unit", "_root").alias("unit")).where("unit is not null")
    return paths.select("path").distinct().withColumn("dir", directory(F.col("path"))).join(met, "dir").select("path", "unit")


def manifests_of(files: DataFrame) -> DataFrame:
    """(file_path, unit, package_name) of the manifests of a tree that are JSON objects."""
    read = files.where(F.col("file_path").rlike(MANIFEST)).select("file_path", directory(F.col("file_path")).alias("unit"), F.from_json("source", "name string, dependencies map<string,string>").alias("m"), "source")
    return read.where("m is not null and ltrim(source) like '{%'").select("file_path", "unit", F.col("m.name").alias("package_name"))


def manifest_facts(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_path, package, unit, section, siblings, n_siblings): the packages that a file imports, whether and where the nearest
    manifest declares them (section null: not at all), and the first other files of the unit that import them."""
    units = manifests_of(files)
    used = imports.select("file_path", package(F.col("specifier")).alias("package")).where("package <> '' and not startswith(package, 'node:')").distinct()
    at = nearest(used.select(F.col("file_path").alias("path")), units).withColumnRenamed("path", "file_path")
    placed = used.join(at, "file_path", "left")
    declared = manifest_dependencies(files.where(F.col("file_path").rlike(MANIFEST))).select(directory(F.col("file_path")).alias("unit"), F.col("name").alias("package"), "section")
    declared = declared.groupBy("unit", "package").agg(F.min("section").alias("section"))
    by = W.partitionBy("unit", "package")
    users = placed.where("unit is not null").select("unit", "package", "file_path", F.row_number().over(by.orderBy("file_path")).alias("r"))
    # one more than are told, so that a file can be left out of its own list
    first = users.where(F.col("r") <= MOST_SIBLINGS + 1).groupBy("unit", "package").agg(F.array_sort(F.collect_list("file_path")).alias("all"))
    counts = users.groupBy("unit", "package").agg(F.count("*").alias("n"))
    met = placed.join(declared, ["unit", "package"], "left").join(first, ["unit", "package"], "left").join(counts, ["unit", "package"], "left")
    others = F.slice(F.array_except("all", F.array("file_path")), 1, MOST_SIBLINGS)
    return met.select("file_path", "package", "unit", "section", F.coalesce(others, F.array().cast("array<string>")).alias("siblings"), F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_siblings"))


def cross_service_source_reach(fresh: DataFrame, new_imports: DataFrame, files: DataFrame) -> DataFrame:
    """New imports of files that belong to another unit, by a relative path or by the other unit's package name; a tree with one manifest has no borders."""
    units = manifests_of(files)
    many = units.agg(F.count("*").alias("_n")).where("_n >= 2")
    at = nearest(files.select(F.col("file_path").alias("path")), units)
    own = at.select(F.col("path").alias("file_path"), F.col("unit").alias("own_unit"))
    other = at.select(F.col("path").alias("target"), F.col("unit").alias("target_unit"))
    by_path = fresh.select(F.col("source").alias("file_path"), "target").distinct().join(own, "file_path").join(other, "target").where("own_unit <> target_unit")
    by_path = by_path.select("file_path", "target", "own_unit", "target_unit", F.lit("relative").alias("coupling"), F.col("target").rlike(INDEX_FILE).alias("by_entry"))
    named = units.where("package_name is not null").select(F.col("package_name").alias("_p"), F.col("unit").alias("target_unit"))
    bare = new_imports.select("file_path", "specifier", package(F.col("specifier")).alias("_p")).where("_p <> ''").distinct().join(named, "_p").join(own, "file_path").where("own_unit <> target_unit")
    by_name = bare.select("file_path", F.col("specifier").alias("target"), "own_unit", "target_unit", F.lit("workspace-package").alias("coupling"), (F.col("specifier") == F.col("_p")).alias("by_entry"))
    return by_path.unionByName(by_name).join(F.broadcast(many), F.lit(True)).drop("_n")  # one row


def _hosts(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("source", F.lit(HOST), F.lit(1)), lambda x: F.lower(x)))).alias("host"))


def unwrapped_service_edge(before: DataFrame, after: DataFrame, imports: DataFrame, least: int = 2) -> DataFrame:
    """Files that gained a host which neither they nor any other file named before, beside an outbound call, with the signs of care
    around it and whether the file uses a wrapper: a file named as one, or that imports packages for requests, with `least` importers."""
    old = _hosts(before).withColumn("_had", F.lit(True))
    new = _hosts(after).where(~F.col("host").rlike(LOCAL))
    users = new.groupBy("host").agg(F.count("*").alias("_files")).where("_files = 1")
    novel = new.join(users.select("host"), "host").join(old.select("host").distinct(), "host", "left_anti")
    lines = after.select("file_path", F.explode(F.split("source", "\n")).alias("line"))
    gone = before.select("file_path", F.explode(F.split("source", "\n")).alias("line")).distinct()
    added = lines.join(gone, ["file_path", "line"], "left_anti")
    calls = added.where(F.col("line").rlike(OUTBOUND)).select("file_path").distinct()
    care = added.select("file_path", F.explode(F.transform(F.regexp_extract_all("line", F.lit(CARE), F.lit(1)), lambda x: F.lower(x))).alias("c")).groupBy("file_path").agg(F.array_sort(F.collect_set("c")).alias("care"))
    wide = imports.where("resolved is not null and resolved <> file_path").groupBy(F.col("resolved").alias("wrapper")).agg(F.count_distinct("file_path").alias("n")).where(F.col("n") >= least)
    wrappers = wide.where(F.col("wrapper").rlike(WRAPPER) & ~is_test_file(F.col("wrapper"))).select("wrapper")
    wrapped = imports.join(wrappers, F.col("resolved") == F.col("wrapper")).select("file_path", F.lit(True).alias("wrapped")).distinct()
    met = novel.join(calls, "file_path", "left_semi").join(care, "file_path", "left").join(wrapped, "file_path", "left")
    return met.select("file_path", "host", F.coalesce("care", F.array().cast("array<string>")).alias("care"), F.coalesce("wrapped", F.lit(False)).alias("uses_wrapper"))


def new_foreign_state_write_edge(fresh: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Files that write to what they newly import: the binding, the ways of writing, and whether its file lets it be set anew or offers a setter."""
    new = fresh.select(F.col("source").alias("file_path"), F.col("target").alias("resolved")).distinct()
    bound = imports.where("resolved is not null and not type_only").join(new, ["file_path", "resolved"], "left_semi").select("file_path", "resolved", "imported", "local").distinct()
    code = blanked(code_lines(F.col("source")), IMPORTING)
    sites = files.select("file_path", F.explode(F.regexp_extract_all(code, F.lit(WRITE), F.lit(0))).alias("site")).select("file_path", F.regexp_extract("site", WRITE, 1).alias("local"), F.trim("site").alias("site"))
    wrote = sites.join(bound, ["file_path", "local"]).groupBy("file_path", "resolved", "imported", "local").agg(F.slice(F.array_sort(F.collect_set("site")), 1, MOST_SIBLINGS).alias("writes"))
    lines = files.select(F.col("file_path").alias("resolved"), F.explode(F.split("source", "\n")).alias("line"))
    held = lines.select("resolved", F.regexp_extract("line", r"^(?:export\s+)?(?:let|var)\s+([\w$]+)", 1).alias("imported")).where("imported <> ''").select("resolved", "imported", F.lit(True).alias("mutable")).distinct()
    setters = lines.where(F.col("line").rlike(SETTER)).select("resolved", F.lit(True).alias("setter")).distinct()
    out = wrote.join(held, ["resolved", "imported"], "left").join(setters, "resolved", "left")
    return out.select("file_path", F.col("resolved").alias("target"), "local", "writes", (F.coalesce("mutable", F.lit(False)) | (F.col("imported") == "*")).alias("mutable"), F.coalesce("setter", F.lit(False)).alias("offers_setter"))


def twin_gateway_emergence(new_imports: DataFrame, imports: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """New imports of a package for which another area has gateways: files outside tests that import it, the first of them with
    their importers, and whether the importing area uses one of them already."""
    area = lambda c: top_directory(F.col(c))
    p = package(F.col("specifier"))
    outside = (p != "") & ~F.col("specifier").startswith("node:")
    fresh = new_imports.where(outside).select("file_path", p.alias("dependency"), area("file_path").alias("area")).distinct()
    gates = imports.where(outside & ~is_test_file(F.col("file_path"))).select(p.alias("dependency"), F.col("file_path").alias("gateway"), area("file_path").alias("_area")).distinct()
    n = edges.where("source <> target").groupBy(F.col("target").alias("gateway")).agg(F.count_distinct("source").alias("importers"))
    gates = gates.join(n, "gateway", "left").withColumn("importers", F.coalesce("importers", F.lit(0)))
    # of each package the first files of each area, so that an area finds as many as are told outside itself
    by_area = F.row_number().over(W.partitionBy("dependency", "_area").orderBy("gateway"))
    first = gates.withColumn("r", by_area).where(F.col("r") <= most).drop("r")
    asked = fresh.select("dependency", "area").distinct()
    ranked = asked.join(first, "dependency").where("area <> _area").withColumn("r", F.row_number().over(W.partitionBy("dependency", "area").orderBy("gateway"))).where(F.col("r") <= most)
    told = ranked.groupBy("dependency", "area").agg(F.array_sort(F.collect_list(F.struct("gateway", "importers"))).alias("gateways"))
    uses = edges.select(area("source").alias("area"), F.col("target").alias("gateway")).distinct()
    reuse = asked.join(gates, "dependency").where("area <> _area").join(uses, ["area", "gateway"], "left_semi").select("dependency", "area", F.lit(True).alias("reused")).distinct()
    out = fresh.join(told, ["dependency", "area"]).join(reuse, ["dependency", "area"], "left")
    return out.select("file_path", "dependency", "gateways", F.coalesce("reused", F.lit(False)).alias("one_edge_away"))
