"""Rules about modules and whole changes, over edges, exports and files before and after.

Edges have source and target; `fresh` are edges that the old snapshot lacks (all of them in an
audit, which has none). Each rule returns rows with file_path, the module it speaks of; no row
means that it abstains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import directory, name_tokens, top_directory
from quillspan.operators.module_facts import FIXTURE, INDEX, TEST
from quillspan.operators.relation_rules import package

KERNEL = r"(^|/)(shared|common|core|kernel|lib)/"
MISC = r"(^|/)(utils?|helpers?|misc|common|tools?|lib)\.[cm]?[jt]sx?$"
INTERNAL = r"(^|/)(internal|private|experimental|wip|draft)/"
EFFECT = r"^(?:await\s+)?(setInterval|setTimeout|fetch|console\.\w+|process\.(?:exit|on|chdir)|[\w$.]+\.(?:listen|connect|register|subscribe|on|write|writeFileSync)|new\s+Worker)\s*\("
#: Libraries that do the same job.
SHELVES = {
    "date": ("dayjs", "date-fns", "moment", "luxon", "@date-fns/tz", "date-fns-tz", "dayjs-plugin-utc"),
    "http": ("axios", "got", "node-fetch", "undici", "ky", "superagent", "node-fetch-native"),
    "schema": ("zod", "yup", "ajv", "joi", "valibot", "superstruct"),
    "logging": ("winston", "pino", "bunyan", "loglevel"),
    "id": ("uuid", "nanoid", "ulid"),
}
MOST = 12


def _stem(path: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^/]*$", "")


def _areas(edges: DataFrame) -> DataFrame:
    """(_t, importers, areas, runtime, importing) of each target: importing files, their areas, those outside tests."""
    e = edges.where("source <> target").select("source", "target").distinct()
    area = top_directory(F.col("source"))
    return e.groupBy(F.col("target").alias("_t")).agg(
        F.count("*").alias("importers"), F.count_distinct(area).alias("areas"), F.count_if(~F.col("source").rlike(TEST)).alias("runtime"), F.array_sort(F.collect_set(area)).alias("importing")
    )


def _names(exports: DataFrame, alias: str) -> DataFrame:
    return exports.groupBy("file_path").agg(F.array_sort(F.collect_set("name")).alias(alias))


def export_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, added, removed, kept) of files that stand in both snapshots' exports."""
    met = _names(before, "b").join(_names(after, "a"), "file_path")
    return met.select("file_path", F.array_except("a", "b").alias("added"), F.array_except("b", "a").alias("removed"), F.array_intersect("a", "b").alias("kept"))


def barrel_bypass(fresh: DataFrame, edges: DataFrame, handed_on: DataFrame, least: int = 2) -> DataFrame:
    """New imports of a file from outside its directory though the index there re-exports it (handed_on: barrel, target),
    with how many outside files take the index and how many the file."""
    outside = edges.where(directory(F.col("source")) != directory(F.col("target"))).select("source", "target").distinct()
    users = outside.groupBy(F.col("target").alias("_t")).agg(F.count("*").alias("n"))
    own = handed_on.where(F.col("barrel").rlike(INDEX) & (directory(F.col("barrel")) == directory(F.col("target")))).select("barrel", F.col("target").alias("_target")).distinct()
    met = fresh.where(directory(F.col("source")) != directory(F.col("target"))).select("source", "target").distinct().join(own, F.col("target") == F.col("_target"))
    met = met.join(users.withColumnsRenamed({"_t": "_b", "n": "via_barrel"}), F.col("barrel") == F.col("_b"), "left").join(users.withColumnRenamed("n", "direct"), F.col("target") == F.col("_t"), "left").fillna(0, ["via_barrel", "direct"])
    return met.where(F.col("via_barrel") + F.col("direct") >= least).select(F.col("source").alias("file_path"), "target", "barrel", "via_barrel", "direct")


def concrete_stable_module(exports: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Modules that `least` files or more import and that export no type at all."""
    kinds = exports.groupBy("file_path").agg(F.count_if(F.col("kind").isin("interface", "type", "enum")).alias("abstract"), F.count_if(F.col("kind").isin("function", "function*", "class", "const", "let", "var", "default")).alias("concrete"))
    return kinds.where("abstract = 0 and concrete > 0").join(_areas(edges), F.col("file_path") == F.col("_t")).where(F.col("importers") >= least).select("file_path", "concrete", "importers")


def cross_area_export_break(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that lost exports and are imported from two areas or more."""
    lost = export_changes(before, after).where(F.size("removed") > 0)
    return lost.join(_areas(edges), F.col("file_path") == F.col("_t")).where("areas >= 2").select("file_path", "removed", "areas", "runtime")


def stable_surface_widening(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that only gained exports and are imported from two areas or more."""
    grown = export_changes(before, after).where((F.size("removed") == 0) & (F.size("added") > 0))
    return grown.join(_areas(edges), F.col("file_path") == F.col("_t")).where("areas >= 2").select("file_path", "added", "importers", "areas", "runtime")


def cross_context_test_reach(fresh: DataFrame) -> DataFrame:
    """New imports of another area's tests or fixtures by a file that is no test; the first target of each file."""
    reach = fresh.where(~F.col("source").rlike(TEST) & (F.col("target").rlike(TEST) | F.col("target").rlike(FIXTURE)) & (top_directory(F.col("source")) != top_directory(F.col("target"))))
    return reach.groupBy(F.col("source").alias("file_path")).agg(F.min("target").alias("target"))


def shared_kernel_new_consumer(fresh: DataFrame, edges: DataFrame) -> DataFrame:
    """New imports of a shared module of another area by an area that had none; of several the most entrenched."""
    own = top_directory(F.col("source"))
    new = fresh.select("source", "target").distinct().withColumn("area", own).where(F.col("target").rlike(KERNEL) & (F.col("area") != top_directory(F.col("target"))))
    old = edges.select("source", "target").distinct().join(fresh.select("source", "target"), ["source", "target"], "left_anti")
    before = old.select(F.col("target").alias("_ot"), own.alias("_oa")).distinct()
    met = new.join(before, (F.col("target") == F.col("_ot")) & (F.col("area") == F.col("_oa")), "left_anti").join(_areas(old), F.col("target") == F.col("_t"))
    best = F.min(F.struct((-F.col("areas")).alias("a"), (-F.col("importers")).alias("i"), "target")).alias("x")
    return met.groupBy(F.col("source").alias("file_path")).agg(best).select("file_path", "x.target", (-F.col("x.a")).alias("areas"), (-F.col("x.i")).alias("importers"))


def skipped_level_import(fresh_imports: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """New relative imports (file_path, specifier, resolved) that climb two directories or more past an index file nearer
    to them than their target, with the tree's median climb."""
    climb = F.size(F.split("specifier", r"\.\./")) - 1
    typical = imports.where("startswith(specifier, '.')").select("file_path", "specifier").distinct().agg(F.percentile_approx(climb, 0.5).alias("typical"))
    new = fresh_imports.select("file_path", "specifier").distinct().withColumn("climb", climb).where("climb >= 2")
    steps = F.split(directory(F.col("file_path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.col("climb") - 1), lambda k: F.struct(k.alias("up"), F.array_join(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - k, F.lit(0))), "/").alias("dir")))
    barrels = files.where(F.col("file_path").rlike(INDEX)).select(directory(F.col("file_path")).alias("_dir"), F.col("file_path").alias("barrel"))
    met = new.withColumn("u", F.explode(up)).join(barrels, F.col("u.dir") == F.col("_dir"))
    near = met.groupBy("file_path", "specifier", "climb").agg(F.min(F.struct("u.up", "barrel")).alias("x"))
    return near.join(F.broadcast(typical), F.lit(True)).select("file_path", "specifier", "climb", "x.barrel", "typical")


def stable_to_volatile_edge(fresh: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """New imports by a module that `least` files or more import of one that no other file imports, or that is marked internal."""
    degree = _areas(edges).select("_t", "importers", "areas")
    new = fresh.where("source <> target").select("source", "target").distinct()
    met = new.join(degree.withColumnRenamed("_t", "_s"), F.col("source") == F.col("_s")).where(F.col("importers") >= least).select("source", "target", F.col("importers").alias("own"), F.col("areas").alias("own_areas"))
    met = met.join(degree, F.col("target") == F.col("_t"), "left").where((F.coalesce("importers", F.lit(0)) <= 1) | F.col("target").rlike(INTERNAL))
    return met.select(F.col("source").alias("file_path"), "target", F.col("own").alias("importers"), F.col("own_areas").alias("areas"))


def same_stem_divergent_role(files: DataFrame, exports: DataFrame, most: int = 6) -> DataFrame:
    """Files of one stem in different areas without a common export."""
    f = files.select("file_path", _stem("file_path").alias("stem"), top_directory(F.col("file_path")).alias("area")).where("stem <> 'index'").join(_names(exports, "names"), "file_path")
    g = f.select(F.col("file_path").alias("twin"), F.col("stem").alias("_stem"), F.col("area").alias("_area"), F.col("names").alias("_names"))
    met = f.join(g, (F.col("stem") == F.col("_stem")) & (F.col("area") != F.col("_area"))).where(~F.arrays_overlap("names", "_names"))
    return met.withColumn("position", F.row_number().over(W.partitionBy("file_path").orderBy("twin"))).where(F.col("position") <= most).select("file_path", "stem", "twin")


def owners_of(files: DataFrame, owner_files: DataFrame) -> DataFrame:
    """(file_path, owners): the owners of the last line of the first owners' file whose pattern holds."""
    first = owner_files.agg(F.min(F.struct(F.length("file_path").alias("n"), "file_path", "source")).alias("x")).select(F.split("x.source", "\n").alias("lines")).where("lines is not null")
    kept = F.filter(F.transform("lines", lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x != "")
    body = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\*\*/?", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*")
    anchored = lambda p: F.concat(F.when(p.startswith("/") | p.rlike("/."), "^").otherwise("(^|/)"), body(F.regexp_replace(p, "^/", "")), F.when(p.endswith("/"), "").otherwise("(/|$)"))
    rules = first.select(F.transform(kept, lambda x: F.struct(anchored(F.get(F.split(x, r"\s+"), F.lit(0))).alias("pattern"), F.array_sort(F.slice(F.split(x, r"\s+"), F.lit(2), F.size(F.split(x, r"\s+")))).alias("owners"))).alias("rules"))
    held = F.filter("rules", lambda r: F.regexp_like(F.col("file_path"), r["pattern"]))
    return files.select("file_path").join(F.broadcast(rules), F.lit(True)).where(F.size(held) > 0).select("file_path", F.element_at(held, -1)["owners"].alias("owners"))


def team_boundary_crossing(fresh: DataFrame, edges: DataFrame, owners: DataFrame) -> DataFrame:
    """New imports between files without a common owner, with how often older imports join the same owners."""
    s, t = (owners.select(F.col("file_path").alias(f"_{x}"), F.col("owners").alias(f"{x}_owners")) for x in ("s", "t"))
    named = lambda e: e.select("source", "target").distinct().join(s, F.col("source") == F.col("_s")).join(t, F.col("target") == F.col("_t")).where(~F.arrays_overlap("s_owners", "t_owners") & (F.size("s_owners") > 0) & (F.size("t_owners") > 0))
    old = named(edges.join(fresh.select("source", "target"), ["source", "target"], "left_anti")).groupBy("s_owners", "t_owners").agg(F.count("*").alias("precedent"))
    return named(fresh).join(old, ["s_owners", "t_owners"], "left").select(F.col("source").alias("file_path"), "target", F.col("s_owners").alias("from"), F.col("t_owners").alias("to"), F.coalesce("precedent", F.lit(0)).alias("precedent"))


def utils_grab_bag_growth(before: DataFrame, after: DataFrame, least: int = 3) -> DataFrame:
    """Files of miscellany that gained an export about something new beside `least` subjects."""
    subject = lambda names: F.array_distinct(F.transform(names, lambda n: F.element_at(name_tokens(n), -1)))
    d = export_changes(before, after).where(F.col("file_path").rlike(MISC))
    d = d.withColumns({"domains": subject(F.concat("kept", "removed")), "fresh": F.array_except(subject(F.col("added")), subject(F.concat("kept", "removed")))})
    return d.where((F.size("domains") >= least) & (F.size("fresh") > 0)).select("file_path", "added", F.size("domains").alias("subjects"), "fresh")


def import_time_side_effect(files: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """Statements that act while a module is imported: calls at the left margin that start timers, requests, listeners or writes."""
    found = F.filter(F.split("source", "\n"), lambda x: x.rlike(EFFECT))
    rows = files.where(~F.col("file_path").rlike(TEST)).select("file_path", F.transform(F.slice(found, 1, most), lambda x: F.substring(x, 1, 500)).alias("effects"), F.size(found).alias("total")).where("total > 0")
    return rows.join(_areas(edges), F.col("file_path") == F.col("_t"), "left").select("file_path", "effects", "total", F.coalesce("importers", F.lit(0)).alias("importers"))


def self_authored_exam(new_files: DataFrame, edges: DataFrame) -> DataFrame:
    """New files of which all tests that import them are new as well."""
    n = new_files.select("file_path").distinct()
    tested = edges.where(F.col("source").rlike(TEST)).select(F.col("source").alias("test"), F.col("target").alias("file_path")).distinct().join(n, "file_path", "left_semi")
    flagged = tested.join(n.select(F.col("file_path").alias("test"), F.lit(True).alias("_new")), "test", "left")
    return flagged.groupBy("file_path").agg(F.array_sort(F.collect_set("test")).alias("tests"), F.count("_new").alias("new_tests")).where(F.size("tests") == F.col("new_tests")).select("file_path", "tests")


def mutable_surface_expansion(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that newly export a binding that can be set anew, with their importers."""
    let = after.where("kind in ('let', 'var')").select("file_path", "name").join(before.select("file_path", "name"), ["file_path", "name"], "left_anti")
    return let.groupBy("file_path").agg(F.array_sort(F.collect_set("name")).alias("bindings")).join(_areas(edges), F.col("file_path") == F.col("_t")).select("file_path", "bindings", "importers")


def utility_module_grab_bag(before: DataFrame, after: DataFrame, imports: DataFrame) -> DataFrame:
    """Files of miscellany with a new export whose importers share none with another export's."""
    uses = imports.where("resolved is not null").select(F.col("resolved").alias("file_path"), F.col("imported").alias("name"), F.col("file_path").alias("user")).distinct()
    feet = after.where(F.col("file_path").rlike(MISC)).select("file_path", "name").join(uses, ["file_path", "name"]).groupBy("file_path", "name").agg(F.array_sort(F.collect_set("user")).alias("users"))
    new = feet.join(before.select("file_path", "name"), ["file_path", "name"], "left_anti")
    old = feet.join(before.select("file_path", "name"), ["file_path", "name"], "left_semi").select(F.col("file_path").alias("_f"), F.col("name").alias("other"), F.col("users").alias("_users"))
    met = new.join(old, F.col("file_path") == F.col("_f")).where(~F.arrays_overlap("users", "_users"))
    return met.groupBy("file_path", "name").agg(F.array_sort(F.collect_set("other")).alias("apart_from"))


def second_shelf_dependency(fresh_imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """New imports of a package that does the job of another one in the manifest."""
    shelf = F.lit(None).cast("string")
    for job, names in SHELVES.items():
        shelf = F.when(F.col("name").isin(*names), F.lit(job)).otherwise(shelf)
    have = dependencies.select("name").distinct().withColumn("job", shelf).where("job is not null").select("job", F.col("name").alias("incumbent"))
    new = fresh_imports.select("file_path", package(F.col("specifier")).alias("name")).distinct().withColumn("job", shelf).where("job is not null")
    return new.join(have, "job").where("name <> incumbent").groupBy("file_path", "name", "job").agg(F.array_sort(F.collect_set("incumbent")).alias("incumbents"))
