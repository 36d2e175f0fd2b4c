"""Rules whose evidence is a relation between files, functions or snapshots.

Inputs are small relations made once for a repository (see `functions_of`, `modules`); each rule is
a join or an aggregate of those and returns rows of evidence. No row means that the rule abstains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import directory, name_tokens, normalize_source, top_directory, uncommented
from quillspan.operators.graph import strong_components
from quillspan.operators.modules import first_callers, new_edges, within_steps
from quillspan.operators.near_sets import sketched
from quillspan.operators.similarity import jaccard_pairs, parts, set_clumps, shared_items
from quillspan.session import stored

HEAD = r"(?m)^\s*(export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s+([\w$]+)\s*(?:<[^>]*>)?\(([^)]*)\)|const\s+([\w$]+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?::[^=]+)?=>)"
CALL = r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\.)?[A-Za-z_$][\w$]*)\s*\(([^()]*)\)"
#: Words before a parenthesis that are no calls.
NO_CALL = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new")
TEST_FILE = r"\.(test|spec)\.[cm]?[jt]sx?$"
INDEX_FILE = r"(^|/)index\.[cm]?[jt]sx?$"
#: Fixed value: how many callers of a function are named.
MOST_CALLERS = 20
#: Cycles of up to so many edges are looked for first.
MOST_CYCLE = 8


def functions_of(spans: DataFrame) -> DataFrame:
    """(file_path, id, name, parameters, exported, start_line, text) of function spans that have a name."""
    part = lambda k: F.regexp_extract("text", HEAD, k)
    bare = lambda p: F.trim(F.regexp_extract(p, r"^\s*\.{0,3}([\w$]+)", 1))
    named = spans.where("kind = 'function'").withColumns({"name": F.concat(part(2), part(4)), "_p": F.concat(part(3), part(5))})
    parameters = F.filter(F.transform(F.split("_p", ","), bare), lambda p: p != "")
    return named.where("name <> ''").select("file_path", "id", "name", parameters.alias("parameters"), F.trim(part(1)).startswith("export").alias("exported"), "start_line", "text")


def calls_of(functions: DataFrame) -> DataFrame:
    """(file_path, caller, callee, arguments): calls by plain name, or by one name of another (`ns.f`), inside each function."""
    sites = functions.select("file_path", F.col("name").alias("caller"), F.posexplode(F.regexp_extract_all(uncommented(F.col("text")), F.lit(CALL), F.lit(0))).alias("position", "site"))
    rows = sites.select("file_path", "caller", "position", F.regexp_extract("site", CALL, 1).alias("callee"), F.regexp_extract("site", CALL, 2).alias("arguments"))
    return rows.where(~F.col("callee").isin(*NO_CALL) & (F.col("callee") != F.col("caller")))


def resolved_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds `owner`, the file that defines the callee: by import binding, else the caller's own file. A name of another
    name is a callee only where that one is bound to a whole module."""
    bound = imports.where("resolved is not null").select(F.col("file_path").alias("_f"), F.col("local").alias("_l"), F.col("imported").alias("_i"), F.col("resolved").alias("_r")).distinct()
    leaf = F.when(F.contains("callee", F.lit(".")), F.substring_index("callee", ".", -1))
    met = calls.withColumns({"_root": F.substring_index("callee", ".", 1), "_leaf": leaf})
    met = met.join(bound, (F.col("file_path") == F.col("_f")) & (F.col("_root") == F.col("_l")), "left").where("_leaf is null or _i = '*'")
    plain = F.when(F.col("_i").isNotNull() & (F.col("_i") != "default"), F.col("_i")).otherwise(F.col("callee"))
    named = met.withColumns({"owner": F.coalesce("_r", "file_path"), "target": F.coalesce("_leaf", plain)})
    known = functions.select(F.col("file_path").alias("_of"), F.col("name").alias("_on")).distinct()
    return named.join(known, (F.col("owner") == F.col("_of")) & (F.col("target") == F.col("_on")), "left_semi").select("file_path", "caller", "owner", "target", "arguments", "position")


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


# function rules ----------------------------------------------------------------------------------


def unused_exported_helper(functions: DataFrame, calls: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Exported functions that no file outside tests calls; nor, with `references` (owner, target, file_path), names as a value."""
    live = calls.where(~is_test_file(F.col("file_path"))).select(F.col("owner").alias("_o"), F.col("target").alias("_t"))
    if references is not None:
        live = live.unionByName(references.where(~is_test_file(F.col("file_path"))).select(F.col("owner").alias("_o"), F.col("target").alias("_t")))
    own = functions.where(F.col("exported") & ~is_test_file(F.col("file_path")))
    return own.join(live.distinct(), (F.col("file_path") == F.col("_o")) & (F.col("name") == F.col("_t")), "left_anti").select("file_path", "name")


def single_caller_exported_helper(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Exported functions with exactly one calling function, in another file."""
    outside = calls.where(~is_test_file(F.col("file_path"))).groupBy("owner", "target").agg(F.count_distinct("file_path", "caller").alias("callers"), F.min("file_path").alias("caller_file"))
    own = functions.where("exported").select("file_path", "name")
    met = own.join(outside, (F.col("file_path") == F.col("owner")) & (F.col("name") == F.col("target")))
    return met.where("callers = 1 and caller_file <> file_path").select("file_path", "name", "caller_file")


def data_clump(functions: DataFrame) -> DataFrame:
    """Three parameter names that three functions or more share."""
    in_order = lambda c: F.sort_array(F.array_compact(F.array_distinct(c))).alias("rest")
    own = stored(functions.select(F.concat_ws("#", "file_path", "name").alias("o"), in_order("parameters")))
    if not own.groupBy("o").count().where("count > 1").isEmpty():  # functions of one name in a file are one
        own = stored(own.groupBy("o").agg(in_order(F.flatten(F.collect_list("rest")))))
    return set_clumps(own, 3, 3)


def duplicated_logic(functions: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of functions that share `least` statements or more, compared without white space."""
    statement = F.explode(F.split("text", r"[;\n]")).alias("statement")
    rows = functions.select(F.concat_ws("#", "file_path", "name").alias("owner"), statement).withColumn("statement", F.regexp_replace("statement", r"\s+", ""))
    digest = F.unhex(F.substring(F.sha2("statement", 256), 1, 32)).alias("statement")  # 128 bits in place of a text
    return shared_items(rows.where(F.length("statement") > 12).select("owner", digest), "owner", "statement", least)


def clone_and_tweak_sibling(functions: DataFrame, least: float = 0.5) -> DataFrame:
    """The most similar other function of the same file by distinct tokens, at `least` Jaccard."""
    own = functions.where("name is not null and text is not null").select(F.struct("file_path").alias("g"), "name", "text")
    once = own.groupBy("g", "name").count().where("count > 1").isEmpty()

    def sets_of_some(rows: DataFrame) -> DataFrame:
        sets = rows.select("g", "name", F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*|\d+"), F.lit(0))).alias("t"))
        # functions of one name in a file are one
        return sets if once else sets.groupBy("g", "name").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"))

    # functions of equal tokens are one while the nearest are looked for: the least of them by name
    key = F.unhex(F.sha2(F.concat_ws(" ", F.sort_array("t")), 256))
    sets = stored(sketched(sets_of_some(own).withColumn("key", key), "t").where("sketch.n > 0"))
    first = sets.groupBy("g", "key").agg(F.min("name").alias("first"))
    members = stored(sets.select("g", "key", "name").join(first, ["g", "key"]).drop("key"))
    second = members.where("name <> first").groupBy("g", "first").agg(F.min("name").alias("second"))
    chosen = sets.join(members.where("name = first").select("g", "name"), ["g", "name"], "left_semi")
    # by a merge whatever the size, so that what is shuffled grows as the texts do
    fetch = lambda some: sets_of_some(own.join(some.hint("merge"), ["g", "name"], "left_semi")).withColumn("t", F.concat_ws(" ", "t"))
    pairs = jaccard_pairs(chosen.select("g", "name", "sketch"), "g", "name", "sketch", least, fetch)
    near = pairs.select("g", F.col("left").alias("first"), F.struct((-F.col("jaccard")).alias("j"), F.col("right").alias("sibling")).alias("near"))
    twin = F.when(F.col("name") != F.col("first"), F.col("first")).otherwise(F.col("second"))
    met = members.join(second, ["g", "first"], "left").join(near, ["g", "first"], "left")
    best = F.least("near", F.when(twin.isNotNull(), F.struct(F.lit(-1.0).alias("j"), twin.alias("sibling"))))
    return met.withColumn("best", best).where("best is not null").select("g.file_path", "name", "best.sibling", (-F.col("best.j")).alias("jaccard"))


def transitive_plumbing(functions: DataFrame) -> DataFrame:
    """Parameters that a function only hands on, with two other functions at least that do the same."""
    p = functions.select("file_path", "name", "text", F.explode("parameters").alias("parameter"))
    body = F.regexp_replace("text", r"(?s)^[^{]*\{", "")
    word = F.concat(F.lit(r"\b"), F.col("parameter"), F.lit(r"\b"))
    handed = F.concat(F.lit(r"[(,]\s*"), F.col("parameter"), F.lit(r"\s*(?=[,)])"))
    uses, passes = F.size(F.split(body, word)) - 1, F.size(F.split(body, handed)) - 1
    only = p.withColumns({"uses": uses, "passes": passes}).where("passes > 0 and uses = passes")
    sharing = F.count("*").over(W.partitionBy("parameter"))
    return only.withColumn("sharing", sharing).where("sharing >= 3").select("file_path", "name", "parameter", "sharing")


def sync_async_sibling_ambiguity(functions: DataFrame) -> DataFrame:
    """A synchronous and an asynchronous function of one stem in a file."""
    stem = F.regexp_replace("name", "(?i)(async|sync)$", "")
    f = functions.select("file_path", stem.alias("stem"), "name", F.col("text").rlike(r"^\s*(export\s+)?(default\s+)?async\b|=\s*async\b").alias("is_async"))
    return f.groupBy("file_path", "stem").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count_if("is_async").alias("n_async"), F.count("*").alias("n")).where("n_async > 0 and n_async < n").select("file_path", "stem", "names")


def punned_name(functions: DataFrame) -> DataFrame:
    """One function name with different parameters in different files."""
    return functions.groupBy("name").agg(F.count_distinct("file_path").alias("files"), F.count_distinct(F.array_join("parameters", ",")).alias("shapes")).where("files > 1 and shapes > 1")


def heterogeneous_primitive_callers(calls: DataFrame, least: int = 3) -> DataFrame:
    """Functions whose first argument goes by many names at its callers."""
    first = F.trim(F.regexp_extract("arguments", r"^\s*([\w$.]+)", 1))
    named = calls.select("owner", "target", F.element_at(F.split(first, r"\."), -1).alias("argument")).where("argument <> ''")
    return named.groupBy("owner", "target").agg(F.count_distinct("argument").alias("names")).where(F.col("names") >= least)


def callers(calls: DataFrame, most: int = MOST_CALLERS) -> DataFrame:
    """The first callers of each function and their number."""
    return first_callers(calls, ["owner", "target"], ["file_path", "caller", "position"], most).withColumnRenamed("total", "n_callers")


# change rules ------------------------------------------------------------------------------------


def wide_fan_in_edit(before: DataFrame, after: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions whose body changed and that are still called, with callers and calling files."""
    text = lambda f: F.regexp_replace(normalize_source(f), r"\s+", " ")
    b = before.select(F.col("file_path").alias("_f"), F.col("name").alias("_n"), text(F.col("text")).alias("_t"))
    edited = after.select("file_path", "name", text(F.col("text")).alias("t")).join(b, (F.col("file_path") == F.col("_f")) & (F.col("name") == F.col("_n"))).where("t <> _t").select("file_path", "name")
    fan = calls.select(F.col("owner").alias("_o"), "target", F.col("file_path").alias("from"), "caller")
    met = edited.join(fan, (F.col("file_path") == F.col("_o")) & (F.col("name") == F.col("target")))
    return met.groupBy("file_path", "name").agg(F.count("*").alias("callers"), F.count_distinct("from").alias("files"))


def breaking_export_reshape(before: DataFrame, after: DataFrame) -> DataFrame:
    """Exports that are gone or take more parameters than before."""
    b = before.where("exported").select("file_path", "name", F.size("parameters").alias("old"))
    a = after.where("exported").select("file_path", "name", F.size("parameters").alias("new"))
    j = b.join(a, ["file_path", "name"], "left")
    return j.where("new is null or new > old").select("file_path", "name", F.when(F.col("new").isNull(), "removed").otherwise("more parameters").alias("change"))


def change_stranded_code(calls_before: DataFrame, calls_after: DataFrame, after: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Functions that had callers before and have none now; nor, with `references` (owner, target), a place that names them as a value."""
    was = calls_before.select(F.col("owner").alias("file_path"), F.col("target").alias("name")).distinct()
    now = calls_after.select(F.col("owner").alias("file_path"), F.col("target").alias("name"))
    if references is not None:
        now = now.unionByName(references.select(F.col("owner").alias("file_path"), F.col("target").alias("name")))
    return after.select("file_path", "name").join(was, ["file_path", "name"], "left_semi").join(now.distinct(), ["file_path", "name"], "left_anti")


def shotgun_change(changed_lines: DataFrame, least: int = 2, most: int = 30) -> DataFrame:
    """Identifiers on the changed lines of two files or more (changed_lines: file_path, line)."""
    word = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z_$][\w$]{3,}"), F.lit(0)))).alias("identifier")
    rows = changed_lines.select("file_path", word).distinct()
    shared = rows.groupBy("identifier").agg(F.count("*").alias("files")).where(F.col("files") >= least)
    return shared.orderBy(F.desc("files"), "identifier").limit(most)


def single_use_dependency(before: DataFrame, after: DataFrame, imports: DataFrame) -> DataFrame:
    """Dependencies that a manifest gained, with the number of files that import them."""
    added = after.select("file_path", "name").join(before.select("file_path", "name"), ["file_path", "name"], "left_anti")
    users = imports.select(package(F.col("specifier")).alias("_p"), F.col("file_path").alias("_f")).distinct().groupBy("_p").agg(F.count("*").alias("n"))
    return added.join(users, F.col("name") == F.col("_p"), "left").select("file_path", "name", F.coalesce("n", F.lit(0)).alias("sites"))


def barrel_wide_reexport(changed_lines: DataFrame) -> DataFrame:
    """Wildcard re-exports on changed lines of index files, and from how many directories they come."""
    source = F.regexp_extract("line", r"^\s*export\s+\*\s+(?:as\s+\w+\s+)?from\s*['\"]([^'\"]+)['\"]", 1)
    rows = changed_lines.where(F.col("file_path").rlike(INDEX_FILE)).select("file_path", source.alias("source")).where("source <> ''")
    return rows.groupBy("file_path").agg(F.count("*").alias("additions"), F.count_distinct(F.regexp_replace("source", "/[^/]*$", "")).alias("directories"))


# module rules ------------------------------------------------------------------------------------


def package(specifier: Column) -> Column:
    """The package of a bare specifier, with its scope."""
    return F.regexp_extract(specifier, r"^((?:@[^/]+/)?[^./@][^/]*)", 1)


def phantom_package_import(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Bare imports of packages that no manifest names."""
    p = imports.select("file_path", package(F.col("specifier")).alias("name")).where("name <> '' and not startswith(name, 'node:')").distinct()
    return p.join(dependencies.select("name").distinct(), "name", "left_anti").select("file_path", "name")


def dev_dependency_runtime_leak(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Shipped files that use at run time what only the development section names."""
    sections = dependencies.groupBy("name").agg(F.collect_set("section").alias("s")).where(F.size("s") == 1).where(F.array_contains("s", "devDependencies"))
    p = imports.where(~F.col("type_only") & ~is_test_file(F.col("file_path"))).select("file_path", package(F.col("specifier")).alias("name")).distinct()
    return p.join(sections.select("name"), "name", "left_semi").select("file_path", "name")


def cycle_components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target, root) of the edges that lie on cycles, and (root, files, edges) of each set of files that reach each other."""
    e = stored(edges.where("source <> target").select("source", "target").distinct())
    parts = strong_components(e)
    one, two = parts.select(F.col("node").alias("source"), "root"), parts.select(F.col("node").alias("target"), F.col("root").alias("_root"))
    inside = e.join(one, "source").join(two, "target").where("root = _root").select("source", "target", "root")
    return inside, inside.groupBy("root").agg(F.count_distinct("source").alias("files"), F.count("*").alias("edges"))


def import_cycle_tangle(edges: DataFrame, changed: DataFrame, steps: int = MOST_CYCLE) -> DataFrame:
    """Changed files (column node) that reach themselves, with the length of the shortest cycle, however long.

    Cycles are looked for inside components only: first those of up to `steps` edges; a component with as many edges
    as files is one ring, as long as it has files; what is left is followed to its end.
    """
    inside, sizes = cycle_components(edges)
    on = changed.select(F.col("node").alias("origin")).distinct().join(inside.select(F.col("source").alias("origin"), "root").distinct(), "origin").join(sizes, "root").checkpoint()

    def shortest(among: DataFrame, starts: DataFrame, most: int | None) -> DataFrame:
        reach = within_steps(among, starts.select("origin"), most)
        back = among.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
        met = reach.join(back, (F.col("node") == F.col("_s")) & (F.col("origin") == F.col("_t")))
        return met.groupBy("origin").agg((F.min("distance") + 1).alias("length"))

    rings = on.where("files = edges").select("origin", F.col("files").cast("int").alias("length"))
    tangled = on.where("files <> edges")
    short = shortest(inside.join(tangled.select("root").distinct(), "root", "left_semi"), tangled, steps - 1).checkpoint()
    long = tangled.join(short, "origin", "left_anti")
    rest = shortest(inside.join(long.select("root").distinct(), "root", "left_semi"), long, None)
    return rings.unionByName(short).unionByName(rest)


def efferent_coupling_burst(after: DataFrame, before: DataFrame, least: int = 3) -> DataFrame:
    """Files that gained edges into `least` areas or more that they did not use before."""
    area = lambda e: e.select("source", top_directory(F.col("target")).alias("area")).distinct()
    fresh = area(new_edges(after, before, ["source", "target"])).join(area(before), ["source", "area"], "left_anti")
    return fresh.groupBy("source").agg(F.count("*").alias("new_areas")).where(F.col("new_areas") >= least)


def direction_reversing_edge(after: DataFrame, before: DataFrame) -> DataFrame:
    """New edges into an area that so far only imported the source's own."""
    own, other = top_directory(F.col("source")), top_directory(F.col("target"))
    fresh = new_edges(after, before, ["source", "target"]).withColumns({"a": own, "b": other}).where("a <> b")
    old = before.select(own.alias("_from"), other.alias("_to")).distinct()
    towards = fresh.join(old, (F.col("b") == F.col("_from")) & (F.col("a") == F.col("_to")), "left_semi")
    return towards.join(old, (F.col("a") == F.col("_from")) & (F.col("b") == F.col("_to")), "left_anti").select("source", "target")


def duplicate_module_role(new_files: DataFrame, files: DataFrame, most: int = 6) -> DataFrame:
    """New files with a file of the same directory whose name shares a word."""
    words = lambda p: name_tokens(F.regexp_replace(F.regexp_replace(p, "^.*/", ""), r"\..*$", ""))
    n = new_files.select("file_path", directory(F.col("file_path")).alias("dir"), F.explode(words(F.col("file_path"))).alias("word"))
    f = files.select(F.col("file_path").alias("twin"), directory(F.col("file_path")).alias("_dir"), F.explode(words(F.col("file_path"))).alias("_word"))
    met = n.join(f, (F.col("dir") == F.col("_dir")) & (F.col("word") == F.col("_word")) & (F.col("file_path") != F.col("twin")))
    met = met.groupBy("file_path", "twin").agg(F.count("*").alias("shared"))
    return met.withColumn("r", F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("shared"), "twin"))).where(F.col("r") <= most).drop("r")


def far_away_test(files: DataFrame, least: int = 5) -> DataFrame:
    """Tests without a subject in their own directory, where most tests have one."""
    stem = F.regexp_replace(F.regexp_replace("file_path", "^.*/", ""), r"(\.(test|spec))?\.[cm]?[jt]sx?$", "")
    f = files.select("file_path", directory(F.col("file_path")).alias("dir"), stem.alias("stem"), is_test_file(F.col("file_path")).alias("test"))
    subjects = f.where("not test").select(F.col("dir").alias("_d"), F.col("stem").alias("_s")).distinct()
    tests = f.where("test").join(subjects, (F.col("dir") == F.col("_d")) & (F.col("stem") == F.col("_s")), "left")
    share = tests.agg(F.count("*").alias("n"), F.count_if(F.col("_s").isNotNull()).alias("near")).where((F.col("n") >= least) & (F.col("near") * 10 >= F.col("n") * 7))
    return tests.where("_s is null").join(F.broadcast(share), F.lit(True)).select("file_path", "stem")


def import_use_skew(imports: DataFrame, files: DataFrame) -> DataFrame:
    """For each file and specifier, the names bound and how many of them the file uses."""
    source = files.select(F.col("file_path").alias("_f"), "source")
    met = imports.join(source, F.col("file_path") == F.col("_f"))
    body = F.regexp_replace("source", r"\bimport\b[^;'\"]*['\"][^'\"]*['\"]", "")  # neither the binding nor the specifier is a use
    uses = F.size(F.split(body, F.concat(F.lit(r"\b\Q"), F.col("local"), F.lit(r"\E\b")))) - 1
    return met.groupBy("file_path", "specifier").agg(F.count("*").alias("bound"), F.count_if(uses > 0).alias("used"))


# abstraction rules -------------------------------------------------------------------------------


def members_of(spans: DataFrame) -> DataFrame:
    """(file_path, id, type_name, member) of classes, interfaces and types."""
    name = F.regexp_extract("text", r"\b(?:class|interface|type|enum)\s+([\w$]+)", 1)
    member = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:readonly\s+|private\s+|public\s+|static\s+)*([\w$]+)\s*\??\s*[:(=]"), F.lit(1)))).alias("member")
    return spans.where("kind = 'abstraction'").select("file_path", "id", name.alias("type_name"), member)


def convergent_twin_types(members: DataFrame, least: float = 0.5) -> DataFrame:
    """Types of different files with three common members or more and `least` Jaccard."""
    rows = members.select(F.concat_ws("#", "file_path", "type_name").alias("owner"), "member")
    pairs = shared_items(rows, "owner", "member", 3).where(F.col("jaccard") >= least)
    return pairs.where(F.substring_index("left", "#", 1) != F.substring_index("right", "#", 1))


def context_homonym_type(members: DataFrame) -> DataFrame:
    """Files with a type whose name other files use for types that share no member with it, not even through a third: the least such file, and how many meanings the name has."""
    several = members.groupBy("type_name").agg(F.count_distinct("file_path").alias("files")).where("files > 1")
    meanings = parts(members.join(several.select("type_name"), "type_name", "left_semi"), ["type_name"], "file_path", "member")
    by = meanings.groupBy("type_name", "part").agg(F.count("*").alias("n"))
    least = by.groupBy("type_name").agg(F.min("part").alias("first"), F.count("*").alias("meanings")).where("meanings > 1")
    second = by.join(least, "type_name").where("part <> first").groupBy("type_name", "first", "meanings").agg(F.min("part").alias("second"))
    met = meanings.join(second, "type_name")
    return met.select("type_name", "file_path", F.when(F.col("part") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other"), "meanings")


def synonym_vocabulary(functions: DataFrame, least: int = 3) -> DataFrame:
    """Three verbs or more for one noun among the functions of a file."""
    parts = functions.select("file_path", F.regexp_extract("name", "^([a-z]+)([A-Z]\\w*)$", 1).alias("verb"), F.regexp_extract("name", "^([a-z]+)([A-Z]\\w*)$", 2).alias("noun")).where("verb <> ''")
    return parts.groupBy("file_path", "noun").agg(F.array_sort(F.collect_set("verb")).alias("verbs")).where(F.size("verbs") >= least)
