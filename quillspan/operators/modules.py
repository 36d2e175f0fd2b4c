"""Relations between modules and functions: imports, graph edges, callers, test pins, norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import directory, split_top, top_directory
from quillspan.session import checkpoint_folder

#: What a relative specifier may stand for, in order of preference.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: Share of files from which a habit counts as a norm.
NORM = 0.7

IMPORT = r"""(?m)^\s*import\s+(type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s+as\s+([\w$]+)|\{([^}]*)\})?\s*from\s*['"]([^'"]+)['"]"""


def module_imports(files: DataFrame) -> DataFrame:
    """(file_path, specifier, imported, local, type_only): one row for each name that an import binds."""
    statement = F.explode(F.regexp_extract_all("source", F.lit(IMPORT), F.lit(0))).alias("statement")
    s = files.select("file_path", statement)
    part = lambda k: F.nullif(F.regexp_extract("statement", IMPORT, k), F.lit(""))
    s = s.select("file_path", part(5).alias("specifier"), part(1).isNotNull().alias("type_only"), part(2).alias("default"), part(3).alias("namespace"), part(4).alias("named"))
    names = F.transform(split_top(F.coalesce("named", F.lit(""))), _binding)
    none = F.array().cast("array<struct<imported:string,local:string>>")
    one = lambda c, name: F.when(c.isNotNull(), F.array(F.struct(name.alias("imported"), c.alias("local")))).otherwise(none)
    rows = F.concat(one(F.col("default"), F.lit("default")), one(F.col("namespace"), F.lit("*")), names)
    return s.select("file_path", "specifier", "type_only", F.explode(rows).alias("b")).select("file_path", "specifier", "b.imported", "b.local", "type_only")


def _binding(name: Column) -> Column:
    name = F.regexp_replace(name, r"^type\s+", "")
    sides = F.split(name, r"\s+as\s+")
    return F.struct(F.get(sides, F.lit(0)).alias("imported"), F.element_at(sides, -1).alias("local"))


def normal_path(path: Column) -> Column:
    """A path without `.` and `..` steps."""
    steps = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(p))),
    )
    return F.array_join(folded, "/")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `resolved`, the first file in file_order that a relative specifier may stand for; null for packages."""
    base = normal_path(F.concat_ws("/", directory(F.col("file_path")), F.col("specifier")))
    asked = imports.select("file_path", "specifier").distinct().where(F.col("specifier").startswith("."))
    paths = asked.select("file_path", "specifier", F.explode(F.array(*[F.concat(base, F.lit(s)) for s in SUFFIXES])).alias("path"))
    known = files.select(F.col("file_path").alias("_path"), "file_order")
    found = paths.join(known, paths["path"] == known["_path"]).groupBy("file_path", "specifier").agg(F.min_by("_path", "file_order").alias("resolved"))
    return imports.join(found, ["file_path", "specifier"], "left")


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, in_degree) of all nodes: distinct (source, specifier) pairs resolved to another node."""
    hits = edges.select("source", "specifier", "target").where("target is not null and target <> source").distinct()
    counts = hits.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def edge_facts(edges: DataFrame) -> DataFrame:
    """Adds how many directories deeper the target lies and whether the edge leaves its top directory."""
    depth = lambda c: F.size(F.split(c, "/"))
    return edges.withColumns({"depth_delta": depth(F.col("target")) - depth(F.col("source")), "crosses": top_directory(F.col("source")) != top_directory(F.col("target"))})


def new_edges(after: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Edges of the new snapshot that the old one lacks."""
    return after.join(before.select(*key).distinct(), key, "left_anti")


def within_steps(edges: DataFrame, start: DataFrame, steps: int | None = None) -> DataFrame:
    """(origin, node, distance): nodes that each origin reaches in at most `steps` edges, or in any number, with the shortest distance.

    Each step joins the frontier to the edges and drops what was reached before.
    """
    if steps is None:
        return _closure(edges, start)
    e = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct()
    seen = start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("distance"))
    front = seen
    for k in range(1, steps + 1):
        ahead = front.join(e, front["node"] == e["_s"]).select("origin", F.col("_t").alias("node")).distinct()
        front = ahead.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("distance", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def _closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    checkpoint_folder(edges.sparkSession)
    e = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct().checkpoint()
    seen = start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("distance")).distinct().checkpoint()
    front, k = seen, 0
    while not front.isEmpty():
        k += 1
        ahead = front.join(e, front["node"] == e["_s"]).select("origin", F.col("_t").alias("node")).distinct()
        front = ahead.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("distance", F.lit(k)).checkpoint()
        seen = seen.unionByName(front)
    return seen.checkpoint()


def first_callers(calls: DataFrame, owner: list[str], order: list[str], most: int = 20) -> DataFrame:
    """The first `most` call sites of each owner, and how many there are in all.

    Counted apart from the ranking, so that of an owner with very many callers each task keeps only the first.
    """
    ranked = calls.withColumn("position", F.row_number().over(W.partitionBy(*owner).orderBy(*order))).where(F.col("position") <= most)
    totals = calls.groupBy(*owner).agg(F.count("*").alias("total")).select(*[F.col(c).alias(f"_o_{c}") for c in owner], "total")
    same = F.lit(True)
    for c in owner:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return ranked.join(totals, same).drop(*[f"_o_{c}" for c in owner])


def transitive_pins(tests: DataFrame, calls: DataFrame, most: int = 10) -> DataFrame:
    """(test, seam, target): targets that a test reaches through one seam, the first `most` of each target."""
    c = calls.select(F.col("caller").alias("_caller"), F.col("callee").alias("target")).distinct()
    met = tests.select("test", "seam").distinct().join(c, F.col("seam") == F.col("_caller")).select("test", "seam", "target").distinct()
    return met.withColumn("position", F.row_number().over(W.partitionBy("target").orderBy("test", "seam"))).where(F.col("position") <= most)


def norm(flags: DataFrame, by: list[str], share: float = NORM) -> DataFrame:
    """Share of rows whose `flag` holds in each group, and whether that makes a norm."""
    stats = flags.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("flag").cast("long")).alias("holding"))
    return stats.withColumn("is_norm", F.col("holding") * 10 >= F.col("n") * int(share * 10))


def change_sizes(before: DataFrame, after: DataFrame, key: str, name: str, most: int | None = None) -> DataFrame:
    """(key, added, removed) from full outer join of two snapshots' names; the `most` largest changes, key order among equals."""
    b = before.select(key, name).distinct().withColumn("_old", F.lit(1))
    a = after.select(key, name).distinct().withColumn("_new", F.lit(1))
    out = b.join(a, [key, name], "full_outer").groupBy(key).agg(F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.col("_new").isNull()).alias("removed"))
    out = out.where("added + removed > 0")
    return out if most is None else out.orderBy(F.desc(F.col("added") + F.col("removed")), key).limit(most)


def manifest_dependencies(manifests: DataFrame) -> DataFrame:
    """(file_path, section, name, version) of package manifests."""
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    parsed = manifests.select("file_path", F.from_json("source", "struct<" + ",".join(f"{s}:map<string,string>" for s in sections) + ">").alias("m"))
    none = F.array().cast("array<struct<key:string,value:string>>")

    def of(section: str) -> Column:
        entries = F.coalesce(F.map_entries(f"m.{section}"), none)
        return F.transform(entries, lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("version")))

    rows = F.flatten(F.array(*[of(s) for s in sections]))
    return parsed.select("file_path", F.explode(rows).alias("d")).select("file_path", "d.*")
