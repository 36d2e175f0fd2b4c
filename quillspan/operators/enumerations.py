"""Sets of values that a tree writes down more than once: unions, enums and lists of literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import uncommented
from quillspan.operators.relation_rules import is_test_file
from quillspan.operators.similarity import contained_sets, shared_items

LITERALS = r"(?:\s*\|?\s*(?:'[^'\n]*'|\"[^\"\n]*\"))"
#: How each kind of set is written, with its name and its values as groups.
SETS = {
    "union": r"\btype\s+([\w$]+)\s*=(" + LITERALS + r"{2,})",
    "enum": r"\benum\s+([\w$]+)\s*\{([^}]*)\}",
    "list": r"\bconst\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:new\s+Set(?:<[^>]*>)?\(\s*)?\[((?:" + LITERALS + r"\s*,?){2,})\s*\]",
}
ENV = r"(?:process|import\.meta)\.env(?:\.([A-Za-z_]\w*)|\[\s*['\"]([^'\"]+)['\"]\s*\])"
CONFIG_FILE = r"(?i)(^|/)(config|configuration|settings|env)(/|\.[cm]?[jt]sx?$)"
#: Half of the values of both sets together, from which two sets are parallel though neither holds the other.
ALIKE = 0.5
MOST_NAMED = 12


def _plain(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"'[^'\n]*'|\"[^\"\n]*\""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def value_sets(files: DataFrame) -> DataFrame:
    """(file_path, name, kind, value): unions of literals, enums (their texts, or the names of members without one) and lists of literals."""
    code = files.select("file_path", uncommented(F.col("source")).alias("source"))
    found = None
    for kind, pattern in SETS.items():
        each = code.select("file_path", F.explode(F.regexp_extract_all("source", F.lit(pattern), F.lit(0))).alias("text"))
        body = F.regexp_extract("text", pattern, 2)
        values = _plain(body)
        if kind == "enum":
            parts = F.filter(F.transform(F.split(body, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
            values = F.transform(parts, lambda x: F.coalesce(F.get(_plain(x), F.lit(0)), F.regexp_extract(x, r"^([\w$]+)", 1)))
        rows = each.select("file_path", F.regexp_extract("text", pattern, 1).alias("name"), F.lit(kind).alias("kind"), F.explode(F.array_distinct(values)).alias("value"))
        found = rows if found is None else found.unionByName(rows)
    return found.where("value <> ''")


def parallel_enumerations(values: DataFrame) -> DataFrame:
    """For each set of values the other set that shares most with it, if one holds the other or half of all their values are shared, and they differ."""
    rows = values.withColumn("owner", F.concat_ws("#", "file_path", "name"))
    both = shared_items(rows, "owner", "value", 2).where(F.col("jaccard") >= ALIKE).select("left", "right", F.lit(False).alias("inside"))
    within = contained_sets(rows, "owner", "value").select(F.col("inside").alias("left"), F.col("outside").alias("right"), F.lit(True).alias("inside"))
    pairs = both.unionByName(within)
    turned = pairs.select(F.col("right").alias("left"), F.col("left").alias("right"), "inside")
    pairs = pairs.unionByName(turned).groupBy("left", "right").agg(F.max("inside").alias("one_holds_the_other"))
    sets = rows.groupBy("owner").agg(F.array_sort(F.collect_set("value")).alias("v"))
    met = pairs.join(sets.select(F.col("owner").alias("left"), F.col("v").alias("a")), "left").join(sets.select(F.col("owner").alias("right"), F.col("v").alias("b")), "right")
    met = met.withColumns({"shared": F.array_intersect("a", "b"), "only_here": F.array_except("a", "b"), "only_there": F.array_except("b", "a")})
    met = met.where((F.size("only_here") + F.size("only_there") > 0) & (F.size(F.array_union("a", "b")) >= 3))
    best = F.row_number().over(W.partitionBy("left").orderBy(F.desc(F.size("shared")), F.size("only_there"), "right"))
    part = lambda c, k: F.get(F.split(c, "#"), F.lit(k))
    cut = lambda c: F.slice(c, 1, MOST_NAMED).alias(c)
    return met.withColumn("r", best).where("r = 1").select(
        part("left", 0).alias("file_path"), part("left", 1).alias("type_name"), part("right", 0).alias("other_file"), part("right", 1).alias("other"), cut("shared"), cut("only_here"), cut("only_there"), "one_holds_the_other"
    )


def string_duplicated_enumeration(changed_lines: DataFrame, files: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Files whose changed lines (file_path, line) write `least` values or more of a set that another file owns, with that set and whether they import its file."""
    literals = changed_lines.select("file_path", F.explode(_plain(F.col("line"))).alias("value")).where("value <> ''").distinct()
    restated = literals.join(literals.groupBy("file_path").agg(F.count("*").alias("n")).where(F.col("n") >= least), "file_path")
    owned = value_sets(files)
    pairs = restated.select("file_path", "value").join(owned.select(F.col("file_path").alias("owner_file"), F.col("name").alias("owner"), "value").distinct(), "value").where("owner_file <> file_path")
    one = pairs.groupBy("file_path", "owner_file", "owner").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    first = F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("shared"), "owner_file", "owner"))
    e = edges.select(F.col("source").alias("file_path"), F.col("target").alias("owner_file"), F.lit(True).alias("imports")).distinct()
    return one.withColumn("r", first).where("r = 1").drop("r").join(e, ["file_path", "owner_file"], "left").withColumn("imports", F.coalesce("imports", F.lit(False)))


def duplicate_config_source(changed_lines: DataFrame, before: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files outside the configuration that newly read an environment variable although a configuration file reads the environment:
    the variable, that file, whether it reads the same one, and how many files read the environment directly."""
    name = lambda x: F.concat(F.regexp_extract(x, ENV, 1), F.regexp_extract(x, ENV, 2))
    reads = lambda df, text: df.select("file_path", F.explode(F.transform(F.regexp_extract_all(text, F.lit(ENV), F.lit(0)), name)).alias("variable")).distinct()
    now = reads(files, "source")
    owners = now.where(F.col("file_path").rlike(CONFIG_FILE) & ~is_test_file(F.col("file_path")))
    owner = owners.agg(F.min("file_path").alias("config_file"), F.count_distinct("file_path").alias("_n")).where("_n > 0").drop("_n")
    direct = now.where(~F.col("file_path").rlike(CONFIG_FILE)).agg(F.count_distinct("file_path").alias("direct_readers"))
    new = reads(changed_lines, "line").join(reads(before, "source"), ["file_path", "variable"], "left_anti")
    new = new.where(~F.col("file_path").rlike(CONFIG_FILE) & ~is_test_file(F.col("file_path")))
    known = owners.select("variable", F.lit(True).alias("in_config")).distinct()
    met = new.join(known, "variable", "left").join(F.broadcast(owner), F.lit(True)).join(F.broadcast(direct), F.lit(True))  # one row each
    e = edges.select(F.col("source").alias("file_path"), F.col("target").alias("config_file"), F.lit(True).alias("delegates")).distinct()
    out = met.join(e, ["file_path", "config_file"], "left")
    return out.select("file_path", "variable", "config_file", F.coalesce("in_config", F.lit(False)).alias("in_config"), F.coalesce("delegates", F.lit(False)).alias("delegates"), "direct_readers")
