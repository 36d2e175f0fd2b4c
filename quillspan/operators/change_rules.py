"""Rules that look into the hunks of a change, and at functions before and after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import code_only
from quillspan.operators.similarity import parts, shared_items

#: Words that a renaming leaves alone.
KEYWORDS = (
    "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally",
    "for", "function", "if", "import", "in", "instanceof", "interface", "let", "new", "null", "return", "super", "switch", "this", "throw", "true",
    "try", "type", "typeof", "undefined", "var", "void", "while", "with", "yield", "async", "await", "from", "as", "satisfies", "readonly",
    "string", "number", "boolean", "object", "any", "unknown", "never",
)
WORD = r"(?<![\w$])(?!(?:" + "|".join(KEYWORDS) + r")(?![\w$]))[A-Za-z_$][\w$]*"
#: Lines that a block must have to count as moved, and functions that are named.
MOVED, MOST_NAMED = 3, 12
#: Part of a new function's words that an old function must have lost for it to have gone there.
TAKEN = 0.6


def _text(lines: str) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.trim(x)), "\n")


def moved_blocks(hunks: DataFrame, least: int = MOVED) -> DataFrame:
    """(file_path, hunk, from_file, from_hunk, lines): hunks whose new lines, indentation and blank lines aside, are the whole of what went elsewhere."""
    came = hunks.select("file_path", "hunk", _text("new_lines").alias("text"), F.size("new_lines").alias("lines"), _text("old_lines").alias("_old")).where("text <> '' and text <> _old")
    went = hunks.select(F.col("file_path").alias("from_file"), F.col("hunk").alias("from_hunk"), _text("old_lines").alias("text"), _text("new_lines").alias("_new")).where("text <> '' and text <> _new")
    first = went.groupBy("text").agg(F.min(F.struct("from_file", "from_hunk")).alias("f"))  # one origin for each block, however often it went
    n = F.size(F.split("text", "\n"))
    met = came.where(n >= least).join(first, "text").where((F.col("file_path") != F.col("f.from_file")) | (F.col("hunk") != F.col("f.from_hunk")))
    return met.select("file_path", "hunk", "f.from_file", "f.from_hunk", "lines")


def hunk_kinds(hunks: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_path, hunk, start, lines, kind): blank (only white space differs), moved, renamed (only names differ), real, or added for files without an old source."""
    none = lambda c: F.regexp_replace(c, r"\s+", "")
    old = changes.select("file_path", none(F.col("old_source")).alias("old"))
    rows = hunks.where(F.size("new_lines") > 0).select("file_path", "hunk", F.col("new_at").alias("start"), F.size("new_lines").alias("lines"), none(F.array_join("new_lines", "\n")).alias("new"))
    moved = moved_blocks(hunks).select("file_path", "hunk", F.lit(True).alias("moved")).distinct()
    named = lambda c: F.regexp_replace(c, WORD, "§")
    met = rows.join(old, "file_path").join(moved, ["file_path", "hunk"], "left")
    kind = F.when(F.col("old").isNull(), "added").when((F.col("new") == "") | (F.instr("old", F.col("new")) > 0) & F.col("moved").isNull(), "blank")
    kind = kind.when(F.col("moved"), "moved").when(F.contains(named("old"), named("new")), "renamed").otherwise("real")
    return met.select("file_path", "hunk", "start", "lines", kind.alias("kind"))


def entangled_mechanical_change(hunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Files of a change that holds mechanical hunks (blank, moved, renamed) and real ones, with the numbers of both and whether they take turns."""
    kinds = hunk_kinds(hunks, changes)
    mechanical = F.col("kind").isin("blank", "moved", "renamed")
    sides = kinds.where("kind <> 'added'").withColumn("mechanical", mechanical)
    before = F.lag("mechanical").over(W.partitionBy("file_path").orderBy("hunk"))
    by = sides.withColumn("turn", before != F.col("mechanical")).groupBy("file_path").agg(
        F.count_if("mechanical").alias("mechanical_hunks"), F.count_if(~F.col("mechanical")).alias("real_hunks"), F.sum(F.when(F.col("mechanical"), F.col("lines")).otherwise(0)).alias("mechanical_lines"),
        F.sum(F.when(~F.col("mechanical"), F.col("lines")).otherwise(0)).alias("real_lines"), F.count_if(F.col("kind") == "moved").alias("moved_hunks"), F.coalesce(F.bool_or("turn"), F.lit(False)).alias("interleaved"),
    )
    both = by.agg(F.sum("mechanical_hunks").alias("_m"), F.sum("real_hunks").alias("_r")).where("_m > 0 and _r > 0")
    return by.join(F.broadcast(both), F.lit(True)).drop("_m", "_r")  # one row


def touched_functions(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(file_path, hunk, name) of the functions (file_path, name, start_line, end_line) that a hunk's new lines lie in."""
    h = hunks.where(F.size("new_lines") > 0).select("file_path", "hunk", F.col("new_at").alias("_a"), (F.col("new_at") + F.size("new_lines") - 1).alias("_b"))
    return h.join(spans.select("file_path", "name", "start_line", "end_line"), "file_path").where("start_line <= _b and end_line >= _a").select("file_path", "hunk", "name").distinct()


def divergent_change(hunks: DataFrame, spans: DataFrame, calls: DataFrame, least: int = 2) -> DataFrame:
    """Files whose hunks touch functions in groups that share neither a function, nor a call between them, nor a calling file."""
    touched = touched_functions(hunks, spans)
    names = touched.select("file_path", "name").distinct()
    users = calls.where("owner <> file_path").select(F.col("owner").alias("file_path"), F.col("target").alias("name"), F.concat(F.lit("by "), calls["file_path"]).alias("link"))
    inside = calls.where("owner = file_path").select("file_path", F.col("caller").alias("name"), F.concat(F.lit("in "), F.col("target")).alias("link"))
    links = names.join(users.unionByName(inside).distinct(), ["file_path", "name"]).unionByName(names.select("file_path", "name", F.concat(F.lit("in "), F.col("name")).alias("link")))
    hunk_links = touched.select("file_path", "name", F.concat(F.lit("hunk "), F.col("hunk").cast("string")).alias("link"))
    grouped = parts(links.unionByName(hunk_links).distinct(), ["file_path"], "name", "link")
    each = grouped.groupBy("file_path", "part").agg(F.slice(F.array_sort(F.collect_set("name")), 1, MOST_NAMED).alias("functions"))
    n_hunks = touched.groupBy("file_path").agg(F.count_distinct("hunk").alias("hunks"))
    out = each.groupBy("file_path").agg(F.count("*").alias("groups"), F.slice(F.array_sort(F.collect_list("functions")), 1, MOST_NAMED).alias("functions"))
    return out.where(F.col("groups") >= least).join(n_hunks, "file_path")


def depth_sum(text: Column) -> Column:
    """How deep the lines of a function are nested below its body, over all of them."""
    opened = lambda x, c: F.length(x) - F.length(F.regexp_replace(x, c, ""))

    def step(acc: Column, x: Column) -> Column:
        after = acc["depth"] + opened(x, "[{]") - opened(x, "[}]")
        here = F.greatest(F.least(acc["depth"], after) - 1, F.lit(0))
        return F.struct(after.alias("depth"), (acc["total"] + F.when(F.trim(x) == "", F.lit(0)).otherwise(here)).alias("total"))

    return F.aggregate(F.split(code_only(text), "\n"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("total")), step)["total"].cast("long")


def _measured(functions: DataFrame) -> DataFrame:
    statement = F.filter(F.transform(F.split(code_only(F.col("text")), r"[;\n]"), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: F.length(x) > 6)
    return functions.select("file_path", "name", depth_sum(F.col("text")).alias("depth"), F.array_distinct(statement).alias("statements"))


def matched_functions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old_file, old_name, new_file, new_name): functions of two snapshots that are the same one.

    First those that kept file and name; of the rest, pairs that are each other's best by shared statements, half of
    the larger one's at least, so that functions which moved or were renamed are found.
    """
    b, a = before.select("file_path", "name", "statements"), after.select("file_path", "name", "statements")
    kept = b.join(a.select("file_path", "name"), ["file_path", "name"], "left_semi").select("file_path", "name")
    same = kept.select(F.col("file_path").alias("old_file"), F.col("name").alias("old_name"), F.col("file_path").alias("new_file"), F.col("name").alias("new_name"))
    gone, come = b.join(kept, ["file_path", "name"], "left_anti"), a.join(kept, ["file_path", "name"], "left_anti")
    rows = lambda f, side: f.select(F.concat_ws("\u0001", F.lit(side), "file_path", "name").alias("owner"), F.explode("statements").alias("item"))
    pairs = shared_items(rows(gone, "0").unionByName(rows(come, "1")), "owner", "item", 1).where("left like '0%' and right like '1%'")
    sizes = rows(gone, "0").unionByName(rows(come, "1")).groupBy("owner").agg(F.count("*").alias("n"))
    pairs = pairs.join(sizes.select(F.col("owner").alias("left"), F.col("n").alias("_l")), "left").join(sizes.select(F.col("owner").alias("right"), F.col("n").alias("_r")), "right")
    pairs = pairs.where(F.col("shared") * 2 >= F.greatest("_l", "_r"))
    one = F.row_number().over(W.partitionBy("left").orderBy(F.desc("shared"), "right"))
    two = F.row_number().over(W.partitionBy("right").orderBy(F.desc("shared"), "left"))
    best = pairs.withColumns({"i": one, "j": two}).where("i = 1 and j = 1")
    at = lambda c, k: F.get(F.split(c, "\u0001"), F.lit(k))
    return same.unionByName(best.select(at("left", 1).alias("old_file"), at("left", 2).alias("old_name"), at("right", 1).alias("new_file"), at("right", 2).alias("new_name")))


def complexity_displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Functions that became less nested while new functions hold the statements that they lost: where these went, with the nesting before and after in all.

    Functions are the same one if they kept their name or their statements (`matched_functions`).
    """
    b, a = _measured(before), _measured(after)
    same = matched_functions(b, a)
    old = b.select(F.col("file_path").alias("old_file"), F.col("name").alias("old_name"), F.col("depth").alias("before"), F.col("statements").alias("_s"))
    new = a.select(F.col("file_path").alias("new_file"), F.col("name").alias("new_name"), F.col("depth").alias("after"), F.col("statements").alias("_t"))
    shrunk = same.join(old, ["old_file", "old_name"]).join(new, ["new_file", "new_name"]).where("after < before").withColumn("lost", F.array_except("_s", "_t")).drop("_s", "_t")
    fresh = new.join(same.select("new_file", "new_name"), ["new_file", "new_name"], "left_anti").where(F.size("_t") > 0)
    found = fresh.select(F.col("new_file").alias("to_file"), F.col("new_name").alias("to"), F.col("after").alias("to_depth"), F.size("_t").alias("_n"), F.explode("_t").alias("_x"))
    given = shrunk.select("new_file", "new_name", "before", "after", F.explode("lost").alias("_x"))
    met = given.join(found, "_x").groupBy("new_file", "new_name", "before", "after", "to_file", "to", "to_depth", "_n").agg(F.count("*").alias("taken")).where(F.col("taken") >= TAKEN * F.col("_n"))
    moved = F.array_sort(F.collect_list(F.struct("to", "to_file", F.col("to_depth").alias("depth"))))
    out = met.groupBy(F.col("new_file").alias("file_path"), F.col("new_name").alias("name"), "before", "after").agg(F.slice(moved, 1, MOST_NAMED).alias("moved_to"), (F.max("after") + F.sum("to_depth")).alias("after_in_all"))
    return out
