"""Orders that callers keep between calls, and parameters that are handed from function to function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import code_only, split_top
from quillspan.operators.call_rules import OWN, state_uses
from quillspan.operators.relation_rules import HEAD, is_test_file, resolved_calls
from quillspan.session import checkpoint_folder, dealt

ELEMENT = r"<([A-Z][\w$]*)((?:\s+[\w$-]+(?:=(?:\{[^{}]*\}|\"[^\"]*\"|'[^']*'))?)*)\s*/?>"
ATTRIBUTE = r"([\w$]+)=\{\s*([A-Za-z_$][\w$]*)\s*\}"
NAME = r"(?<![\w$.])[A-Za-z_$][\w$]*(?![\w$]|=\{)"
#: Functions in a row that hand a parameter on unread before it counts as drilled.
LAYERS = 3
#: Share of the callers of both functions from which their order counts as kept.
KEPT = 0.9


# order of calls ----------------------------------------------------------------------------------


def order_support(calls: DataFrame, asked: DataFrame) -> DataFrame:
    """(first, second, before, after, without, example) of asked pairs of targets.

    `calls` has caller, target and position. A caller keeps the order if it calls `first` before `second`; `after`
    counts those that call it only later, `without` those that call the second one alone, and `example` is the least
    caller of these two kinds. Each caller's calls meet the pairs that they belong to and are folded once, in partitions whose number grows with the calls.
    """
    at = calls.groupBy("caller", "target").agg(F.min("position").alias("at"))
    sides = F.explode(F.array(F.struct(F.col("first").alias("target"), F.lit(True).alias("leads")), F.struct(F.col("second").alias("target"), F.lit(False).alias("leads"))))
    roles = asked.select("first", "second", sides.alias("side")).select("first", "second", "side.*").distinct()
    keys = ["first", "second", "caller"]
    met = dealt(at.join(roles, "target"), *keys, made_of=calls).groupBy(*keys).agg(F.min(F.when(F.col("leads"), F.col("at"))).alias("a"), F.min(F.when(~F.col("leads"), F.col("at"))).alias("b"))
    kept, broken, alone = F.col("a") < F.col("b"), F.col("a") >= F.col("b"), F.col("a").isNull()
    return met.where("b is not null").groupBy("first", "second").agg(
        F.count_if(kept).alias("before"), F.count_if(broken).alias("after"), F.count_if(alone).alias("without"), F.min(F.when(broken | alone, F.col("caller"))).alias("example")
    )


def cross_module_call_order(files: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that call a writer of another file's state before a reader of it, with how many callers keep that order,
    whether the reader guards itself, and functions of that file that do both.

    Of each binding only the first writing and the first reading call of a caller count, so that the pairs are no more than the calls.
    """
    live = calls.where(~is_test_file(F.col("file_path")))
    uses = state_uses(files, functions).select(F.col("file_path").alias("owner"), F.col("name").alias("target"), "binding", "writes")
    touched = live.where("owner <> file_path").join(uses, ["owner", "target"])
    call = F.struct("position", "target")
    each = touched.groupBy("file_path", "caller", "owner", "binding").agg(F.min(F.when(F.col("writes"), call)).alias("w"), F.min(F.when(~F.col("writes"), call)).alias("r"))
    key = lambda of, name: F.concat_ws("#", of, name)
    pairs = each.where("w.position < r.position").select("file_path", F.col("caller").alias("name"), F.col("owner").alias("module"), "binding", key("owner", "w.target").alias("first"), key("owner", "r.target").alias("second"))
    support = order_support(live.select(key("file_path", "caller").alias("caller"), key("owner", "target").alias("target"), "position"), pairs.select("first", "second").distinct())
    guards = functions.select(key("file_path", "name").alias("second"), code_only(F.col("text")).rlike(r"\bthrow\b").alias("guarded"))
    inside = live.where("owner = file_path").select(F.col("caller").alias("entry"), key("owner", "target").alias("target")).distinct()
    asked = pairs.select("first", "second").distinct()
    both = asked.join(inside.withColumnRenamed("target", "first"), "first").join(inside.withColumnRenamed("target", "second"), ["second", "entry"], "left_semi")
    combined = both.groupBy("first", "second").agg(F.min("entry").alias("combined"), F.count("*").alias("combined_entries"))
    out = pairs.join(support, ["first", "second"]).join(guards, "second", "left").join(combined, ["first", "second"], "left")
    share = F.col("before") >= KEPT * (F.col("before") + F.col("after"))
    return out.select(
        "file_path", "name", "module", "binding", F.substring_index("first", "#", -1).alias("first"), F.substring_index("second", "#", -1).alias("second"),
        "before", "after", "without", "example", share.alias("convention"), "guarded", "combined", F.coalesce("combined_entries", F.lit(0)).alias("combined_entries"),
    )


# parameters handed on ----------------------------------------------------------------------------


def slots(functions: DataFrame) -> DataFrame:
    """(file_path, name, slot, parameter): the parameters of functions by place; what is taken out of an object at place k has slot k.key."""
    head = F.concat(F.regexp_extract("text", HEAD, 3), F.regexp_extract("text", HEAD, 5))
    each = functions.select(*OWN, F.posexplode(split_top(head)).alias("at", "item"))
    place = F.col("at").cast("string")
    plain = each.where(~F.col("item").startswith("{")).select(*OWN, place.alias("slot"), F.regexp_extract("item", r"^\.{0,3}([A-Za-z_$][\w$]*)", 1).alias("parameter"))
    taken = each.where(F.col("item").startswith("{")).select(*OWN, "at", F.explode(split_top(F.regexp_extract("item", r"^\{([^}]*)\}", 1))).alias("key"))
    name, local = F.regexp_extract("key", r"^([A-Za-z_$][\w$]*)", 1), F.regexp_extract("key", r"^[\w$]+\s*:\s*([A-Za-z_$][\w$]*)", 1)
    taken = taken.select(*OWN, F.concat_ws(".", F.col("at").cast("string"), name).alias("slot"), F.when(local != "", local).otherwise(name).alias("parameter"))
    return plain.unionByName(taken).where("parameter <> ''")


def handed_on(functions: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_path, name, parameter, owner, target, slot): names that a function passes on as they are, as an argument or as an
    attribute of an element, to functions that are known."""
    by_call = calls.select("file_path", F.col("caller").alias("name"), "owner", "target", F.posexplode(split_top(F.col("arguments"))).alias("at", "parameter"))
    by_call = by_call.where(F.col("parameter").rlike(r"^[A-Za-z_$][\w$]*$")).withColumn("slot", F.col("at").cast("string")).drop("at")
    elements = functions.select("file_path", F.col("name").alias("caller"), F.posexplode(F.regexp_extract_all("text", F.lit(ELEMENT), F.lit(0))).alias("position", "element"))
    elements = elements.select("file_path", "caller", "position", F.regexp_extract("element", ELEMENT, 1).alias("callee"), F.regexp_extract("element", ELEMENT, 2).alias("arguments"))
    known = resolved_calls(elements, functions, imports).select("file_path", F.col("caller").alias("name"), "owner", "target", F.explode(F.regexp_extract_all("arguments", F.lit(ATTRIBUTE), F.lit(0))).alias("a"))
    by_element = known.select("file_path", "name", "owner", "target", F.regexp_extract("a", ATTRIBUTE, 2).alias("parameter"), F.concat(F.lit("0."), F.regexp_extract("a", ATTRIBUTE, 1)).alias("slot"))
    columns = ["file_path", "name", "parameter", "owner", "target", "slot"]
    return by_call.select(*columns).unionByName(by_element.select(*columns))


def first_paths(steps: DataFrame, most: int | None = None) -> DataFrame:
    """(origin, node, path): from each source of `steps` (source, target) that is no target, one path to every node it reaches.

    A node that an origin reaches in several ways keeps the path found first, the least of equally short ones, so that
    circles end and rows are at most origins times what they reach; each round moves all paths by one step.
    """
    checkpoint_folder(steps.sparkSession)
    e = steps.select(F.col("source").alias("_s"), F.col("target").alias("_t")).where("_s <> _t").distinct().checkpoint()
    front = e.select(F.col("_s").alias("origin")).distinct().join(e.select(F.col("_t").alias("origin")).distinct(), "origin", "left_anti")
    front = front.select("origin", F.col("origin").alias("node"), F.array("origin").alias("path")).checkpoint()
    seen, hops = front, 0
    while (most is None or hops < most) and not front.isEmpty():
        ahead = front.join(e, front["node"] == e["_s"]).groupBy("origin", F.col("_t").alias("node")).agg(F.min("path").alias("path"))
        ahead = ahead.select("origin", "node", F.concat("path", F.array("node")).alias("path"))
        front = ahead.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").checkpoint()
        seen, hops = seen.unionByName(front), hops + 1
    return seen.checkpoint()


def drilled_prop(functions: DataFrame, calls: DataFrame, imports: DataFrame, layers: int = LAYERS) -> DataFrame:
    """Parameters that `layers` functions in a row hand on and do nothing else with, from the function where they enter, with the way that they take."""
    places, passes = slots(functions), handed_on(functions, calls, imports)
    body = F.regexp_replace(code_only(F.col("text")), HEAD, "")
    named = functions.select(*OWN, F.explode(F.regexp_extract_all(body, F.lit(NAME), F.lit(0))).alias("parameter")).groupBy(*OWN, "parameter").agg(F.count("*").alias("uses"))
    given = passes.groupBy(*OWN, "parameter").agg(F.count("*").alias("passed"))
    unread = places.join(named, [*OWN, "parameter"]).join(given, [*OWN, "parameter"]).where("uses = passed")
    node = lambda of, name, parameter: F.concat_ws("#", of, name, parameter)
    into = places.select(F.col("file_path").alias("owner"), F.col("name").alias("target"), "slot", F.col("parameter").alias("_into"))
    steps = passes.join(unread.select(*OWN, "parameter"), [*OWN, "parameter"], "left_semi").join(into, ["owner", "target", "slot"])
    steps = steps.select(node("file_path", "name", "parameter").alias("source"), node("owner", "target", "_into").alias("target"))
    paths = first_paths(steps)
    silent = unread.select(node("file_path", "name", "parameter").alias("node"), F.lit(True).alias("silent"))
    ends = paths.join(silent, "node", "left").withColumn("unread", F.size("path") - F.when(F.col("silent"), F.lit(0)).otherwise(F.lit(1)))
    best = ends.groupBy("origin").agg(F.max(F.struct(F.col("unread"), F.col("path"))).alias("b")).where(F.col("b.unread") >= layers)
    part = lambda k: F.get(F.split("origin", "#"), F.lit(k))
    return best.select(part(0).alias("file_path"), part(1).alias("name"), part(2).alias("parameter"), F.col("b.unread").alias("unread_layers"), F.transform("b.path", lambda x: F.element_at(F.split(x, "#"), 2)).alias("way"))
