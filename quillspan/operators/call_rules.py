"""Rules about functions and what they call: chains, layers, order, shared state and contracts.

Inputs are the relations of a repository: functions (file_path, id, name, parameters, exported, text),
resolved calls (file_path, caller, owner, target, arguments, position), imports, edges and files. Each
rule returns rows with file_path and name, the function it speaks of; no row means that it abstains.
Statements are found by patterns in the text of a function, relations between functions by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import name_tokens, split_top
from quillspan.operators.relation_rules import is_test_file

#: The longest chain that is followed, and how many siblings are named.
MOST_HOPS, MOST_NAMED = 8, 6
#: Targets of a source in one row.
LISTED = 1000

FORWARD = r"^[^{]*\{\s*return\s+(?:await\s+)?([\w$]+)\([\w$\s,.]*\);?\s*\}\s*;?\s*$"
GUARD = r"\bif\s*\([^\n]*\)\s*\{?\s*(throw|return)\b|\b(assert|validate|authorize|ensure|require|check)\w*\("
ROOT = r"(?<![\w$.])([A-Za-z_$][\w$]*)(?:\.[\w$]+)*\s*\("
DURABLE = r"\bawait\s+([\w$.]+\.(?:save|create|update|insert|delete|remove|upsert|write|publish|send|put)\w*)\("
TRANSACTION = r"(?i)\b\w*(transaction|unitOfWork|atomic|rollback|commit)\w*"
EFFECT = r"\.(push|set|add|save|write|send|publish|insert|delete|update|emit)\w*\("
REJECTS = r"^\s*(throw\b|return\s*(;|null|undefined|false|\w*\.?status\(4))"
GATE = r"^\s*if\s*\(.*\)\s*\{?\s*(throw\b|return\s*(;|null|undefined|false|\w*\.?status\(4))"
BINDING = r"^(?:export\s+)?(?:let|var)\s+([\w$]+)\s*(?::[^=;]*)?(=)?"
CONTAINER = r"^(?:export\s+)?(?:const|let)\s+([\w$]+)\s*(?::[^=]*)?=\s*(?:new\s+(?:Map|Set|Array)\b|\[\s*\]|\{\s*\})"
BOUNDED = r"\b(ttl|lru)(?![a-z])|(TTL|LRU)\b|[a-z](Ttl|Lru)(?![a-z])|(?i:evict|max_?size|max_?entries)"
SETUP = r"^(init|setup|set|configure|connect|load|register|start|open|bootstrap)"
REGISTRATION = r"\b(?:on|once|addEventListener|subscribe|register\w*|schedule\w*|setInterval|setTimeout|cron)\s*\([^()]*?([A-Za-z_$][\w$]*)\s*(?:,\s*\d+\s*)?\)"
EMISSION = r"\b(?:emit|track|increment|counter|gauge|histogram|record|metric)\w*\(\s*['\"]([\w.:/-]+)['\"]"
LITERAL = r"['\"]([\w.:/-]+)['\"]"
CONDITION = r"\bif\s*\(([^(){}]*[\w$]\.[\w$]+[^(){}]*[=<>]=?\s*['\"\d][^(){}]*)\)"
#: Words in names of what is kept for compatibility.
COMPAT = ("legacy", "compat", "v1", "old", "deprecated", "historic", "backcompat", "backward", "shim")
#: Verbs that undo each other.
INVERSES = {"encode": "decode", "serialize": "deserialize", "marshal": "unmarshal", "pack": "unpack", "format": "parse", "stringify": "parse", "write": "read", "save": "load", "to": "from"}
#: The ways in which a function reports a failure.
STYLES = {
    "throws": r"\bthrow\b",
    "null": r"\breturn\s+(null|undefined)\b",
    "false": r"\breturn\s+false\b",
    "result": r"\breturn\s*\{\s*(ok|error|success)\b",
    "rejects": r"\bPromise\.reject\(",
}
#: Two habits for the same thing.
HABITS = {
    "async": (r"\bawait\b", r"\.then\("),
    "equality": (r"[!=]==", r"(?<![=!<>])[!=]=(?!=)"),
    "binding": (r"\b(?:const|let)\s", r"\bvar\s"),
    "absence": (r"\bundefined\b", r"\bnull\b"),
    "failure": (r"\bthrow\b", r"\breturn\s+(?:null|undefined|false)\b"),
}

OWN = ("file_path", "name")


def _live(functions: DataFrame) -> DataFrame:
    return functions.where(~is_test_file(F.col("file_path")))


def _lines(text: str = "text") -> Column:
    return F.split(text, "\n")


def forwards(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(file_path, name, owner, target) of functions whose whole body hands its arguments to one other function."""
    only = functions.select(*OWN, F.regexp_extract("text", FORWARD, 1).alias("_callee")).where("_callee <> ''")
    return only.join(calls.withColumnRenamed("caller", "name"), list(OWN)).groupBy(*OWN).agg(F.count_distinct("owner", "target").alias("_n"), F.min("owner").alias("owner"), F.min("target").alias("target")).where("_n = 1").drop("_n")


def hollow_delegation_chain(functions: DataFrame, calls: DataFrame, least: int = 3, most: int = MOST_HOPS) -> DataFrame:
    """Chains of `least` hops or more that only forward, within one file; a chain that runs in a circle or leaves the file abstains.

    Of longer chains the first `most` hops are told, with `cut` true; what they do after the next hop is not looked at.
    """
    step = forwards(functions, calls)
    inside = step.where("owner = file_path").select(F.col("file_path").alias("_f"), F.col("name").alias("_n"), F.col("target").alias("_t"))
    chain = step.where("owner = file_path").select(*OWN, F.array("target").alias("chain"))
    for _ in range(most):
        met = chain.join(inside, (F.col("file_path") == F.col("_f")) & (F.element_at("chain", -1) == F.col("_n")), "left")
        chain = met.select(*OWN, F.when(F.col("_t").isNull() | (F.size("chain") > most), F.col("chain")).otherwise(F.concat("chain", F.array("_t"))).alias("chain"))
    leaves = step.where("owner <> file_path").select(F.col("file_path").alias("_f"), F.col("name").alias("_n"))
    chain = chain.withColumn("cut", F.size("chain") > most)
    chain = chain.join(leaves, (F.col("file_path") == F.col("_f")) & (F.element_at("chain", -1) == F.col("_n")) & ~F.col("cut"), "left_anti")
    once = (F.size(F.array_distinct("chain")) == F.size("chain")) & ~F.array_contains("chain", F.col("name"))
    return chain.where((F.size("chain") >= least) & once).select(*OWN, F.slice("chain", 1, most).alias("chain"), "cut")


def deep_delegation_chain(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls into another file of a function that only forwards to a third file."""
    middle = forwards(functions, calls).where("owner <> file_path").select(F.col("file_path").alias("_f"), F.col("name").alias("_n"), F.col("owner").alias("end_file"), F.col("target").alias("end"))
    first = calls.where("owner <> file_path").select("file_path", F.col("caller").alias("name"), F.col("owner").alias("via_file"), F.col("target").alias("via")).distinct()
    met = first.join(middle, (F.col("via_file") == F.col("_f")) & (F.col("via") == F.col("_n")))
    return met.where("end_file <> file_path").select(*OWN, "via_file", "via", "end_file", "end")


def skipped_intermediaries(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, middle): pairs that stand in `pairs` although source has an edge to middle and middle one to target."""
    # the targets of a source travel as lists to its middles, in place of a row for each two edges
    out = lambda rows: rows.where("source <> target").select("source", "target").distinct()
    listed = lambda rows, name: out(rows).withColumn("_at", F.floor((F.row_number().over(W.partitionBy("source").orderBy("target")) - 1) / LISTED)).groupBy("source", "_at").agg(F.collect_list("target").alias(name)).drop("_at")
    around = listed(pairs, "_wanted")
    steps = out(edges).select("source", F.col("target").alias("middle")).join(around, "source")
    onward = listed(edges, "_onward").withColumnRenamed("source", "middle")
    met = steps.join(onward, "middle").select("source", "middle", F.explode(F.array_intersect("_wanted", "_onward")).alias("target"))
    return met.select("source", "target", "middle")


def layer_skipping_call(calls: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Calls of another file around an imported file that itself imports it and guards what it passes on."""
    out = calls.where("owner <> file_path").select("file_path", F.col("caller").alias("name"), F.col("owner").alias("target"), F.col("target").alias("called")).distinct()
    guards = files.select(F.col("file_path").alias("middle"), F.slice(F.filter(F.split("source", "\n"), lambda x: x.rlike(GUARD)), 1, MOST_NAMED).alias("guards")).where(F.size("guards") > 0)
    around = skipped_intermediaries(out.select(F.col("file_path").alias("source"), "target"), edges).join(guards, "middle").withColumnRenamed("source", "file_path")
    return out.join(around, ["file_path", "target"]).select(*OWN, "target", "called", "middle", "guards")


def _used_sources(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_path, name, source, calls) of the imported bindings that a function calls."""
    root = functions.select(*OWN, F.explode(F.regexp_extract_all("text", F.lit(ROOT), F.lit(1))).alias("_root"))
    bound = imports.select("file_path", F.col("local").alias("_root"), F.coalesce("resolved", "specifier").alias("source")).distinct()
    return root.join(bound, ["file_path", "_root"]).groupBy(*OWN, "source").agg(F.count("*").alias("calls"))


def mixed_responsibilities(functions: DataFrame, imports: DataFrame, least: int = 2) -> DataFrame:
    """Functions that call into `least` import sources or more, with the number of calls to each."""
    by = _used_sources(_live(functions), imports).groupBy(*OWN).agg(F.array_sort(F.collect_list(F.struct("source", "calls"))).alias("collaborators"))
    return by.where(F.size("collaborators") >= least)


def chatty_interface(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Awaited calls of another file's function in a loop although that file exports a form for many."""
    out = calls.where("owner <> file_path").select("file_path", F.col("caller").alias("name"), "owner", "target").distinct()
    looped = F.concat(F.lit(r"\b(?:for|while)\s*\([^{]*\{[^}]*\bawait\s+(?:[\w$]+\.)?"), F.regexp_replace("target", r"\$", r"\\\$"), F.lit(r"\s*\("))
    at = out.join(functions.select(*OWN, "text"), list(OWN)).where(F.regexp_like("text", looped)).drop("text")
    bulk = functions.where("exported").select(F.col("file_path").alias("owner"), F.col("name").alias("batch"))
    plain = lambda c: F.lower(F.regexp_replace(c, r"(?i)(many|all|batch|bulk)", ""))
    stem = lambda c: F.regexp_replace(plain(c), r"(e?s)$", "")
    return at.join(bulk, "owner").where((F.col("batch") != F.col("target")) & (stem("batch") == stem("target")) & F.col("batch").rlike(r"(?i)many|all|batch|bulk|s$")).select(*OWN, "owner", "target", "batch")


def divergent_inverses(functions: DataFrame) -> DataFrame:
    """Pairs of a file whose names undo each other and whose fields differ: what one writes and the other reads."""
    body = F.regexp_replace("text", r"^[^{]*\{", "{")
    written = F.array_union(F.regexp_extract_all(body, F.lit(r"[{,]\s*([A-Za-z_$][\w$]*)\s*:"), F.lit(1)), F.regexp_extract_all(body, F.lit(r"\.([A-Za-z_$][\w$]*)\s*=(?!=)"), F.lit(1)))
    read = F.array_distinct(F.regexp_extract_all(body, F.lit(r"[\w$\])]\??\.([A-Za-z_$][\w$]*)\b(?!\s*[(=]|\w)"), F.lit(1)))
    tokens = name_tokens(F.col("name"))
    f = _live(functions).select(*OWN, F.element_at(tokens, 1).alias("_verb"), F.array_join(F.slice(tokens, F.lit(2), F.size(tokens)), " ").alias("_noun"), written.alias("_w"), read.alias("_r")).where(F.size(tokens) >= 1)
    words = F.create_map(*[F.lit(x) for pair in INVERSES.items() for x in pair])
    g = f.select("file_path", F.col("name").alias("inverse"), F.col("_verb").alias("_other"), "_noun", F.col("_r").alias("_read"))
    met = f.where(F.element_at(words, F.col("_verb")).isNotNull()).withColumn("_other", F.element_at(words, F.col("_verb"))).join(g, ["file_path", "_other", "_noun"])
    diff = met.select(*OWN, "inverse", F.array_sort(F.array_except("_w", "_read")).alias("writer_only"), F.array_sort(F.array_except("_read", "_w")).alias("reader_only"), (F.size("_w") * F.size("_read")).alias("_both"))
    return diff.where((F.col("_both") > 0) & (F.size("writer_only") + F.size("reader_only") > 0)).drop("_both")


def other_styles(rows: DataFrame, group: str, member: str, styles: str, most: int = MOST_NAMED) -> DataFrame:
    """(group, member, style, members, others): styles of a group that a member with a style of its own lacks, with the first members that have them."""
    each = rows.where(F.size(styles) > 0).select(group, member, F.explode(styles).alias("style")).distinct()
    # counted apart from the ranking, which Spark then cuts before it sorts a large group as a whole
    rank = F.row_number().over(W.partitionBy(group, "style").orderBy(member))
    first = each.withColumn("_rank", rank).where(F.col("_rank") <= most).groupBy(group, "style").agg(F.array_sort(F.collect_list(member)).alias("members"))
    have = first.join(each.groupBy(group, "style").agg(F.count("*").alias("others")), [group, "style"])
    own = rows.where(F.size(styles) > 0).select(F.col(group).alias("_g"), member, F.col(styles).alias("_s"))
    return have.join(own, F.col(group) == F.col("_g")).where(~F.array_contains("_s", F.col("style"))).select(group, member, "style", "members", "others")


def inconsistent_error_contract(functions: DataFrame) -> DataFrame:
    """Functions whose siblings report failures in a way that they do not."""
    styles = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(s)) for s, p in STYLES.items()]))
    return other_styles(_live(functions).select(*OWN, styles.alias("styles")), "file_path", "name", "styles")


def implicit_atomicity(functions: DataFrame) -> DataFrame:
    """Two durable effects or more in a row, with what speaks of a transaction around them."""
    ops = F.regexp_extract_all("text", F.lit(DURABLE), F.lit(1))
    signals = F.array_distinct(F.regexp_extract_all("text", F.lit(TRANSACTION), F.lit(0)))
    return _live(functions).select(*OWN, ops.alias("operations"), signals.alias("signals"), F.col("text").rlike(r"\bcatch\b").alias("handled")).where(F.size("operations") >= 2)


def pre_gate_side_effect(functions: DataFrame) -> DataFrame:
    """Lines with an effect that stand before the last line which turns the call away."""
    placed = F.transform(_lines(), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line"), (x.rlike(GATE) | (x.rlike(r"^\s*if\s*\(") & F.coalesce(F.get(_lines(), i + 1).rlike(REJECTS), F.lit(False)))).alias("gate")))
    last = F.array_max(F.transform(F.filter("_l", lambda x: x["gate"]), lambda x: x["at"]))
    effects = F.transform(F.filter("_l", lambda x: (x["at"] < F.col("gate_line")) & (x["at"] > 0) & ~x["gate"] & x["line"].rlike(EFFECT)), lambda x: x["line"])
    d = _live(functions).select(*OWN, placed.alias("_l")).withColumn("gate_line", last).where("gate_line is not null")
    return d.select(*OWN, F.slice(effects, 1, MOST_NAMED).alias("effects"), "gate_line").where(F.size("effects") > 0)


def convention_breaking_addition(functions: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    """Functions that follow a habit which the rest of their file never follows, against `least` cases of the other."""
    # each pattern runs once over each file and once over each function
    count = lambda text, mark: [F.regexp_count(text, F.lit(p)).alias(f"{mark}{habit}{k}") for habit, pair in HABITS.items() for k, p in enumerate(pair)]
    whole = files.select("file_path", *count(F.col("source"), "_all_"))
    met = _live(functions).select(*OWN, *count(F.col("text"), "_own_")).join(whole, "file_path")
    sides = []
    for habit, pair in HABITS.items():
        for a, b in ((0, 1), (1, 0)):
            own, rest = F.col(f"_own_{habit}{a}"), F.col(f"_all_{habit}{b}")
            breaks = (own > 0) & (F.col(f"_all_{habit}{a}") == own) & (rest >= least) & (F.col(f"_own_{habit}{b}") == 0)
            sides.append(F.when(breaks, F.lit(f"{habit}:{pair[a]}")))
    return met.select(*OWN, F.array_compact(F.array(*sides)).alias("divergences")).where(F.size("divergences") > 0)


def state_uses(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(file_path, name, binding, initialised, writes): module bindings that can be set anew and the functions that name them."""
    top = files.select("file_path", F.explode(F.filter(F.split("source", "\n"), lambda x: x.rlike(BINDING))).alias("_x"))
    held = top.select("file_path", F.regexp_extract("_x", BINDING, 1).alias("binding"), (F.regexp_extract("_x", BINDING, 2) == "=").alias("initialised")).distinct()
    met = _live(functions).select(*OWN, "text").join(held, "file_path").where(F.array_contains(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)), F.col("binding")))
    quoted = F.regexp_replace("binding", r"\$", r"\\\$")
    writes = F.regexp_like("text", F.concat(F.lit(r"(?<![\w$.])"), quoted, F.lit(r"\s*([-+*/|&?]{0,2}=(?!=)|\+\+|--)|(?<![\w$.])"), quoted, F.lit(r"\.(push|set|add|delete|clear|splice)\(")))
    return met.select(*OWN, "binding", "initialised", writes.alias("writes"))


def _callers(calls: DataFrame) -> DataFrame:
    """(file_path, name, caller_file, caller) of calls from other files outside tests."""
    out = calls.where((F.col("owner") != F.col("file_path")) & ~is_test_file(F.col("file_path")))
    return out.select(F.col("owner").alias("file_path"), F.col("target").alias("name"), F.col("file_path").alias("caller_file"), "caller").distinct()


def temporal_call_coupling(files: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Readers of module state that a set-up function writes, with the files that call the reader alone."""
    uses = state_uses(files, functions)
    writers = uses.where(F.col("writes") & F.col("name").rlike(SETUP)).select("file_path", "binding", F.col("name").alias("writer"))
    pairs = uses.where("not writes").join(writers, ["file_path", "binding"]).select(*OWN, "binding", "writer").distinct()
    users = _callers(calls)
    read = pairs.join(users, list(OWN)).select(*OWN, "binding", "caller_file").distinct()
    wrote = pairs.select("file_path", "binding", F.col("writer").alias("_w")).distinct().join(users.select("file_path", F.col("name").alias("_w"), "caller_file"), ["file_path", "_w"])
    flagged = read.join(wrote.select("file_path", "binding", "caller_file", F.lit(True).alias("_set")).distinct(), ["file_path", "binding", "caller_file"], "left")
    alone = flagged.groupBy(*OWN, "binding").agg(F.count("*").alias("callers"), F.count_if(F.col("_set").isNull()).alias("alone"))
    set_by = pairs.groupBy(*OWN, "binding").agg(F.array_sort(F.collect_set("writer")).alias("writers"))
    return set_by.join(alone, [*OWN, "binding"]).where("alone > 0")


def hidden_initialization_order(files: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Readers of a module binding without a first value that another function of the file writes, both called from other files."""
    uses = state_uses(files, functions).where("not initialised")
    counts = _callers(calls).groupBy(*OWN).agg(F.count("*").alias("callers"))
    writers = uses.where("writes").join(counts, list(OWN)).select("file_path", "binding", F.col("name").alias("writer"), F.col("callers").alias("writer_callers"))
    return uses.where("not writes").join(counts, list(OWN)).join(writers, ["file_path", "binding"]).select(*OWN, "binding", "writer", "callers", "writer_callers")


def reentrant_entry(files: DataFrame, functions: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Exported functions that write module state and are both called and registered to be called."""
    held = state_uses(files, functions.where("exported")).where("writes").groupBy(*OWN).agg(F.array_sort(F.collect_set("binding")).alias("bindings"))
    direct = _callers(calls).groupBy(*OWN).agg(F.count("*").alias("callers"))
    named = files.select("file_path", F.explode(F.regexp_extract_all("source", F.lit(REGISTRATION), F.lit(1))).alias("_local"))
    bound = imports.where("resolved is not null").select("file_path", F.col("local").alias("_local"), F.col("imported").alias("_i"), F.col("resolved").alias("_r")).distinct()
    at = named.join(bound, ["file_path", "_local"], "left").select(F.coalesce("_r", "file_path").alias("file_path"), F.coalesce("_i", "_local").alias("name"))
    sites = at.groupBy(*OWN).agg(F.count("*").alias("registrations"))
    return held.join(direct, list(OWN)).join(sites, list(OWN))


def unbounded_accumulation(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions that grow a container which lives as long as its module and which nothing there empties or measures."""
    top = files.where(~F.col("source").rlike(BOUNDED)).select("file_path", "source", F.explode(F.filter(F.split("source", "\n"), lambda x: x.rlike(CONTAINER))).alias("_x"))
    held = top.select("file_path", "source", F.regexp_extract("_x", CONTAINER, 1).alias("container"))
    quoted = F.regexp_replace("container", r"\$", r"\\\$")
    emptied = F.regexp_like("source", F.concat(F.lit(r"(?<![\w$.])"), quoted, F.lit(r"\.(delete|clear|shift|pop|splice|size|length)\b")))
    grows = F.concat(F.lit(r"(?<![\w$.])"), quoted, F.lit(r"(\.(push|set|add|unshift)\(|\[[^\]]+\]\s*=(?!=))"))
    kept = held.where(~emptied).select("file_path", "container", grows.alias("_grows"))
    return _live(functions).select(*OWN, "text").join(kept, "file_path").where(F.regexp_like("text", F.col("_grows"))).select(*OWN, "container")


def retry_storm_shape(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Functions that retry a dependency which functions of other files retry as well."""
    retrying = _live(functions).where(F.col("text").rlike(r"\b(for|while)\s*\([\s\S]*\bcatch\b") | F.col("text").rlike(r"(?i)\bretr(y|ies)\w*\s*\("))
    used = _used_sources(retrying, imports)
    by = used.groupBy("source").agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("sites")).where("files >= 2")
    return used.join(by, "source").select(*OWN, F.col("source").alias("dependency"), "files", "sites")


def repeated_handler_preamble(functions: DataFrame, least: int = 2) -> DataFrame:
    """Functions of a file that begin with the same guard."""
    body = F.transform(F.slice(_lines(), F.lit(2), F.size(_lines())), lambda x: F.trim(x))
    start = F.filter(body, lambda x: (x != "") & ~x.rlike(r"^(//|/?\*)"))  # the first statement, however many blank lines and comments stand before it
    guard = F.when(F.get(start, F.lit(0)).endswith("{"), F.array_join(F.slice(start, 1, 2), "\n")).otherwise(F.get(start, F.lit(0)))
    d = _live(functions).select(*OWN, guard.alias("preamble")).where(F.col("preamble").rlike(r"^(if\s*\(|(await\s+)?(assert|validate|authorize|ensure|require|check)\w*\()"))
    by = d.groupBy("file_path", "preamble").agg(F.count("*").alias("repetitions")).where(F.col("repetitions") >= least)
    return d.join(by, ["file_path", "preamble"]).select(*OWN, "preamble", "repetitions")


def shared_signatures(rows: DataFrame, group: str, signature: str) -> DataFrame:
    """(group, signature, groups): signatures that two groups or more have."""
    each = rows.select(group, signature).distinct()
    return each.join(each.groupBy(signature).agg(F.count("*").alias("groups")).where("groups >= 2"), signature)


def scattered_policy(functions: DataFrame) -> DataFrame:
    """Functions that decide by a condition over the same member and value as functions of other files."""
    cond = _live(functions).select(*OWN, F.explode(F.regexp_extract_all("text", F.lit(CONDITION), F.lit(1))).alias("_c"))
    d = cond.select(*OWN, F.regexp_replace(F.regexp_replace("_c", r"\b[A-Za-z_$][\w$]*\.", "."), r"\s+", "").alias("policy")).distinct()
    return d.join(shared_signatures(d, "file_path", "policy").withColumnRenamed("groups", "files"), ["file_path", "policy"]).select(*OWN, "policy", "files")


def _before(functions: DataFrame, files: DataFrame, chars: int = 600) -> DataFrame:
    """Functions with `_before`, the characters that precede their first line in their file."""
    met = functions.join(files.select("file_path", "source"), "file_path")
    above = F.array_join(F.slice(F.split("source", "\n"), F.lit(1), F.col("start_line") - 1), "\n")
    above = F.when(F.col("start_line") > 1, F.concat(above, F.lit("\n"))).otherwise(F.lit(""))
    return met.withColumn("_before", F.right(above, F.lit(chars))).drop("source")


def unmarked_abandoned_compat_layer(functions: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """Functions named as kept for compatibility that nothing calls and nothing marks, beside an exported one of the same name without that word."""
    rest = lambda c: F.filter(name_tokens(F.col(c)), lambda t: ~t.isin(*COMPAT))
    old = _before(_live(functions), files).where((F.size(rest("name")) < F.size(name_tokens(F.col("name")))) & (F.size(rest("name")) > 0) & ~F.col("_before").rlike(r"(?i)@deprecated|TODO|remove (after|in)"))
    idle = old.join(calls.select(F.col("owner").alias("_o"), F.col("target").alias("_t")).distinct(), (F.col("file_path") == F.col("_o")) & (F.col("name") == F.col("_t")), "left_anti")
    heirs = functions.where("exported").select(F.col("file_path").alias("heir_file"), F.col("name").alias("successor"), F.array_join(name_tokens(F.col("name")), " ").alias("_key"))
    met = idle.withColumn("_key", F.array_join(rest("name"), " ")).join(heirs, "_key")
    return met.select(*OWN, "heir_file", "successor")


def undocumented_contract(functions: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """Exported functions: whether a comment stands before them, what they throw, how many other files call them, and with how many bare literals."""
    own = _before(_live(functions).where("exported"), files).select(*OWN, F.col("_before").rlike(r"\*/\s*$|//[^\n]*\n\s*$").alias("documented"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"throw\s+new\s+([\w$]+)"), F.lit(1))).alias("throws"))
    out = calls.where((F.col("owner") != F.col("file_path")) & ~is_test_file(F.col("file_path")))
    by = out.groupBy(F.col("owner").alias("file_path"), F.col("target").alias("name")).agg(F.count_distinct("file_path").alias("caller_files"), F.count_if(F.col("arguments").rlike(r"(^|,)\s*(true|false|null|\d+)\s*(,|$)")).alias("opaque_calls"))
    return own.join(by, list(OWN), "left").fillna(0, ["caller_files", "opaque_calls"])


def unconsumed(emitted: DataFrame, mentioned: DataFrame, key: str) -> DataFrame:
    """Rows of `emitted` whose key stands in no row of `mentioned`."""
    return emitted.join(mentioned.select(key).distinct(), key, "left_anti")


def unconsumed_telemetry(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Names that a function emits and that no file mentions except to emit them."""
    names = _live(functions).select(*OWN, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(EMISSION), F.lit(1)))).alias("event"))
    rest = files.select(F.explode(F.regexp_extract_all(F.regexp_replace("source", EMISSION, ""), F.lit(LITERAL), F.lit(1))).alias("event"))
    return unconsumed(names, rest, "event").select(*OWN, "event")


def sibling_identifier_swap(functions: DataFrame) -> DataFrame:
    """Arguments given twice, comparisons with oneself and parameters of a twin that is used while they are not."""
    doubled = F.regexp_extract_all("text", F.lit(r"[\w$]\(\s*([A-Za-z_$][\w$.]*)\s*,\s*\1\s*[,)]"), F.lit(0))
    selves = F.regexp_extract_all("text", F.lit(r"(?<![\w$.])([A-Za-z_$][\w$.]*)\s*(?:[!=]==?|[<>]=?)\s*\1(?![\w$.(\[])"), F.lit(0))
    words = F.regexp_extract_all(F.regexp_replace("text", r"^[^{]*\{", ""), F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))
    idle = F.filter("parameters", lambda p: ~F.array_contains(words, p) & F.exists("parameters", lambda q: (q != p) & (F.element_at(name_tokens(q), 1) == F.element_at(name_tokens(p), 1)) & F.array_contains(words, q)))
    d = _live(functions).where(F.size("parameters") >= 2).select(*OWN, F.array_distinct(F.concat(doubled, selves)).alias("findings"), idle.alias("unused_twins"))
    return d.where(F.size("findings") + F.size("unused_twins") > 0)


def variant_partitioned_helper(functions: DataFrame, calls: DataFrame, least: int = 2) -> DataFrame:
    """Functions that branch on a parameter's literal, whose caller files each keep to one literal, with the files of each."""
    arms = _live(functions).select(*OWN, "text", F.posexplode("parameters").alias("position", "parameter"))
    quoted = F.regexp_replace("parameter", r"\$", r"\\\$")
    arms = arms.where(F.regexp_like("text", F.concat(F.lit(r"(?<![\w$.])"), quoted, F.lit(r"\s*===?\s*['\"]|switch\s*\(\s*"), quoted, F.lit(r"\s*\)")))).select(*OWN, "position", "parameter")
    given = calls.where(~is_test_file(F.col("file_path"))).select(F.col("owner").alias("_o"), F.col("target").alias("_t"), F.col("file_path").alias("_caller"), F.posexplode(split_top(F.col("arguments"))).alias("position", "_x"))
    literal = given.select("_o", "_t", "_caller", "position", F.regexp_extract("_x", r"^\s*['\"]([^'\"]*)['\"]\s*$", 1).alias("literal")).where("literal <> ''")
    met = arms.join(literal.withColumnsRenamed({"_o": "file_path", "_t": "name"}), [*OWN, "position"])
    one = met.groupBy(*OWN, "parameter", "_caller").agg(F.count_distinct("literal").alias("_n"), F.min("literal").alias("literal"))
    mixed = F.max("_n").over(W.partitionBy(*OWN, "parameter"))
    by = one.withColumn("_mixed", mixed).where("_mixed = 1").groupBy(*OWN, "parameter", "literal").agg(F.count("*").alias("files"))
    arms_of = by.groupBy(*OWN, "parameter").agg(F.array_sort(F.collect_list(F.struct("literal", "files"))).alias("arms"))
    return arms_of.where(F.size("arms") >= least)
