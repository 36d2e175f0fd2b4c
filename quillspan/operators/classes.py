"""Classes and their clients as many small two-sided graphs, whose connected parts are found all at once.

Methods and fields (or methods and calling files) are the nodes; parts never cross an owner, since every
node's key begins with it, so that one run of label propagation serves all classes of a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import code_lines, code_only, split_top
from quillspan.operators.relation_rules import is_test_file
from quillspan.operators.similarity import parts

METHOD = r"^\s*((?:(?:public|protected|private|static|async|override|readonly|get|set)\s+)*)\*?(#?[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*?(?:\{.*)?$"
#: Words that stand before a parenthesis and are no methods.
NO_METHOD = ("if", "for", "while", "switch", "catch", "return", "function", "super", "await", "new", "throw", "do", "else")
FIELD = r"\bthis\.(#?[A-Za-z_$][\w$]*)"
MEMBER_CALL = r"\.([A-Za-z_$][\w$]*)\s*\("
CLASS = r"\bclass\s+([\w$]+)"
HEAD = r"\bclass\s+([\w$]+)(?:<[^{]*?>)?(?:\s+extends\s+([\w$]+)(?:<[^{]*?>)?)?(?:\s+implements\s+([^{]+))?\s*\{"
#: A body that does nothing but refuse: empty, or one throw.
REFUSAL = r"^\{\s*(throw\b[^;}]*;?\s*)?\}$"
#: Paths that change more often than what is built on them should.
VOLATILE = r"(?i)(^|/)(fixtures?|mocks?|tests?|wip|draft|experimental|internal|private)(/|\.)|\.(test|spec)\."
#: How many members of a part are named.
MOST_NAMED = 12


def methods_of(spans: DataFrame) -> DataFrame:
    """(file_path, id, type_name, method, static, hidden, text) of the methods of classes: heads at the first level of braces, up to where the level ends."""
    classes = spans.where("kind = 'abstraction'").where(F.col("text").rlike(CLASS)).select("file_path", "id", "text", F.regexp_extract("text", CLASS, 1).alias("type_name"))
    both = F.arrays_zip(F.split("text", "\n").alias("line"), F.split(code_lines(F.col("text")), "\n").alias("code"))
    rows = classes.select("file_path", "id", "type_name", F.posexplode(both).alias("at", "x")).select("file_path", "id", "type_name", "at", "x.line", "x.code")
    step = F.length(F.regexp_replace("code", "[^{]", "")) - F.length(F.regexp_replace("code", "[^}]", ""))
    order = W.partitionBy("file_path", "id").orderBy("at")
    rows = rows.withColumn("after", F.sum(step).over(order)).withColumn("before", F.col("after") - step)
    name = F.regexp_extract("code", METHOD, 2)
    head = (F.col("before") == 1) & (name != "") & ~name.isin(*NO_METHOD)
    rows = rows.withColumn("head", F.when(head, name)).withColumn("number", F.sum(head.cast("int")).over(order))
    # what follows a method at the first level again, without being a head, belongs to no method
    rows = rows.where("number > 0").withColumn("inside", (F.col("before") > 1) | F.col("head").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    found = rows.where("inside").groupBy("file_path", "id", "type_name", "number").agg(F.max("head").alias("method"), text.alias("text"))
    first = F.split("text", "\n")[0]
    marks = F.regexp_extract(first, METHOD.replace(r"\([^;]*?(?:\{.*)?$", r"\("), 1)
    hidden = marks.rlike("private|protected") | F.col("method").startswith("#") | F.col("method").startswith("_")
    return found.where("method is not null").select("file_path", "id", "type_name", "method", marks.contains("static").alias("static"), hidden.alias("hidden"), "text")


def low_cohesion_class(methods: DataFrame, least: int = 2) -> DataFrame:
    """Classes whose methods fall into two groups or more that share no field, calls of each other counting as sharing.

    Constructors, which touch all fields, and static methods take no part.
    """
    own = methods.where((F.col("method") != "constructor") & ~F.col("static"))
    uses = own.select("file_path", "type_name", "method", F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(FIELD), F.lit(1)))).alias("field"))
    # a method is one of its own features, so that calling it joins caller and callee
    itself = own.select("file_path", "type_name", "method", F.col("method").alias("field"))
    grouped = parts(uses.unionByName(itself).distinct(), ["file_path", "type_name"], "method", "field")
    each = grouped.groupBy("file_path", "type_name", "part").agg(F.slice(F.array_sort(F.collect_set("method")), 1, MOST_NAMED).alias("methods"), F.count("*").alias("n"))
    out = each.groupBy("file_path", "type_name").agg(F.count("*").alias("n_parts"), F.sum("n").alias("n_methods"), F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("n", "methods")))), 1, MOST_NAMED).alias("parts"))
    return out.where(F.col("n_parts") >= least)


def partitioned_fat_interface(methods: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    """Classes of `least` open methods or more that files call in groups which have no file and no method in common.

    Members are known by name only, so that calls count of files that name the class.
    """
    own = methods.where((F.col("method") != "constructor") & ~F.col("hidden")).select("file_path", "type_name", "method").distinct()
    wide = own.join(own.groupBy("file_path", "type_name").agg(F.count("*").alias("n_methods")).where(F.col("n_methods") >= least), ["file_path", "type_name"])
    live = files.where(~is_test_file(F.col("file_path"))).select(F.col("file_path").alias("user"), "source")
    called = live.select("user", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(MEMBER_CALL), F.lit(1)))).alias("method"))
    names = live.select("user", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"\b[A-Z][\w$]*"), F.lit(0)))).alias("type_name"))
    met = wide.join(called, "method").join(names, ["user", "type_name"], "left_semi").where("user <> file_path")
    grouped = parts(met, ["file_path", "type_name"], "method", "user")
    clients = met.groupBy("file_path", "type_name").agg(F.count_distinct("user").alias("n_clients"), F.max("n_methods").alias("n_methods"))
    each = grouped.groupBy("file_path", "type_name", "part").agg(F.slice(F.array_sort(F.collect_set("method")), 1, MOST_NAMED).alias("methods"))
    out = each.groupBy("file_path", "type_name").agg(F.count("*").alias("n_parts"), F.slice(F.array_sort(F.collect_list("methods")), 1, MOST_NAMED).alias("parts"))
    return out.where("n_parts >= 2").join(clients, ["file_path", "type_name"])


def heritage_of(spans: DataFrame) -> DataFrame:
    """(file_path, id, type_name, base, face): classes with the class that they extend and each interface that they implement; a row with nulls for those without."""
    head = lambda k: F.nullif(F.trim(F.regexp_extract(code_lines(F.col("text")), HEAD, k)), F.lit(""))
    rows = spans.where("kind = 'abstraction'").select("file_path", "id", head(1).alias("type_name"), head(2).alias("base"), head(3).alias("faces")).where("type_name is not null")
    faces = F.transform(split_top(F.coalesce("faces", F.lit(""))), lambda x: F.regexp_extract(x, r"^([\w$.]+)", 1))
    return rows.select("file_path", "id", "type_name", "base", F.explode_outer(faces).alias("face"))


def _body(text: str) -> Column:
    code = F.regexp_replace(code_only(F.col(text)), r"\s+", " ")
    return F.regexp_extract(code, r"\)(?:\s*:[^{]*)?\s*(\{.*\})\s*$", 1)


def refused_inheritance(heritage: DataFrame, methods: DataFrame, imports: DataFrame) -> DataFrame:
    """Classes that override methods of the class they extend, of their own file or an imported one, only to refuse them: with an empty
    body or one that throws, where the inherited one does more."""
    bound = imports.where("resolved is not null").select("file_path", F.col("local").alias("base"), F.col("resolved").alias("_r"), F.col("imported").alias("_i")).distinct()
    subs = heritage.where("base is not null").select("file_path", "type_name", "base").distinct().join(bound, ["file_path", "base"], "left")
    named = F.when(F.col("_i").isNotNull() & (F.col("_i") != "default"), F.col("_i")).otherwise(F.col("base"))
    subs = subs.select("file_path", "type_name", F.coalesce("_r", "file_path").alias("base_file"), named.alias("base"))
    open_ = methods.where((F.col("method") != "constructor") & ~F.col("static")).withColumn("refuses", _body("text").rlike(REFUSAL))
    over = open_.select("file_path", "type_name", "method", "refuses")
    given = open_.select(F.col("file_path").alias("base_file"), F.col("type_name").alias("base"), "method", F.col("refuses").alias("_given"))
    met = subs.join(given, ["base_file", "base"]).join(over, ["file_path", "type_name", "method"], "left")
    by = met.groupBy("file_path", "type_name", "base_file", "base").agg(
        F.count("*").alias("inherited"), F.count_if(F.col("refuses").isNotNull()).alias("overridden"), F.array_sort(F.collect_set(F.when(F.col("refuses") & ~F.col("_given"), F.col("method")))).alias("refused")
    )
    return by.where(F.size("refused") > 0)


def divergent_sibling_interfaces(heritage: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods of classes with a common base or interface that take another number of parameters than the same method does in most of these classes."""
    kin = heritage.select("file_path", "type_name", F.explode(F.array("base", "face")).alias("kin")).where("kin is not null").distinct()
    first = F.array_join(F.slice(F.split("text", "\n"), 1, 1), "")
    arity = F.size(split_top(F.regexp_extract(first, r"\(([^)]*)\)", 1)))
    own = methods.where((F.col("method") != "constructor") & ~F.col("static") & ~F.col("hidden")).select("file_path", "type_name", "method", arity.alias("arity"))
    met = kin.join(own, ["file_path", "type_name"])
    counts = met.groupBy("kin", "method", "arity").agg(F.count("*").alias("n"))
    usual = counts.groupBy("kin", "method").agg(F.max(F.struct("n", (-F.col("arity")).alias("a"))).alias("u"), F.sum("n").alias("siblings"))
    out = met.join(usual, ["kin", "method"]).where((F.col("arity") != -F.col("u.a")) & (F.col("siblings") >= 2))
    return out.select("file_path", "type_name", "kin", "method", "arity", (-F.col("u.a")).alias("usual"), "siblings")


def stability_inversion(spans: DataFrame, imports: DataFrame, edges: DataFrame) -> DataFrame:
    """Types that name an imported thing of a file which fewer files import than their own, or which lies where things change: the
    types that much is built on and that are built on something less stable."""
    importers = edges.where("source <> target").groupBy(F.col("target").alias("_t")).agg(F.count_distinct("source").alias("n"))
    name = F.regexp_extract("text", r"\b(?:class|interface|type|enum)\s+([\w$]+)", 1)
    words = F.array_distinct(F.regexp_extract_all(code_lines(F.col("text")), F.lit(r"(?<![\w$.])[A-Za-z_$][\w$]*"), F.lit(0)))
    types = spans.where("kind = 'abstraction'").select("file_path", name.alias("type_name"), F.explode(words).alias("local")).where("local <> type_name and type_name <> ''")
    bound = imports.where("resolved is not null and resolved <> file_path").select("file_path", "local", F.col("resolved").alias("target")).distinct()
    met = types.join(bound, ["file_path", "local"]).groupBy("file_path", "type_name", "target").agg(F.min("local").alias("symbol"))
    own = importers.select(F.col("_t").alias("file_path"), F.col("n").alias("importers"))
    other = importers.select(F.col("_t").alias("target"), F.col("n").alias("target_importers"))
    met = met.join(own, "file_path").join(other, "target").withColumn("volatile", F.col("target").rlike(VOLATILE))
    return met.where((F.col("importers") >= 2) & (F.col("volatile") | (F.col("target_importers") < F.col("importers")))).select("file_path", "type_name", "target", "symbol", "importers", "target_importers", "volatile")
