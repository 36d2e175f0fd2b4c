"""Functions compared by the kinds of their statements, in order.

A function's shape is a string with one letter for each statement of its body; what is nested in a
statement is no part of it. Shapes are compared as strings, each distinct shape once, however many
functions have it: an inverted index of winnowed runs of letters brings together the shapes that may
be near, and the edit distance decides. Of every window of WINDOW runs the rarest one is indexed, so
that shapes with WINDOW + RUN - 1 statements in common in a row always meet, and runs that most
functions have are indexed only where nothing rarer stands beside them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import code_only, directory, split_top
from quillspan.operators.relation_rules import HEAD
from quillspan.session import dealt, stored

#: Letters of the kinds of statements and how these begin, tried in order; any other statement is an expression (E).
KINDS = (
    ("I", r"if\b"), ("F", r"(for|while|do)\b"), ("S", r"switch\b"), ("T", r"try\b"), ("R", r"return\b"), ("X", r"throw\b"),
    ("V", r"(const|let|var)\b"), ("D", r"(export\s+)?(async\s+)?(function|class|interface|type|enum)\b"), ("B", r"(break|continue)\b"),
)
#: Lines that go on with the statement before them.
GOES_ON = r"^\s*([)\]}.,?:&|+*]|=>|else\b|catch\b|finally\b|$)"

RUN, WINDOW = 3, 3
#: Two shapes are near up to this part of the longer one in edits.
NEAR = 4
#: Words of 64 bits for the letters of a shape; the least length of shapes whose runs are compared before the edits.
WORDS, LONG = 4, 36
#: Functions of a shape that are compared with those of a near one; how many lookalikes are named.
PARTNERS, MOST_LOOKALIKES, MOST_MATCHES = 12, 3, 5

#: Members that any two functions may share.
GENERIC_MEMBERS = ("map", "filter", "forEach", "reduce", "push", "pop", "slice", "length", "then", "catch")
#: Words that say nothing of what a function does.
NON_IMPLEMENTATION_TOKENS = (
    "export", "import", "from", "as", "type", "interface", "string", "number", "boolean", "void", "unknown", "any", "return", "const", "let", "function",
)

STRING_OR_NUMBER = r"""(?<![\w$])(?:"[^"\n]*"|'[^'\n]*'|\d[\w.]*)"""


def shape_of(text: Column) -> Column:
    """The shape of a function's text; P for an arrow function whose body is one expression."""
    body = F.regexp_replace(code_only(text), HEAD + r"[^{\n]*\{", "\u0000")
    inside = F.regexp_extract(body, "(?s)\u0000(.*)\\}", 1)
    opened = lambda x, c: F.length(x) - F.length(F.regexp_replace(x, c, ""))

    def step(acc: Column, x: Column) -> Column:
        kind = F.lit("E")
        for letter, pattern in reversed(KINDS):
            kind = F.when(F.trim(x).rlike("^" + pattern), F.lit(letter)).otherwise(kind)
        starts = (acc["depth"] == 0) & ~x.rlike(GOES_ON)
        depth = F.greatest(acc["depth"] + opened(x, r"[{(\[]") - opened(x, r"[})\]]"), F.lit(0))
        return F.struct(depth.alias("depth"), F.when(starts, F.concat(acc["shape"], kind)).otherwise(acc["shape"]).alias("shape"))

    statements = F.split(F.regexp_replace(inside, r";[ \t]*(?=\S)", ";\n"), "\n")
    folded = F.aggregate(statements, F.struct(F.lit(0).alias("depth"), F.lit("").alias("shape")), step)["shape"]
    return F.when(F.instr(body, "\u0000") > 0, folded).otherwise(F.when(F.instr(body, "=>") > 0, F.lit("P")).otherwise(F.lit("")))


def _picks(shapes: DataFrame, run: int, window: int) -> DataFrame:
    """(shape, picks, runs): of each window of `window` runs of letters the one that fewest of the (distinct) shapes have; the hashes of all
    runs of long shapes, null for others."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("shape") - (run - 1), F.lit(1)))
    grams = shapes.select("shape", F.posexplode(F.transform(starts, lambda i: F.substring("shape", i, F.lit(run)))).alias("at", "gram"))
    counts = grams.groupBy("gram").agg(F.count_distinct("shape").alias("n"))
    ranked = grams.join(counts, "gram").groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("at", F.struct("n", "gram").alias("g")))).alias("gs"))
    places = F.sequence(F.lit(1), F.greatest(F.size("gs") - (window - 1), F.lit(1)))
    picked = F.transform(places, lambda i: F.array_min(F.transform(F.slice("gs", i, F.lit(window)), lambda x: x["g"])))
    runs = F.array_distinct(F.transform("gs", lambda x: F.hash(x["g"]["gram"])))
    return ranked.select("shape", F.transform(F.array_distinct(picked), lambda x: x["gram"]).alias("picks"), F.when(F.length("shape") >= LONG, runs).alias("runs"))


def winnowed(shapes: DataFrame, run: int = RUN, window: int = WINDOW) -> DataFrame:
    """(shape, gram): the picked runs of each of the (distinct) shapes."""
    return _picks(shapes, run, window).select("shape", F.explode("picks").alias("gram"))


def _sketched(shapes: DataFrame) -> DataFrame:
    """Adds `n`, the letters of a shape, and words of 64 bits in which each letter has as many bits as there are of it, up to eight.

    An edit changes two bits at most, one that adds or removes a letter one; bits that meet make fewer differ.
    """
    times = lambda x: F.length("shape") - F.length(F.replace(F.col("shape"), x, F.lit("")))
    some = lambda x: F.call_function("shiftleft", F.lit(1), F.least(times(x), F.lit(8))).cast("long") - 1
    bits = lambda x: F.call_function("shiftleft", some(x), F.ascii(x).bitwiseAND(F.lit(28)) * 2)
    word = lambda k: F.filter("_letters", lambda x: (x != "") & (F.ascii(x).bitwiseAND(F.lit(3)) == k))
    words = [F.aggregate(word(k), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bits(x))).alias(f"w{k}") for k in range(WORDS)]
    return shapes.withColumn("_letters", F.array_distinct(F.split("shape", ""))).select(*shapes.columns, F.length("shape").alias("n"), *words)


def near_shapes(shapes: DataFrame, run: int = RUN, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """(left, right, distance) of distinct shapes, left before right, with at most a `near`-th of the longer one in edits.

    Shapes with a picked run in common meet within bands of lengths: the longer one of a near pair is in the band of the
    shorter one or in the next. A pair that meets is sorted out where it meets, by lengths, letters, runs and edit distance, so that only
    near pairs are shuffled; the pairs that meet still grow with the square of the shapes that pick a run.
    """
    picks = _picks(shapes.select("shape").distinct(), run, window)
    index = stored(_sketched(picks))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(near / (near - 1))) if near > 1 else F.lit(0).cast("long")
    words = [f"w{k}" for k in range(WORDS)]
    sided = lambda side, b: index.select(*[F.col(c).alias(f"{side}_{c}") for c in ("shape", "n", *words, "runs")], b, "picks").select("*", F.explode("picks").alias("gram")).drop("picks")
    longer = dealt(sided("l", band.alias("band")), "gram", "band")
    shorter = dealt(sided("s", F.explode(F.array(band, band + 1)).alias("band")), "gram", "band")
    most = F.expr(f"cast(l_n div {near} as int)")
    gap = F.col("l_n") - F.col("s_n")
    bits = sum((F.bit_count(F.col(f"l_{w}").bitwiseXOR(F.col(f"s_{w}"))) for w in words), F.lit(0))
    # an edit changes as many runs as one has letters, before and after it; one that adds or removes a letter one less
    runs = F.size("l_runs") + F.size("s_runs") - 2 * F.size(F.array_intersect("l_runs", "s_runs"))
    in_runs = F.col("l_runs").isNull() | F.col("s_runs").isNull() | (runs <= 2 * run * most - gap)
    once = (gap > 0) | (F.col("s_shape") < F.col("l_shape"))
    edits = F.expr(f"levenshtein(l_shape, s_shape, cast(l_n div {near} as int))")
    met = longer.join(shorter, ["gram", "band"]).where((gap >= 0) & (gap <= most) & once & (bits <= 2 * most - gap) & in_runs & (edits >= 0))
    return met.select(F.least("l_shape", "s_shape").alias("left"), F.greatest("l_shape", "s_shape").alias("right"), edits.cast("long").alias("distance")).distinct()


def prints(functions: DataFrame) -> DataFrame:
    """(file_path, name, shape, members, literals, tokens, signature) of functions."""
    generic = F.array(*[F.lit(m) for m in GENERIC_MEMBERS])
    members = F.array_sort(F.array_except(F.regexp_extract_all(code_only(F.col("text")), F.lit(r"\.([A-Za-z_$][\w$]*)"), F.lit(1)), generic))
    literals = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(STRING_OR_NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))))
    words = F.transform(F.regexp_extract_all("text", F.lit(r"(?<![\w$])[A-Za-z_$][\w$]*"), F.lit(0)), lambda x: F.lower(x))
    tokens = F.array_except(F.array_distinct(words), F.array(*[F.lit(t) for t in NON_IMPLEMENTATION_TOKENS]))
    head = F.concat(F.regexp_extract("text", HEAD, 3), F.regexp_extract("text", HEAD, 5))
    types = F.transform(split_top(head), lambda p: F.lower(F.trim(F.regexp_extract(p, r"^[^:=]*:\s*([^=]+)", 1))))
    returned = F.lower(F.trim(F.regexp_extract("text", r"\)\s*:\s*([^={;]+?)\s*(?:=>|\{)", 1)))
    signature = F.when(F.size(types) > 0, F.concat_ws("|", F.array_join(types, ","), returned))
    return functions.select("file_path", "name", shape_of(F.col("text")).alias("shape"), members.alias("members"), literals.alias("literals"), tokens.alias("tokens"), signature.alias("signature"))


def _name_words(name: Column) -> Column:
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.array_distinct(F.split(F.lower(spaced), "[^a-z0-9]+")), lambda t: F.length(t) >= 3)


def _other(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"o_{c}") for c in rows.columns])


def related_files(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(file_path, o_file_path): each file with itself, those that it imports and those that import it."""
    both = edges.select(F.col("source").alias("file_path"), F.col("target").alias("o_file_path"))
    back = both.select(F.col("o_file_path").alias("file_path"), F.col("file_path").alias("o_file_path"))
    own = functions.select("file_path", F.col("file_path").alias("o_file_path"))
    return both.unionByName(back).unionByName(own).distinct()


def _caller_files(calls: DataFrame) -> DataFrame:
    """(file_path, name, users): the files that call a function."""
    return calls.groupBy(F.col("owner").alias("file_path"), F.col("target").alias("name")).agg(F.collect_set(calls["file_path"]).alias("users"))


def _with_users(rows: DataFrame, calls: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.join(_caller_files(calls), ["file_path", "name"], "left").withColumn("users", F.coalesce("users", none))


def lookalikes(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of functions (columns of `found`, and o_ for the other one) that may look alike, with `distance`, the edits
    between their shapes (null for related files whose shapes are not near), and `alike`, how many functions the
    shape of the other one has.

    Functions of related files meet by the edges between these; over the whole tree each function meets the first
    PARTNERS functions of its own shape (three statements or more) and of each near one.
    """
    long_enough = found.where(F.length("shape") >= 2)
    classes = long_enough.where(F.length("shape") >= 3)
    by_shape = W.partitionBy("shape")
    first = classes.withColumns({"rank": F.row_number().over(by_shape.orderBy("file_path", "name")), "alike": F.count("*").over(by_shape)})
    partners = _other(first.where(F.col("rank") <= PARTNERS).drop("rank"))
    shapes = classes.select("shape").distinct()
    close = near_shapes(shapes)
    same = shapes.select("shape", F.col("shape").alias("o_shape"), F.lit(0).cast("long").alias("distance"))
    one = close.select(F.col("left").alias("shape"), F.col("right").alias("o_shape"), "distance")
    two = close.select(F.col("right").alias("shape"), F.col("left").alias("o_shape"), "distance")
    reach = same.unionByName(one).unionByName(two)
    over_tree = classes.join(reach, "shape").join(partners, "o_shape")
    nearby = long_enough.join(related_files(edges, found), "file_path").join(_other(long_enough).withColumn("o_alike", F.lit(None).cast("long")), "o_file_path")
    nearby = nearby.withColumn("distance", F.levenshtein("shape", "o_shape").cast("long"))
    longer = F.greatest(F.length("shape"), F.length("o_shape"))
    nearby = nearby.withColumn("distance", F.when(F.col("distance") * NEAR <= longer, F.col("distance")))
    both = over_tree.unionByName(nearby.select(*over_tree.columns))
    both = both.where((F.col("file_path") != F.col("o_file_path")) | (F.col("name") != F.col("o_name")))
    keys = ["file_path", "name", "o_file_path", "o_name"]
    alike = both.groupBy(*keys).agg(F.max("o_alike").alias("alike"), *[F.first(c).alias(c) for c in both.columns if c not in [*keys, "o_alike"]])
    return alike


def coincidental_similarity(functions: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """For each function the most divergent lookalikes: functions that share a literal, two members or the order of three
    statements or more with it (or nearly that order), and differ in members, in the words of their names and in their callers."""
    pairs = lookalikes(_with_users(prints(functions), calls), edges)
    shared_members, shared_literals = F.array_intersect("members", "o_members"), F.array_intersect("literals", "o_literals")
    in_order = (F.col("distance") == 0) & (F.length("shape") >= 3)
    pairs = pairs.withColumns({"shared_members": shared_members, "shared_literals": shared_literals, "same_order": F.coalesce(in_order, F.lit(False))})
    met = pairs.where((F.size("shared_literals") >= 1) | (F.size("shared_members") >= 2) | ((F.col("distance").isNotNull()) & (F.length("shape") >= 3)))
    words, others = _name_words(F.col("name")), _name_words(F.col("o_name"))
    met = met.withColumns({
        "own_members": F.array_except("members", "o_members"), "other_members": F.array_except("o_members", "members"),
        "distinct_words": F.array_sort(F.array_union(F.array_except(words, others), F.array_except(others, words))),
        "common_callers": F.array_sort(F.array_intersect("users", "o_users")),
    })
    score = F.size("own_members") + F.size("other_members") + F.size("distinct_words") - 2 * F.size("common_callers")
    best = W.partitionBy("file_path", "name").orderBy(F.desc("score"), "o_file_path", "o_name")
    met = met.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MOST_LOOKALIKES)
    same_place = directory(F.col("file_path")) == directory(F.col("o_file_path"))
    return met.select(
        "file_path", "name", F.col("o_file_path").alias("other_file"), F.col("o_name").alias("other"), "score", "distance", "same_order", "shared_members", "shared_literals", "own_members",
        "other_members", "distinct_words", "common_callers", same_place.alias("same_directory"), "alike",
    )


def paraphrased_sibling_logic(functions: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions of related files with equal signatures whose words differ by half at least, without a literal and with fewer
    than two members in common: the same task in other words. The most different ones of each function."""
    found = _with_users(prints(functions), calls).where("signature is not null")
    other = _other(found).withColumnRenamed("o_signature", "signature")
    pairs = found.join(related_files(edges, functions), "file_path").join(other, ["o_file_path", "signature"]).where("name <> o_name")
    shared = F.size(F.array_intersect("tokens", "o_tokens"))
    apart = 1 - shared / F.size(F.array_union("tokens", "o_tokens"))
    met = pairs.withColumns({"dissimilarity": F.round(apart, 2), "shared_members": F.array_intersect("members", "o_members")})
    met = met.where((apart >= 0.5) & ~F.arrays_overlap("literals", "o_literals") & (F.size("shared_members") < 2))
    best = W.partitionBy("file_path", "name").orderBy(F.desc("dissimilarity"), "o_file_path", "o_name")
    met = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MOST_MATCHES)
    return met.select(
        "file_path", "name", F.col("o_file_path").alias("other_file"), F.col("o_name").alias("other"), "signature", "dissimilarity", "shared_members",
        F.array_sort(F.array_intersect("users", "o_users")).alias("common_callers"),
    )
