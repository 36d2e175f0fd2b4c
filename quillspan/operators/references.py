"""A table of all identifiers of a tree, by name and place, that rules read in place of the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspan.functions.text import blanked, code_lines

#: An import statement, strings gone; a re-export binds no name of its file.
IMPORTING = r"(?m)^\s*import\b[^;()=]*?\bfrom\b|^\s*export\s*(?:type\s*)?(?:\{[^}]*\}|\*(?:\s+as\s+[\w$]+)?)\s*from\b"
SITE = r"(?:\b(?:function\*?|class|interface|type|enum|const|let|var)\s+)?\??\.{0,3}[A-Za-z_$][\w$]*(?:\s*\()?"
DECLARED = r"^(?:function\*?|class|interface|type|enum|const|let|var)\s"
#: Fixed value: references of a function that are told.
MOST_TOLD = 20


def postings(files: DataFrame) -> DataFrame:
    """(name, file_path, line_number, position, kind): identifiers outside strings, comments and imports, declared, called, as a member of something, or as a value."""
    # in steps, as a column that is read several times is otherwise worked out anew each time
    code = files.select("file_path", code_lines(F.col("source")).alias("code")).select("file_path", blanked(F.col("code"), IMPORTING).alias("code"))
    rows = code.select("file_path", F.posexplode(F.split("code", "\n")).alias("at", "line"))
    sites = rows.select("file_path", (F.col("at") + 1).alias("line_number"), F.posexplode(F.regexp_extract_all("line", F.lit(SITE), F.lit(0))).alias("position", "site"))
    name = F.regexp_extract("site", r"([A-Za-z_$][\w$]*)\s*\(?$", 1)
    kind = F.when(F.col("site").rlike(DECLARED), "declared").when(F.col("site").rlike(r"^\??\.(?!\.\.)"), "member").when(F.col("site").endswith("("), "called").otherwise("value")
    return sites.select(name.alias("name"), "file_path", "line_number", "position", kind.alias("kind"))


def function_references(functions: DataFrame, imports: DataFrame, posted: DataFrame) -> DataFrame:
    """(owner, target, file_path, line_number, position, kind) of the places that name a function: in files that bind it by an
    import, and in its own."""
    known = functions.select(F.col("file_path").alias("owner"), F.col("name").alias("target")).distinct()
    bound = imports.where("resolved is not null").select("file_path", F.col("local").alias("name"), F.col("resolved").alias("owner"), F.when(F.col("imported") == "default", F.col("local")).otherwise(F.col("imported")).alias("target")).distinct()
    own = known.select(F.col("owner").alias("file_path"), F.col("target").alias("name"), "owner", "target")
    names = bound.join(known, ["owner", "target"], "left_semi").unionByName(own).distinct()
    return posted.where("kind in ('called', 'value')").join(names, ["file_path", "name"]).select("owner", "target", "file_path", "line_number", "position", "kind")


def first_references(references: DataFrame, most: int = MOST_TOLD) -> DataFrame:
    """The first references of each function, in the order of files and lines, and how many there are in all."""
    totals = references.groupBy("owner", "target").agg(F.count("*").alias("total"))
    place = W.partitionBy("owner", "target").orderBy("file_path", "line_number", "position")
    return references.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most).join(totals, ["owner", "target"])
