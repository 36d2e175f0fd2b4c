"""Licence scans: the canonical digest of an entire text looked up among digests of known licences.

Canonical form, in this order: lines that begin with "Copyright" and a name go; lower case; lines that
state a copyright otherwise (or "all rights reserved") go; equivalent spellings are made one;
everything but a-z and 0-9 becomes one space. Texts are hashed in Spark and joined to the digests; a
text matches if it is that licence and nothing else. Short licences are known by their texts, long
ones by their digests; `known_licenses` reads more of either from a stored table.

Defined results: a text of any length is hashed whole; a null or empty text, and one of which nothing is left, has the digest of the
empty text and matches nothing; equal known texts resolve to the smallest licence id; a row of the
known licences with neither text nor digest is ignored; repeated rows are looked up one by one. Columns of the
input other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import SALTS, join_dimension, let, settle, table
from quillspan.llm.license_texts import DIGESTS, LICENSES

#: A name after the word: a capital or a placeholder, but no "Copyright Holder, License, Law, Notice, Owner, Treaty" of a wrapped sentence.
NAMED_LINE = r"^[ \t/#*;-]*Copyright[ \t]+(by[ \t]+)?([A-GI-KMP-SU-Z<{\[]|H([^o]|o[^l])|L([^ai]|a[^w]|i[^c])|N([^o]|o[^t])|O([^w]|w[^n])|T([^r]|r[^e]))[^\n]*$"
COPYRIGHT_LINE = r"(?m)^[^\n]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)[ \t]+(copyright|[0-9])|©|all rights reserved)[^\n]*$"
#: Every text with such a line holds one of these.
COPYRIGHT_MARKS = ("copyright", "(c)", "©", "all rights reserved")
#: Spellings that licence matching guidelines call equivalent, as a pattern and what it becomes.
SPELLINGS = (
    ("licenc(e|ed|es|ing)", "licens", 1),
    ("sub-licens(e|ed|es|ing)", "sublicens", 1),
    ("non-commercial", "noncommercial", 0),
    ("per cent", "percent", 0),
    ("organis(ation|ations)", "organiz", 1),
    ("authoris(e|ed|es|ation)", "authoriz", 1),
    ("favour", "favor", 0),
    ("honour", "honor", 0),
    ("merchantibility", "merchantability", 0),
    ("acknowledgement", "acknowledgment", 0),
    ("copyright owner", "copyright holder", 0),
    ("http:", "https:", 0),
)


def _plain(pattern: str) -> str:
    return pattern.split("(")[0]


def canonical(text: Column) -> Column:
    """The canonical form; patterns run only over texts that hold a string which they need."""

    def spelled(c: Column) -> Column:
        c = F.regexp_replace(c, COPYRIGHT_LINE, " ")
        for pattern, one, groups in SPELLINGS:
            c = F.regexp_replace(c, pattern, one + "$1" * groups)
        return c

    def fixed(c: Column) -> Column:
        needs = F.lit(False)
        for mark in (*COPYRIGHT_MARKS, *[_plain(p) for p, _, _ in SPELLINGS]):
            needs = needs | c.contains(mark)
        return F.when(needs, spelled(c)).otherwise(c)

    raw = F.coalesce(text, F.lit(""))
    unnamed = F.when(raw.contains("Copyright"), F.regexp_replace(raw, "(?dm)" + NAMED_LINE, " ")).otherwise(raw)
    lowered = F.lower(unnamed)
    return F.trim(F.regexp_replace(let(lowered, fixed), "[^a-z0-9]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, path: str | None = None) -> DataFrame:
    """license_id and text or canonical_sha256 (the other is null) of the licences that come with this module,
    and of those in the Parquet table at `path`, which has license_id and one or both of the two columns."""
    rows = [(k, t, None) for k, t in sorted(LICENSES.items())] + [(k, None, d) for k, ds in sorted(DIGESTS.items()) for d in ds]
    known = spark.createDataFrame(rows, "license_id string, text string, canonical_sha256 string")
    return known if path is None else known.unionByName(spark.read.parquet(path), allowMissingColumns=True).select(*known.columns)


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256 and license_id (null if unknown) of each row of `docs`.

    `known` has license_id and one or both of text and canonical_sha256; a text goes before a digest.
    """
    nothing = F.lit(None).cast("string")
    text, given = (F.col(c) if c in known.columns else nothing for c in ("text", "canonical_sha256"))
    by_digest = known.select("license_id", canonical(text).alias("form"), text.isNull().alias("bare"), F.lower(given).alias("given"))
    by_digest = by_digest.select("license_id", F.when(F.col("bare"), F.col("given")).when(F.col("form") != "", F.sha2("form", 256)).alias("canonical_sha256"))
    by_digest = settle(by_digest.where("canonical_sha256 is not null").groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id")))
    hashed = docs.select("doc_id", digest(F.col("text")).alias("canonical_sha256"))
    return join_dimension(hashed, by_digest, ["canonical_sha256"], spread=F.pmod(F.xxhash64("doc_id"), F.lit(SALTS * 64))).select("doc_id", "canonical_sha256", "license_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql_canonical(text: str) -> str:
    c = f"regexp_replace(coalesce({text}, ''), '(?m){NAMED_LINE}', ' ', 'g')"
    c = f"regexp_replace(lower({c}), '{COPYRIGHT_LINE}', ' ', 'g')"
    for pattern, one, groups in SPELLINGS:
        c = f"regexp_replace({c}, '{pattern}', '{one}{'' if not groups else chr(92) + '1'}', 'g')"
    return f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))"


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in sorted(LICENSES.items()))
    digests = ", ".join(f"('{k}', '{d}')" for k, ds in sorted(DIGESTS.items()) for d in ds)
    return f"""
WITH known AS (
  SELECT canonical_sha256, min(k) AS license_id FROM (
    SELECT k, sha256({_sql_canonical('t')}) AS canonical_sha256 FROM (VALUES {rows}) v(k, t)
    UNION ALL SELECT k, d FROM (VALUES {digests}) w(k, d)
  ) GROUP BY 1
), hashed AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS canonical_sha256 FROM documents)
SELECT doc_id, h.canonical_sha256, license_id FROM hashed h LEFT JOIN known k ON h.canonical_sha256 = k.canonical_sha256
"""


ORACLE_SQL = _sql()
