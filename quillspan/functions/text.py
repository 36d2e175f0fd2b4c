"""Column functions over source texts: normal form, positions, context, tokens, nearest names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the extensions of source files, as a pattern.
SOURCE_FILE = r"(?i)\.[cm]?[jt]sx?$"


#: Strings, templates and comments; possessive, so that long ones need no stack.
QUOTED = r"""(["'])(?:[^"'\\\n]++|\\.|(?!\1)["'])*+\1|(`)(?:[^`\\]++|\\[\s\S])*+`|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"""
#: The same with what a string holds as its first group, comments outside it.
STRING_OR_COMMENT = r"""("(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\[\s\S])*+`)|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"""
#: A part of a list up to a comma outside brackets and quotes, with brackets in brackets up to two deep.
ITEM = r"""(?:[^,()\[\]{}"'`]|"[^"]*"|'[^']*'|`[^`]*`|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|\[(?:[^\[\]]|\[[^\[\]]*\])*\]|\{(?:[^{}]|\{[^{}]*\})*\})+"""


def code_only(source: Column) -> Column:
    """A source with its strings emptied and its comments gone."""
    return F.regexp_replace(source, QUOTED, "$1$1$2$2")


def uncommented(source: Column) -> Column:
    """A source without its comments, strings as they are."""
    return F.regexp_replace(source, STRING_OR_COMMENT, "$1")


def blanked(source: Column, pattern: str) -> Column:
    """A source without what matches, line by line as before: of what goes, the line feeds stay."""
    parts, gone = F.split(source, pattern, -1), F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    left = F.array_join(F.zip_with(parts, gone, lambda p, g: F.concat(p, F.coalesce(F.regexp_replace(g, "[^\n]", ""), F.lit("")))), "")
    return F.when(source.rlike(pattern), left).otherwise(source)  # most sources of some kinds have nothing that goes


def code_lines(source: Column) -> Column:
    """A source without its strings and comments, line by line."""
    return blanked(source, QUOTED)


def split_top(items: Column) -> Column:
    """The parts of a list between commas that stand outside brackets and quotes, trimmed; none of a blank text."""
    return F.filter(F.transform(F.regexp_extract_all(items, F.lit(ITEM), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def normalize_source(source: Column) -> Column:
    """Line ends as one line feed."""
    return F.regexp_replace(source, "\r\n?", "\n")


def is_source_file(path: Column) -> Column:
    return path.rlike(SOURCE_FILE)


def line_at(source: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset in code points."""
    return F.size(F.split(F.substring(source, F.lit(1), offset.cast("int")), "\n"))


def column_at(source: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    head = F.split(F.substring(source, F.lit(1), offset.cast("int")), "\n")
    return F.length(F.element_at(head, -1)) + 1


def nearby_source(source: Column, start_line: Column, end_line: Column, before: int = 1, after: int = 3) -> Column:
    """The lines of a span with `before` lines above and `after` below it."""
    lines = F.split(source, "\n")
    first = F.greatest(start_line - before, F.lit(1)).cast("int")
    last = F.least(end_line + after, F.size(lines)).cast("int")
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def name_tokens(name: Column) -> Column:
    """Distinct lower-case parts of an identifier: at capitals, digits and punctuation."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: F.length(t) > 0))


def closest_key(name: Column, known: list[str], most: int | None = None) -> Column:
    """The known key at the least edit distance, the first in order among equals; null beyond `most` edits."""
    best = F.array_min(F.transform(F.array(*[F.lit(k) for k in sorted(known)]), lambda k: F.struct(F.levenshtein(name, k).alias("distance"), k.alias("key"))))
    return best["key"] if most is None else F.when(best["distance"] <= most, best["key"])


def fingerprint(source: Column) -> Column:
    """A fast hash of a content, for equality within a job."""
    return F.xxhash64(source)


def in_paths(path: Column, scopes: list[str]) -> Column:
    """Whether a path is one of the scopes or lies below one; no scope means all."""
    out = F.lit(not scopes)
    for scope in scopes:
        base = scope.rstrip("/")
        out = out | (path == base) | path.startswith(base + "/")
    return out


def top_directory(path: Column) -> Column:
    """The first directory of a path, empty for a file at the root."""
    return F.when(path.contains("/"), F.element_at(F.split(path, "/"), 1)).otherwise(F.lit(""))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def layer_of(path: Column, roles: list[str]) -> Column:
    """The first directory of a path that names one of the roles."""
    parts = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.get(F.filter(parts, lambda p: p.isin(*roles)), F.lit(0))


def escape_annotation(text: Column, is_property: bool = False) -> Column:
    """Escapes of a workflow annotation: percent and line ends, in properties also colon and comma."""
    pairs = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")] + ([(":", "%3A"), (",", "%2C")] if is_property else [])
    for raw, code in pairs:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text
