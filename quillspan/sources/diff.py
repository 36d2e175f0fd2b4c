"""Line diffs of changed files: hunks between the lines of a longest common subsequence."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = "struct<old_at:int,old_lines:array<string>,new_at:int,new_lines:array<string>>"


def common_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places (in old, in new) of one longest common subsequence, in order.

    What both begin and end with is common. Between, each new line stands for all its places in the old file; the
    longest run that rises in both is kept by its tails, so that the work grows with the pairs of equal lines.
    """
    start, stop = 0, 0
    most = min(len(old), len(new))
    while start < most and old[start] == new[start]:
        start += 1
    while stop < most - start and old[-1 - stop] == new[-1 - stop]:
        stop += 1
    places = defaultdict(list)
    for i in range(len(old) - stop - 1, start - 1, -1):
        places[old[i]].append(i)
    tails, links = [], []  # the least last place of runs of each length, and those runs as chains
    for j in range(start, len(new) - stop):
        for i in places.get(new[j], ()):  # from the back, so that a line is not followed by itself
            k = bisect_left(tails, i)
            chain = (i, j, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(i)
                links.append(chain)
            elif i < tails[k]:
                tails[k], links[k] = i, chain
    middle, chain = [], links[-1] if links else None
    while chain:
        middle.append(chain[:2])
        chain = chain[2]
    return [(k, k) for k in range(start)] + middle[::-1] + [(len(old) - k, len(new) - k) for k in range(stop, 0, -1)]


def hunks_of(old: list[str], new: list[str]) -> list[dict]:
    """What lies between common lines: where it begins (lines from 1) and the lines on both sides."""
    out, a, b = [], 0, 0
    for i, j in [*common_lines(old, new), (len(old), len(new))]:
        if i > a or j > b:
            out.append({"old_at": a + 1, "old_lines": old[a:i], "new_at": b + 1, "new_lines": new[b:j]})
        a, b = i + 1, j + 1
    return out


def line_hunks(changes: DataFrame) -> DataFrame:
    """(file_path, hunk, old_at, old_lines, new_at, new_lines) of changes (file_path, source, old_source), numbered in order.

    A file without an old source is one hunk; one without a source (deleted) too.
    """

    def rows(batches):
        for batch in batches:
            found = []
            for new, old in zip(batch.column("source").to_pylist(), batch.column("old_source").to_pylist(), strict=True):
                found.append(hunks_of([] if old is None else old.split("\n"), [] if new is None else new.split("\n")))
            kind = pa.list_(pa.struct([("old_at", pa.int32()), ("old_lines", pa.list_(pa.string())), ("new_at", pa.int32()), ("new_lines", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), pa.array(found, kind)], names=["file_path", "hunks"])

    files = changes.select("file_path", "source", "old_source").mapInArrow(rows, f"file_path string, hunks array<{HUNK}>")
    return files.select("file_path", F.posexplode("hunks").alias("hunk", "h")).select("file_path", "hunk", "h.*")
