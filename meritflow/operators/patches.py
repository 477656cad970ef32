"""TBL1 + JOIN11: unified diffs as hunk rows, and whether a patch applies.

"Does the patch apply" is answered as joins, not by running a patch tool: every hunk's
old-side lines (context and removals) must appear consecutively in the target file at
one offset.  The whole old side is one key: its digest meets the digests of the file's
windows of that many lines, and the nearest of the windows with that digest is found in
their order, so neither a common line nor a repeated passage forms pairs.
Differences from a patch tool, by design: no renames, binary or mode changes; hunks
are checked independently (no ordering constraint between hunks of one file); the
nearest offset to the claimed position wins (ties: the earlier line).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from ..session import written

_HEAD = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_NAME = re.compile(r"^(?:---|\+\+\+) (?:[ab]/)?([^\t]*)")
_HUNKS = ArrayType(StructType().add("path", StringType()).add("creates", BooleanType()).add("old_start", LongType())
                   .add("lines", ArrayType(StringType())))


def _read(patch: str) -> list[dict]:
    """The hunks of one patch that have lines, with their file.

    The lengths in a hunk's header say where it ends, so a removed line that looks like a file
    header is still a removed line, and the next file's header is none.
    """
    out: list[dict] = []
    old = new = None
    here, left_old, left_new = None, 0, 0
    for line in patch.split("\n"):
        head = _HEAD.match(line)
        if head:
            a, m, _, n = head.groups()
            path = old if new == "/dev/null" else new
            here = {"path": path, "creates": old == "/dev/null", "old_start": min(int(a), 1 << 62), "lines": []}
            left_old, left_new = (1 if x is None else int(x) for x in (m, n))
        elif here is not None and (left_old > 0 or left_new > 0) and line[:1] in ("", " ", "-", "+"):
            kind = line[:1] or " "
            if not here["lines"]:
                out.append(here)
            here["lines"].append(kind + line[1:])
            left_old -= kind != "+"
            left_new -= kind != "-"
        elif line.startswith("--- "):
            old, here = _NAME.match(line)[1], None
        elif line.startswith("+++ "):
            new, here = _NAME.match(line)[1], None
    return out


@F.arrow_udf(_HUNKS)
def _hunks(patch: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("path", pa.string()), ("creates", pa.bool_()), ("old_start", pa.int64()),
                               ("lines", pa.list_(pa.string()))]))
    return pa.array([_read(p.as_py() or "") for p in patch], kind)


def hunks(patches: DataFrame, patch_id: str = "patch_id", patch: str = "patch") -> DataFrame:
    """One row per hunk (TBL1): patch_id, hunk_no from 1, path, creates, old_start, lines.

    ``lines`` keep their first character; an empty line is an empty context line.  A deletion is
    looked up under its old name; ``creates`` marks a file that must be new.  A null, empty or
    hunk-less patch has one row, without hunk_no and lines.
    """
    d = patches.select(F.col(patch_id).alias("patch_id"), F.posexplode_outer(_hunks(F.col(patch))).alias("pos", "h"))
    return d.select("patch_id", (F.col("pos") + 1).alias("hunk_no"), F.col("h.path").alias("path"), F.col("h.creates").alias("creates"),
                    F.col("h.old_start").alias("old_start"), F.col("h.lines").alias("lines"))


def hunk_lines(patches: DataFrame, patch_id: str = "patch_id", patch: str = "patch") -> DataFrame:
    """One row per line of every hunk (TBL1): patch_id, path, creates, hunk_no, old_start, kind, k, text.

    ``kind`` is ' ', '-' or '+'; ``k`` numbers the old-side lines (' ' and '-') of a hunk from
    0 (NULL for '+').
    """
    d = hunks(patches, patch_id, patch).where("hunk_no IS NOT NULL")
    numbered = d.select("patch_id", "path", "creates", "hunk_no", "old_start", "lines", F.posexplode("lines").alias("pos", "line"))
    kind = F.substring("line", 1, 1)
    before = F.size(F.filter(F.slice("lines", F.lit(1), F.col("pos")), lambda x: F.substring(x, 1, 1) != "+"))
    return numbered.select("patch_id", "path", "creates", "hunk_no", "old_start", kind.alias("kind"),
                           F.when(kind != "+", before).cast("bigint").alias("k"), F.expr("substring(line, 2)").alias("text"))


def _digest(lines: Column) -> list[Column]:
    """128 bits of an array of lines."""
    return [F.xxhash64(lines).alias("d1"), F.xxhash64(F.lit("second"), lines).alias("d2")]


def patch_applies(parsed: DataFrame, files: DataFrame, path: str = "path", contents: str = "contents") -> DataFrame:
    """(patch_id, applies, offset, n_hunks) of every patch in ``parsed``, the rows of ``hunks`` (JOIN11).

    ``offset`` is the chosen shift of the first hunk.  A hunk without old-side lines applies
    anywhere in an existing file; a file that a patch creates must not exist, any other must.
    A patch without a hunk does not apply.
    """
    side = F.transform(F.filter("lines", lambda x: ~x.startswith("+")), lambda x: F.substring(x, F.lit(2), F.length(x)))
    d = parsed.withColumn("old", side).withColumn("m", F.size(F.coalesce("old", F.array().cast("array<string>"))))
    # read by three branches: written once, with digests in place of lines
    d = written(d.select("patch_id", "hunk_no", "path", "creates", F.coalesce("old_start", F.lit(0)).alias("old_start"), "m",
                         *_digest(F.col("old"))), "hunks")
    wanted = d.where("hunk_no IS NOT NULL AND path IS NOT NULL").groupBy("path").agg(F.collect_set("m").alias("sizes"))
    rows = files.select(F.col(path).cast("string").alias("path"), F.split(F.col(contents), "\n", -1).alias("ls"))
    there = rows.where("ls IS NOT NULL").join(wanted, "path").select(
        "path", "ls", F.explode(F.filter("sizes", lambda m: m <= F.size("ls"))).alias("m"))
    at = F.explode(F.sequence(F.lit(1), F.when(F.col("m") > 0, F.size("ls") - F.col("m") + 1).otherwise(1))).alias("line_no")
    windows = there.select("path", "m", "ls", at).select("path", "m", "line_no", *_digest(F.slice("ls", F.col("line_no"), F.col("m"))))
    # the nearest window before and after a hunk's place, among those of its digest
    key = ["path", "m", "d1", "d2"]
    spots = windows.where("m > 0").select(*key, F.col("line_no").cast("bigint").alias("at"), F.lit(0).alias("side"),
                                          F.lit(None).cast(d.schema["patch_id"].dataType).alias("patch_id"), F.lit(None).cast("int").alias("hunk_no"))
    asks = d.where("m > 0 AND path IS NOT NULL").select(*key, F.col("old_start").alias("at"), F.lit(1).alias("side"), "patch_id", "hunk_no")
    both = spots.unionByName(asks)
    line = F.when(F.col("side") == 0, F.col("at"))
    up = Window.partitionBy(*key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*key).orderBy("at", "side").rowsBetween(1, Window.unboundedFollowing)
    near = both.withColumns({"a": F.last(line, ignorenulls=True).over(up), "b": F.first(line, ignorenulls=True).over(down)}).where("side = 1")
    above, below = F.col("a") - F.col("at"), F.col("b") - F.col("at")
    delta = F.when(below.isNull() | (-above <= below), above).otherwise(below)
    best = near.select(F.col("patch_id").alias("p_"), F.col("hunk_no").alias("h_"), delta.alias("delta"))
    exists = rows.where("ls IS NOT NULL").join(wanted, "path", "left_semi").select("path").distinct().withColumn("exists", F.lit(True))
    known = F.coalesce(F.col("exists"), F.lit(False))
    ok = (F.when(F.col("hunk_no").isNull(), F.lit(False)).when(F.col("creates"), ~known)
           .otherwise(known & ((F.col("m") == 0) | F.col("delta").isNotNull())))
    out = d.join(exists, "path", "left").join(best, d["patch_id"].eqNullSafe(F.col("p_")) & (d["hunk_no"] == F.col("h_")), "left")
    return (out.withColumn("ok", ok).groupBy("patch_id")
               .agg(F.bool_and("ok").alias("applies"), F.min_by("delta", "hunk_no").alias("offset"), F.count("hunk_no").alias("n_hunks")))
