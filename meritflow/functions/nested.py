"""Array, map, JSON and prompt-text expressions: NST1-3, MAP1-2, ARR1-3, STR2-4, STR9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import pad_level


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chunk_text(chunk) -> Column:
    """A streamed chunk split on LF, empty pieces dropped, the rest concatenated (ARR1)."""
    return F.array_join(F.filter(F.split(_c(chunk), "\n", -1), lambda t: t != ""), "")


# fixed value: whitespace that separates tokens in the token stand-in (ASCII, as RE2 and Java agree)
TOKEN_PATTERN = r"[\t\n\x0b\x0c\r ]*[^\t\n\x0b\x0c\r ]+"


def tokens(text) -> Column:
    """Text as a token list: each token is a run of non-blanks with its leading blanks."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)


def token_batches(toks, n: int = 3) -> Column:
    """Group a token array in runs of ``n`` (remainder last), each run concatenated (ARR2).

    Returns array<struct<idx int, batch string, is_last boolean>>; the last batch of
    every request carries ``is_last`` even when the count divides by n.
    """
    toks = _c(toks)
    nb = F.ceil(F.size(toks) / F.lit(float(n))).cast("int")
    idx = F.when(nb > 0, F.sequence(F.lit(0), nb - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.struct(
        i.alias("idx"),
        F.array_join(F.slice(toks, i * n + 1, n), "").alias("batch"),
        (i == nb - 1).alias("is_last")))


def mean_array(arr) -> Column:
    """Mean of a numeric array, NULL when empty (ARR3)."""
    arr = _c(arr)
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))


def headers_with_prefix(headers, prefix: str) -> Column:
    """Headers starting with ``prefix``, re-keyed by the last '_' segment; later keys win (MAP2)."""
    sub = F.map_filter(_c(headers), lambda k, v: k.startswith(prefix))
    return F.transform_keys(sub, lambda k, v: F.element_at(F.split(k, "_"), -1))


def header_scalar(headers, key: str, typ: str, default) -> Column:
    """A header cast to ``typ``, with a default when absent (MAP2)."""
    return F.coalesce(F.try_element_at(_c(headers), F.lit(key)).cast(typ), F.lit(default).cast(typ))


def override(base, extra) -> Column:
    """dict-update semantics: keys of ``extra`` replace those of ``base`` (MAP1, SET4).

    Needs spark.sql.mapKeyDedupPolicy=LAST_WIN (set by meritflow.session).
    """
    return F.map_concat(_c(base), _c(extra))


# The wording of the detailed problem text, which its readers parse.
PROBLEM_PARTS = {
    "statement": "\nProblem Statement: ",
    "checklist": "\nChecklist of items to consider: ",
    "file": "# File %d used to solve the problem: %s",
}


def detailed_problem(statement, checklist, context_files, parts: dict[str, str] = PROBLEM_PARTS) -> Column:
    """Problem statement, checklist and numbered context files as one text (STR2)."""
    files = F.transform(_c(context_files), lambda f, i: F.format_string(parts["file"], i, f))
    items = F.concat(F.lit("["), F.array_join(F.transform(_c(checklist), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    return F.concat(F.lit(parts["statement"]), _c(statement), F.lit(parts["checklist"]), items,
                    F.lit("\n"), F.array_join(files, ""), F.lit("\n"))


def render_files(files, header: str = "Filename: ", fence: str = "```") -> Column:
    """One block per file: name line, fenced contents (STR3); template parts are parameters."""
    return F.array_join(F.transform(_c(files), lambda f: F.concat(
        F.lit(header), f["path"], F.lit("\n" + fence + "python3\n"), f["contents"], F.lit("\n" + fence + "\n"))), "")


def log_description(ts, level, filename, lineno, message, tz: str = "America/New_York") -> Column:
    """'YYYY-MM-DD HH:MM:SS - file:line [LEVEL] message' in Eastern time (STR9).

    ``ts`` is a UTC wall-clock (TIMESTAMP_NTZ); the level is padded to 5, never cut.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts).cast("timestamp_ntz"))
    return F.format_string("%s - %s:%d [%s] %s", F.date_format(local, "yyyy-MM-dd HH:mm:ss"),
                           _c(filename), _c(lineno), pad_level(level), _c(message))


def fill_template(template: str, **fields) -> Column:
    """A prompt from a template with ``{name}`` slots filled by columns (STR4, UDF4).

    The template is a parameter (its wording is the caller's); literal text between the
    slots is kept as is.
    """
    import re
    parts = re.split(r"(\{[a-z_]+\})", template)
    cols = []
    for p in parts:
        if p.startswith("{") and p.endswith("}") and p[1:-1] in fields:
            v = fields[p[1:-1]]
            cols.append(F.coalesce(_c(v).cast("string"), F.lit("")))
        elif p:
            cols.append(F.lit(p))
    return F.concat(*cols) if cols else F.lit("")


def payload_pages(rows: DataFrame, group: str, row: str, key: Column, most: int) -> DataFrame:
    """(group, page, payload): the ``row`` structs of a group as JSON lists of about ``most`` characters (NST3).

    A group has as many pages as its rows need, and a row goes to the page that its ``key``
    hashes to, so any group splits without being sorted or gathered whole.  Rows of a page are
    in the order of their fields; pages without rows are not there.  The rows are read twice.
    """
    pages = rows.groupBy(F.col(group).alias("_g")).agg((1 + F.floor(F.sum(F.length(F.to_json(row)) + 1) / most)).alias("_pages"))
    at = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    paged = rows.join(pages, rows[group].eqNullSafe(pages["_g"])).withColumn("page", F.pmod(F.coalesce(at, F.lit(0)), F.col("_pages")))
    return paged.groupBy(group, "page").agg(F.to_json(F.sort_array(F.collect_list(F.col(row)))).alias("payload"))
