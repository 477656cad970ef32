"""STR1-STR11: text column expressions.

Python's ``str.splitlines``, ``\\s`` and ``rstrip`` use Unicode rules that Java's
regex engine does not share by default, so the exact character sets are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character sets of Python's str semantics -------------------------
# Line boundaries of str.splitlines: CR LF as one break, else any one of
#   LF VT FF CR FS GS RS NEL LS PS  (U+000A U+000B U+000C U+000D U+001C U+001D U+001E
#   U+0085 U+2028 U+2029)
# Whitespace of str.isspace / re "\s" / str.rstrip:
#   U+0009-U+000D U+001C-U+0020 U+0085 U+00A0 U+1680 U+2000-U+200A U+2028 U+2029
#   U+202F U+205F U+3000
LINE_BREAK_JAVA = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
LINE_BREAK_RE2 = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
PY_SPACE_JAVA = (r"[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a"
                 r"\u2028\u2029\u202f\u205f\u3000]")
PY_SPACE_RE2 = (r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# the same whitespace set as a string of characters, for trim functions
PY_SPACE_CHARS = "".join(chr(c) for c in (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# ------------------------------------------------------------------------------------


def split_lines(s) -> Column:
    """``str.splitlines()``: no element for a final line break, none for ''.

    Splitting leaves an empty last element exactly when the text ends with a break (or
    is empty); dropping it gives Python's result without any end-of-text scan.
    """
    s = F.col(s) if isinstance(s, str) else s
    parts = F.split(s, LINE_BREAK_JAVA, -1)
    n = F.size(parts) - F.when(F.element_at(parts, -1) == "", F.lit(1)).otherwise(F.lit(0))
    return F.slice(parts, F.lit(1), n)


def strip_patch_comments(patch) -> Column:
    """Remove comments from added ('+') lines of a unified diff (STR1).

    Whole-line comments (``+`` then optional whitespace then ``#``) are dropped, other
    added lines lose everything from the first ``#`` plus trailing whitespace, all other
    lines stay.  Lines are re-joined with LF; a final line break is not restored.
    Per line only prefix tests, a cut at the first '#' and trims run (no regex).
    """
    ws = F.lit(PY_SPACE_CHARS)
    lines = split_lines(patch)
    whole_comment = lambda l: l.startswith("+") & F.ltrim(l.substr(F.lit(2), F.length(l)), ws).startswith("#")
    kept = F.filter(lines, lambda l: ~whole_comment(l))
    cleaned = F.transform(kept, lambda l: F.when(l.startswith("+"), F.rtrim(F.substring_index(l, "#", 1), ws))
                                          .otherwise(l))
    return F.array_join(cleaned, "\n")


def preview(s, n: int = 100) -> Column:
    """First ``n`` characters plus '...'; NULL stays NULL (STR6)."""
    s = F.col(s) if isinstance(s, str) else s
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(F.concat(F.substring(s, 1, n), F.lit("...")))


def task_id(repo, statement) -> Column:
    """repo + '-' + first 10 characters, plus a content hash so ids are unique (STR7)."""
    repo = F.col(repo) if isinstance(repo, str) else repo
    statement = F.col(statement) if isinstance(statement, str) else statement
    return F.concat(repo, F.lit("-"), F.substring(statement, 1, 10), F.lit("-"),
                    F.substring(F.md5(F.concat_ws("\u0001", repo, statement)), 1, 12))


def split_repo(repo) -> Column:
    """'author/name' -> struct(author, name) (STR5)."""
    repo = F.col(repo) if isinstance(repo, str) else repo
    return F.struct(F.split_part(repo, F.lit("/"), F.lit(1)).alias("author"),
                    F.split_part(repo, F.lit("/"), F.lit(2)).alias("name"))


# Fixed value: the format of run labels.
RUN_FORMAT = "%s__%s__%s__t-%.2f__p-%.2f__c-%.2f__install-%d"


def run_name(model, data, config, temperature, top_p, cost_limit, install_env, suffix=None) -> Column:
    """Run label: parts joined by '__', floats with two decimals, ':' replaced (STR8)."""
    base = F.format_string(RUN_FORMAT, model, data, config, temperature, top_p, cost_limit, install_env)
    if suffix is not None:
        suffix = F.col(suffix) if isinstance(suffix, str) else suffix
        base = F.when((suffix.isNull()) | (suffix == ""), base).otherwise(F.concat(base, F.lit("__"), suffix))
    return F.replace(base, F.lit(":"), F.lit("-"))


def release_code(version) -> Column:
    """'major.minor.patch' -> 1000*major + 10*minor + patch (STR11)."""
    version = F.col(version) if isinstance(version, str) else version
    p = F.split(version, r"\.")
    return (F.element_at(p, 1).cast("int") * 1000 + F.element_at(p, 2).cast("int") * 10
            + F.element_at(p, 3).cast("int"))


def pad_level(level) -> Column:
    """Left-justify to 5 characters without ever cutting (STR9); rpad alone would cut."""
    level = F.col(level) if isinstance(level, str) else level
    return F.when(F.length(level) < 5, F.rpad(level, 5, " ")).otherwise(level)


def model_alias(model, aliases: dict[str, str] | None = None) -> Column:
    """Map short model names to API names, pass others through (STR10)."""
    # fixed values: alias -> API model name
    aliases = aliases or {"gpt4omini": "gpt-4o-mini", "gpt4o": "gpt-4o"}
    model = F.col(model) if isinstance(model, str) else model
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(m, model), model)
