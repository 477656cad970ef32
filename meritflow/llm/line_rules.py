"""Quality rules: cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, blanks collapsed, digit runs as 0) and hashed.  For every
host the distinct texts that hold a line are counted; a line above the host's limit is
boilerplate and is removed from the host's documents.  A document that loses too large a
share of its words, or that fails the base rules, is rejected.

The hosts are the documents' sources.  Copies of one text count once, so a popular text does
not turn its own lines into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritflow.llm.common import SPACE, fresh, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def normal_lines(text: Column) -> Column:
    """Array of (h, w): hash and number of words of every line that has a word."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), r"\d+", "0")
    lines = F.filter(F.transform(F.split(flat, "\n"), F.btrim), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w")))


def base_rules(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text_``."""
    t = F.col("text_")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    one = docs.select(*keep, "text_", _words(t).alias("words_"), lines.alias("lines_"))
    triple = F.transform("words_", lambda x, i: F.xxhash64(x, F.get("words_", i + 1), F.get("words_", i + 2)))
    names = [c for c in one.columns if c not in ("words_", "lines_", "text_")]
    two = one.select(
        *names, F.size("words_").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words_") > 2, F.slice(triple, F.lit(1), F.size("words_") - 2)).alias("threes_"))
    # only a text that repeats a window pays for sorting its windows
    again = F.size(F.array_distinct("threes_")) < F.size("threes_")
    three = two.withColumn("sorted_", F.when(again, F.sort_array(F.transform(
        "threes_", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("threes_")
    same = lambda x, k: F.coalesce(F.get("sorted_", k)["h"] == x["h"], F.lit(False))
    hit = F.filter("sorted_", lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(F.lit(False)) | same(x, k + 1))
    four = three.withColumn("at_", F.sort_array(F.transform(hit, lambda x: x["i"]))).drop("sorted_")
    # a window covers three words, or fewer where the next repeated window begins sooner
    cover = F.transform("at_", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at_", k + 1) - p, F.lit(3))))
    total = F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x)
    return four.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("at_")


def judge(docs: DataFrame, min_docs: int = 20, max_share: float = 0.02, min_left: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, removed_words and source: a row per row.

    A line is boilerplate in a host when more than ``min_docs`` distinct texts and more than
    ``max_share`` of the host's distinct texts hold it; a document is depleted when fewer
    than ``min_left`` of its words are left.  A null text has no words and fails the base
    rules; a null source is a host of its own.  Repeated rows get the same verdict; other
    columns of ``docs`` are not read, and an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    host = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    ready = docs.select("doc_id", "source", text.alias("text_"))
    keep = [F.col("doc_id"), F.col("source"), host.alias("host_"), F.md5("text_").alias("key_"),
            normal_lines(F.col("text_")).alias("normal_")]
    stats = written(base_rules(ready, keep), "lines")
    held = stats.select("host_", "key_", F.explode(F.array_distinct(F.transform("normal_", lambda x: x["h"]))).alias("h_"))
    hosts = stats.groupBy("host_").agg(F.countDistinct("key_").alias("texts_"))
    limit = F.greatest(F.lit(float(min_docs)), F.col("texts_") * max_share)
    common = (held.groupBy("host_", "h_").agg(F.countDistinct("key_").alias("n_")).where(F.col("n_") > min_docs)
              .join(hosts, "host_").where(F.col("n_") > limit).select("host_", "h_"))
    gone = (held.join(common, ["host_", "h_"]).groupBy("host_", "key_").agg(F.collect_set("h_").alias("gone_")))
    lost = F.aggregate(F.filter("normal_", lambda x: F.array_contains("gone_", x["h"])), F.lit(0).cast("long"),
                       lambda a, x: a + x["w"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = (stats.join(gone, ["host_", "key_"], "left").withColumn("removed_words", F.coalesce(lost, F.lit(0).cast("long")))
           .withColumn("base_failed", failed)
           .withColumn("kept", ~failed & (F.col("n_words") - F.col("removed_words") >= min_left * F.col("n_words"))))
    return out.select("doc_id", *BASE, "removed_words", "source")


def strip_lines(docs: DataFrame, min_docs: int = 20, max_share: float = 0.02) -> DataFrame:
    """``docs`` with the hosts' boilerplate lines cut out of the texts; other rows unchanged.

    Null and empty texts stay as they are.
    """
    n = fresh(docs, "host", "key", "pairs", "h", "gone", "n", "texts")
    c = {k: F.col(v) for k, v in n.items()}
    text = F.col("text")
    host = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), r"\d+", "0")
    pairs = F.arrays_zip(F.split(text, "\n").alias("line"), F.transform(
        F.split(flat, "\n"), lambda x: F.xxhash64(F.btrim(x))).alias("h"))
    held = docs.select(host.alias(n["host"]), F.md5("text").alias(n["key"]), F.explode(F.array_distinct(F.transform(
        normal_lines(text), lambda x: x["h"]))).alias(n["h"]))
    hosts = docs.groupBy(host.alias(n["host"])).agg(F.countDistinct(F.md5("text")).alias(n["texts"]))
    common = (held.groupBy(n["host"], n["h"]).agg(F.countDistinct(n["key"]).alias(n["n"])).join(hosts, n["host"])
              .where(c["n"] > F.greatest(F.lit(float(min_docs)), c["texts"] * max_share)).select(n["host"], n["h"]))
    gone = held.join(common, [n["host"], n["h"]]).groupBy(n["host"], n["key"]).agg(F.collect_set(n["h"]).alias(n["gone"]))
    keyed = (docs.withColumns({n["host"]: host, n["key"]: F.md5("text"), n["pairs"]: pairs})
             .join(gone, [n["host"], n["key"]], "left"))
    kept = F.filter(n["pairs"], lambda x: ~F.array_contains(c["gone"], x["h"]))
    left = F.when(c["gone"].isNull(), text).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return keyed.select(*[left.alias(x) if x == "text" else F.col(f"`{x}`") for x in docs.columns])
