"""Divergence audit, phrase collocations and chat formatting: brute force, round trips, odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meritflow.llm import chat_format, collocations, divergence, queries
from meritflow.plans.check import duckdb_connection

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, term string, n string, value string, _parts int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(rnd, n, kinds):
    return " ".join(rnd.choice(kinds) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rnd = random.Random(3)
    kinds = ["alpha", "Beta", "gamma", "längs", "日本語", "x.y", "a\x1cb", "z!"]
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "...;;!!"), (5, "Alpha"), (5, "Alpha"), (6, "İ Ä ALPHA")]
    rows += [(i, words(rnd, 30, kinds)) for i in range(10, 60)] + [(60, words(rnd, 40_000, kinds)), (61, "w" * 1_300_000 + " alpha beta")]
    full = [(i, t, ("en", None, "de", "")[k % 4], ("s1", None, "s2", "", "é")[k % 5], "term", None, "v", k)
            for k, (i, t) in enumerate(rows)] + [(99, "only one", "xx", "lonely", None, None, None, 0)]
    return spark.createDataFrame(full, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# -- divergence -----------------------------------------------------------------------

def brute_audit(rows, min_docs, k):
    docs = [(t or "", la or "", s or "") for t, la, s in rows]
    n, d, out = collections.Counter(), collections.Counter(), []
    for t, la, s in docs:
        found = [x.translate(LOWER) for x in TERM.findall(t)]
        n.update((la, s, x) for x in found)
        d.update((la, x) for x in set(found))
    for la in {x[1] for x in docs}:
        kept = [x for (b, x), c in d.items() if b == la and c >= min_docs]
        sources = sorted({s for _, b, s in docs if b == la})

        def shares(count, kept=kept):
            whole = sum(map(count, kept)) + 2 * len(kept)
            return {x: 1 + 10**9 * (count(x) + 2) // whole for x in kept}
        p = {s: shares(lambda x, s=s: n[la, s, x]) for s in sources}
        q = shares(lambda x: sum(n[la, s, x] for s in sources))
        for s in sources:
            near = [(o, sum((p[s][x] - p[o][x])**2 // (p[s][x] + p[o][x]) for x in kept)) for o in sources if o != s]
            term = [(x, (p[s][x] - q[x])**2 // (p[s][x] + q[x])) for x in kept if n[la, s, x] and p[s][x] > q[x]]
            for part, got in (("pair", near), ("term", term)):
                got.sort(key=lambda y: (-y[1], y[0].encode()))
                out += [(la, s, part, x, v, i + 1) for i, (x, v) in enumerate(got) if part == "pair" or i < k]
    return sorted(out)


def test_divergence_matches_brute_force(odd, none):
    got = rows_of(divergence.audit(odd))
    assert got == brute_audit([(r.text, r.lang, r.source) for r in odd.collect()], 10, 10)
    assert {r[2] for r in got} == {"pair", "term"} and not [r for r in got if r[0] == "xx"]
    assert divergence.audit(none).count() == 0


def test_divergence_tiles_and_buckets(spark, monkeypatch):
    """Many sources and terms: several tiles of sources, several buckets, partial flushes, passes over long texts."""
    for name, value in (("_SOURCES", 4), ("_TERMS", 8), ("_HELD", 20), ("_SET_BYTES", 64)):
        monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(5)
    kinds = ["".join(rnd.choice("abcdefé") for _ in range(3)) for _ in range(60)]
    rows = [(words(rnd, rnd.randint(0, 60), kinds), rnd.choice(["en", "de"]), f"s{rnd.randint(0, 10)}") for _ in range(150)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    # the counting runs in this process, where the limits are patched
    got = pd.DataFrame([x for b in divergence._count(iter(_arrow(df))) for x in b.to_pylist()])
    n = collections.Counter((la, s, x) for t, la, s in rows for x in TERM.findall(t))
    d = collections.Counter((la, s, x) for t, la, s in rows for x in set(TERM.findall(t)))
    summed = got[got.term != ""].groupby(["lang", "source", "term"]).sum()
    assert {k: (v.n, v.d) for k, v in zip(summed.index, summed.itertuples(), strict=True)} == {k: (n[k], d[k]) for k in n}
    assert rows_of(divergence.audit(df, 5, 4)) == brute_audit(rows, 5, 4)


def _arrow(df):
    return df.toArrow().to_batches()


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband_keeps_what_fewer_than_k_dominate(k, monkeypatch):
    rnd = np.random.default_rng(k)
    monkeypatch.setattr(divergence, "_BLOCK", 16)
    rows = pd.DataFrame({"lang": "en", "source": "s", "n": rnd.integers(1, 12, 250), "total": rnd.integers(1, 12, 250),
                         "term": [f"é{i:03}" for i in rnd.permutation(250)]})
    parts = pa.Table.from_pandas(rows).to_batches(max_chunksize=50)
    thinned = list(divergence._skybands(k, 100)(iter(parts)))                    # passed on in pieces, then merged
    kept = set(pa.Table.from_batches(divergence._skybands(k)(iter(thinned))).column("term").to_pylist())
    every = list(rows.itertuples())
    want = {x.term for x in every if sum(y.n >= x.n and y.total <= x.total and y.term < x.term for y in every) < k}
    assert kept == want


def test_shares_are_exact_for_huge_counts(spark):
    got = spark.range(1).select(divergence.share(F.lit(4 * 10**13), F.lit(9 * 10**13), F.lit(10**6)).alias("p")).first().p
    assert got == 1 + 10**9 * (4 * 10**13 + 2) // (9 * 10**13 + 2 * 10**6)


# -- collocations ---------------------------------------------------------------------

def brute_phrases(rows, top, min_count=10):
    f, n = collections.Counter(), collections.Counter()
    for t, la in rows:
        la = "und" if la is None else la
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[la] += len(w)
            f.update((la, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for la in n:
        cand = {p: a for (b, p), a in f.items() if b == la and len(p) > 1 and a >= min_count}
        best = []
        for p, a in cand.items():
            if any(100 * c >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, c in cand.items() if len(q) > len(p)):
                continue
            s, k = min((10**6 * a * a // (f[la, p[:k]] * f[la, p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), f[la, p[:k]], f[la, p[k:]]))
        for i, (s, a, p, le, r) in enumerate(sorted(best)[:top]):
            out.append((la, i + 1, p.decode(), -a, le, r, n[la], -s))
    return sorted(out)


@pytest.mark.parametrize("top", [2_000, 7])
def test_collocations_match_brute_force(odd, none, top):
    got = rows_of(collocations.collocations(odd, top=top))
    assert got == brute_phrases([(r.text, r.lang) for r in odd.collect()], top) and got
    assert collocations.collocations(none).count() == 0


@pytest.mark.parametrize("length", [2, 3, 4])
@pytest.mark.parametrize("held", [1, 50, 3_000_000])
def test_longest_windows_over_flushes(spark, monkeypatch, length, held):
    """Windows reach over the chunks and flushes of a text, never over pieces or texts."""
    monkeypatch.setattr(collocations, "_HELD", held)
    monkeypatch.setattr(collocations, "byte_chunks", lambda row, table: divergence.byte_chunks(row, table, 16))
    texts = ["a b c d e f g h i j k l m n", "a b, c d. e f g", "", "x", ".. y ..", "A\tB  c\nd e"]
    df = spark.createDataFrame([(t, "en") for t in texts] + [("q r s", "de")], "text string, lang string").coalesce(1)
    got = collections.Counter()
    for b in collocations._window_rows(length, 5)(iter(_arrow(df))):
        for r in b.to_pylist():
            for line in r["lines"].split("\n"):
                window, n = line.split("\t")
                assert r["size"] == len(window.split(" "))
                got[(r["lang"], *window.split(" "), *[""] * (length - r["size"]))] += int(n)
    want = collections.Counter()
    for t, la in [(t, "en") for t in texts] + [("q r s", "de")]:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.lower()):
            w = piece.split()
            want.update((la, *(w[i:i + length] + [""] * (length - len(w[i:i + length])))) for i in range(len(w)))
    assert got == want


def test_scores_are_exact_beyond_64_bits(spark):
    a, le, r = 3 * 10**13 + 7, 4 * 10**13 + 1, 5 * 10**13 + 3
    got = spark.range(1).select(collocations.score(F.lit(a), F.lit(le), F.lit(r)).alias("s")).first().s
    assert got == 10**6 * a * a // (le * r)


# -- chat formatting ------------------------------------------------------------------

TRICKY = ["", "\\", "\\\\<|end|>", "<\\|", "<", "a<", "|end|>", "</s>[INST] ok [/INST]", "<|turn|>user<|body|>x<|end|>", "[\\INST]",
          "<<SYS>>\n\\n<</SYS>>", "<|image|>", "\U0001F600 é\n\n", "$1 \\1", None]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY if t is not None], "t string")
    for r in df.select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat_format.CONTROLS)


@pytest.fixture(scope="module")
def chats(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "a<|b\n"]), rnd.choice(TRICKY), "x") for c in range(40) for t in range(rnd.randint(1, 6))]
    rows += [(None, None, None, None, None), (None, 1, "assistant", "null conversation", None), (100, 1, "user", "same", ""), (100, 1, "user", "same", "")]
    rows += [(101, t, "assistant", f"turn {t} <|end|> " * 50, "") for t in range(300)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string").repartition(4).cache()


def test_chat_digests_match_brute_force(chats):
    said = collections.defaultdict(list)
    for r in chats.collect():
        said[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chat(chats)).collect()}
    assert got.keys() == said.keys()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv, turns in said.items():
        turns.sort()
        learnt = "".join(t for *_, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(learnt), sha(learnt))
        assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for *_, role, t in turns))


def test_loss_mask_is_in_code_points(chats):
    for r in chat_format.format_chat(chats).collect():
        turns = r.formatted.split("<|turn|>")[1:]
        want = [t.split("<|body|>")[1].removesuffix("<|end|>") for t in turns if t.startswith("assistant<|body|>")]
        assert [r.formatted[m.start:m.start + m.length] for m in r.loss] == want
        assert r.n_turns == len(turns) and not r.attachments and r.expanded_tokens == 0


def test_typed_parts_become_placeholders(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat_format.PART}>"
    text = lambda t: ("text", t, None, None, None, None, None)
    rows = [(1, 1, "assistant", [text("a cat <|image|>")]),
            (1, 0, "user", [text("see "), ("image", None, "s3://a.png", 57, 28, None, None), None, text(None),
                            ("audio", None, "b.wav", None, None, 1.5, None)]),
            (1, 2, "user", [("document", None, "c.pdf", None, None, None, 3), ("image", None, None, None, None, None, None)]),
            (2, 0, "user", None), (3, 0, "user", [])]
    got = {r.conv_id: r for r in chat_format.format_parts(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].formatted == ("<|turn|>user<|body|>see <|image|><|audio|><|end|><|turn|>assistant<|body|>a cat <\\|image|><|end|>"
                                "<|turn|>user<|body|><|document|><|image|><|end|>")
    assert [(a.turn, a.type, a.uri, a.tokens) for a in got[1].attachments] == [
        (0, "image", "s3://a.png", 3), (0, "audio", "b.wav", 38), (2, "document", "c.pdf", 3_072), (2, "image", None, 1)]
    assert got[1].expanded_tokens == 3 + 38 + 3_072 + 1
    assert len(re.findall(r"<\|(?:image|audio|document)\|>", got[1].formatted)) == len(got[1].attachments)
    assert got[2].formatted == got[3].formatted == "<|turn|>user<|body|><|end|>"


def test_unknown_part_raises(spark):
    df = spark.createDataFrame([(1, 0, "user", [("video", None, None, None, None, None, None)])],
                               f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    with pytest.raises(Exception, match="no visitor"):
        chat_format.format_parts(df).collect()


def test_chat_empty_table_and_no_python(spark, chats):
    assert chat_format.format_chat(chats.limit(0)).count() == 0
    plan = queries.QUERIES["op12_chat_format"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op11_divergence", "op12_chat_format", "op13_collocations"])
def test_queries_match_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = duckdb_connection(SMALL).execute(queries.ORACLE_SQL[name]).fetchall()
    columns = [c[0] for c in duckdb_connection(SMALL).execute(queries.ORACLE_SQL[name] + " LIMIT 0").description]
    assert rows_of(got.select(*columns)) == sorted(want)
