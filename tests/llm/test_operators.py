"""The training-data operators against brute force, and on odd input."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meritflow.llm import (exact_dedup, html_text, language, line_rules, minhash, mixing, packing, queries, sharding,
                           substring_dedup, toxicity)
from meritflow.llm.common import words as count_words

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, lang string, source string, size string, kept string, score string, _row_key int, shard int"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rnd = random.Random(1)
    a, b = prose(rnd, 80), prose(rnd, 90)
    long = prose(rnd, 60_000)
    rows = [(1, a), (2, a), (3, a.replace(" ", "\n")), (3, a), (3, a), (None, a), (None, None), (4, None), (5, ""), (6, " \t\n"),
            (7, b), (7, b), (7, prose(rnd, 40)), (8, long), (9, long + " x"), (10, "one"), (11, "One two"), (None, "one"),
            (12, "no\x85 break here" * 30), (13, "日本語 テキスト"), (14, "1234 5678 !!"), (15, "x" * 200_000)]
    full = [(i, t, ("en", None, "de")[k % 3], ("s1", None, "s2", "")[k % 4], "size", None, "0.5", k, k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


def test_word_counts(odd):
    for r in odd.select("text", count_words(F.col("text")).alias("n")).collect():
        assert r.n == len(WORD.findall(r.text or ""))


# -- mixing ---------------------------------------------------------------------------

def fixed_point(sizes):
    """Targets by resharing the excess over and over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mixing_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 50, None: 7}, {"x": 5}, {"a": 0, "b": 9}, {"a": 1, "b": 1, "c": 100, "d": 100, "e": 3}):
        per = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
        got = {r.source: r.target for r in mixing.targets(per).collect()}
        assert got == pytest.approx(fixed_point(sizes))


def test_mixing_takes_the_targets_and_reruns_agree(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("w" * rnd.randint(0, 60)), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, rows_per_bucket=300).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 60
        assert all(0 <= r.copies <= 3 for r in mine) and len({r.target for r in mine}) == 1
    conf = {"spark.sql.shuffle.partitions": "3", "spark.sql.execution.arrow.maxRecordsPerBatch": "57"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        again = mixing.mix(docs.repartition(7), rows_per_bucket=300).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again}


def test_pivotal_rounding_keeps_expectations():
    n, runs = 7, 4000
    size, p0 = np.arange(1, n + 1), np.linspace(0.1, 0.9, n)
    total = np.zeros(n)
    for k in range(runs):
        p = p0.copy()
        mixing._exchange(p, size, np.random.default_rng(k).integers(0, 2**63, n).astype(np.uint64))
        assert ((p > 0) & (p < 1)).sum() <= 1
        assert (p * size).sum() == pytest.approx((p0 * size).sum())
        total += p
    assert np.abs(total / runs - p0).max() < 0.04


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and set(got.columns) == set(odd.columns) | {"source_size", "target", "copies"}
    assert all(r.copies == 0 for r in got.where("text is null").collect())
    assert mixing.repeat(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.repeat(none).count() == 0


# -- packing --------------------------------------------------------------------------

def check_packing(pieces, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.vocabulary())
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in texts.items()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
    for d, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    assert set(by_doc) == set(texts)
    used = padded = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= rows[0].window <= 1024 and rows[0].window & (rows[0].window - 1) == 0
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 1024)
    return used, padded


def test_packing_covers_every_id_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    used, padded = check_packing(packing.pack(docs, queries.vocabulary()).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert padded - used <= 1024 * docs.rdd.getNumPartitions()


def test_packing_odd_texts(spark, odd, none):
    texts = {i: t for i, t in enumerate(
        ["", None, " ", "a<|endoftext|>b", "  two  blanks ", "line\n\nbreak \t tab", "é" * 3000, "word " * 5000, "日本語", "it's I'll"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = packing.pack(docs.coalesce(1), queries.vocabulary()).collect()
    check_packing(pieces, texts)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces)
    assert packing.pack(odd, queries.vocabulary()).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packing.pack(none, queries.vocabulary()).count() == 0


def test_packing_long_blank_runs(spark, monkeypatch):
    texts = {1: "a" + " " * 2_000_000 + "b", 2: "\u3000\n" * 600_000, 3: "plain words", 4: " " * 400_000 + "c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packing(packing.pack(docs.coalesce(1), queries.vocabulary()).collect(), texts)
    # a text that the ranked encoder gives up on, whatever its length
    monkeypatch.setattr(packing, "LONG_BLANK", 1 << 40)
    known = packing.Encoder(queries.vocabulary())
    assert known.ranked and known.ids(texts[1]) == known.tokenizer.encode(texts[1], add_special_tokens=False).ids


def test_step_groups_are_balanced(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").coalesce(1)
    rows = packing.pack(docs, queries.vocabulary()).select("sequence_id", "window", "step_group").distinct()
    tokens = [r.t for r in rows.groupBy("step_group").agg(F.sum("window").alias("t")).collect()]
    assert max(tokens) - min(tokens) <= 1024


def test_plan_fills_windows():
    rnd = random.Random(2)
    lengths = [rnd.choice([1, 3, 70, 200, 600, 1024, 5000]) + rnd.randint(0, 50) for _ in range(500)]
    done = packing.plan(lengths)
    assert sum(n for _, held in done for *_, n in held) == sum(lengths)
    full = [sum(n for *_, n in held) == w for w, held in done]
    assert full.count(False) <= 1


# -- language -------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") > 100)
    right = queries.op3_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    n, ok = right.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and ok / n > 0.98


def test_language_odd_rows(odd, none):
    model = language.fit(odd.where("lang is not null"))
    got = language.predict(odd, model)
    assert got.count() == odd.count()
    for r in got.collect():
        und = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == und and r.lang_pred in ("und", "en", "de") and 0 <= r.score <= 1
    assert language.predict(none, model).count() == 0
    untaught = language.predict(odd, language.fit(none))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


@pytest.mark.parametrize("step", [1, 2, 7, 50, 1 << 19])
def test_language_counts_every_gram_once_in_any_slices(step):
    texts = ["the dog and the cat " * 9, None, "", "a", "İIß ΑΣ", "x" * 100]
    got = collections.Counter()
    for rows, part, own in language._chunks(texts, step):
        points, at = language._characters(part)
        for h, inside in language._grams(points, at, 1 << 15, own):
            got.update(zip(np.repeat(rows, np.diff(at))[inside].tolist(), h[inside].tolist(), strict=True))
    want = collections.Counter()
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for n in language.ORDERS:
            for k in range(len(t) - n + 1):
                p, a = language._characters([t[k:k + n]])
                want[i, int(list(language._grams(p, a, 1 << 15))[n - 1][0][0])] += 1
    assert got == want


def test_language_log_probabilities_by_hand(spark):
    docs = [(1, "ab a", "x"), (2, "ab", "x"), (3, "zz", "y"), (4, None, "y"), (5, "q", None)]
    m = language.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), smoothing=0.5)
    bins = len(m.weights)
    for k, (lang, texts) in enumerate((("x", ["ab a", "ab"]), ("y", ["zz"]))):
        n = collections.Counter()
        for t in texts:
            for h, inside in language._grams(*language._characters([t]), bins):
                n.update(h[inside].tolist())
        whole = sum(n.values()) + 0.5 * bins
        assert m.languages[k] == lang
        for b in [*n, 0, 1, 2]:
            assert m.weights[b, k] == pytest.approx(np.log((n[b] + 0.5) / whole), rel=1e-5)
    assert m.prior == pytest.approx(np.log([2 / 3, 1 / 3]))


def test_language_scores_many_languages_in_bounded_memory(spark):
    """400 languages and a text of five million characters: the gathered rows stay small."""
    import tracemalloc
    names = tuple(f"l{i:03}" for i in range(400))
    rnd = np.random.default_rng(2)
    weights = rnd.normal(size=(1 << 15, 400)).astype(np.float32)
    assert language._score_step(400) * 400 <= 1 << 24 and language._score_step(4) == language._STEP
    tracemalloc.start()
    total = np.zeros(400)
    for rows, part, own in language._chunks(["the dog and the cat " * 250_000], language._score_step(400)):
        points, at = language._characters(part)
        for h, inside in language._grams(points, at, 1 << 15, own):
            gathered = weights[h]
            gathered[~inside] = 0
            total += gathered.sum(axis=0)
        if tracemalloc.get_traced_memory()[1] > 600 << 20:
            break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20 and len(names) == 400


# -- exact dedup ----------------------------------------------------------------------

def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for k, g in groups.items():
        keep = sorted(g, key=lambda r: (-len(r[1]), r[0] is None, r[0]))[0][0]
        sha = hashlib.sha256(k.encode()).hexdigest()
        out += [(i, keep, len(g), sha) for i, _ in g]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 15])
def test_exact_dedup_matches_brute_force(spark, max_bits):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want, groups = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    got = exact_dedup.mark(docs, max_bits)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=str) == want
    assert exact_dedup.dedup(docs, max_bits).count() == groups


def test_exact_dedup_odd_rows(odd, none):
    got = exact_dedup.mark(odd).collect()
    want, groups = brute_exact([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups and all(r.size == "size" for r in got)
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == groups
    assert exact_dedup.mark(none).count() == 0


def test_repeated_filter_never_misses(spark):
    keys = spark.range(20_000).select((F.col("id") % 15_000 * 7_919).alias("key"))
    blocks, bits = exact_dedup.repeated_filter(keys.select(F.xxhash64("key").alias("key")), 20_000)
    again = spark.range(5_000).select(F.xxhash64(F.col("id") * 7_919).alias("key")).toPandas()["key"].to_numpy()
    table = np.frombuffer(bits, np.uint8)
    assert exact_dedup._has(table, exact_dedup._probes(again.view(np.uint64), blocks)).all()
    rest = spark.range(5_000, 15_000).select(F.xxhash64(F.col("id") * 7_919).alias("key")).toPandas()["key"].to_numpy()
    assert exact_dedup._has(table, exact_dedup._probes(rest.view(np.uint64), blocks)).mean() < 0.05


def test_exact_dedup_has_one_python_step_a_stage(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    plan = exact_dedup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    # the rows that pass, the rows that are grouped, and the best of each group
    assert plan.count("ArrowEvalPython") == 3


# -- toxicity -------------------------------------------------------------------------

def test_toxicity_counts_in_parts(spark, monkeypatch):
    rows = [(i, f"word{i % 37} other{i % 11} " + ("scoundrel" if i % 3 == 0 else "gentle")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    whole = toxicity.fit(docs, labels)
    seen = []
    monkeypatch.setattr(toxicity, "COUNTED_TERMS", 7)
    frame, real = type(docs), type(docs).mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda df, f, s, *a, **k: (seen.append(real(df, f, s)), seen[-1])[1])
    parts = toxicity.fit(docs, labels)
    assert parts == whole and "scou" in whole.lexicon
    assert seen[0].groupBy("term").count().where("count > 1").count() > 0      # a term is passed on several times

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op5_toxicity(spark, sf).where("held_out").join(labels, "doc_id")
    n, ok = got.agg(F.count("*"), F.sum((F.col("toxic") == F.col("predicted")).cast("int"))).first()
    assert n > 500 and ok / n > 0.985


def test_toxicity_folding_and_exceptions():
    m = toxicity.Matcher(toxicity.ToxicityModel({"idiot": 5.0, "scum": 4.0}, (-2.0, 1.0, 1.0, 1.0), ("idiot proof",)))
    plain = m.features("what an idiot he is")
    for text in ("what an 1D10T he is", "what an іdiot he is", "what an id​iot he is", "what an ｉｄｉｏｔ he is"):
        assert m.features(text)[3] == plain[3] == 5.0
    assert m.features("an idiot-proof plan")[3] == 0.0 and m.features("a fidiot")[3] == 0.0
    assert m.features("idiot " + "word " * 500)[2] < m.features("idiot word")[2]
    assert m.features(None) == m.features("") and 0 <= m.scores(np.array([None, "idiot"], object))[0] < 0.5


def test_toxicity_matcher_against_regular_expressions():
    lexicon, exceptions = {"bad": 3.0, "badly": 4.0, "trash": 2.0, "stupid": 5.0}, ("trash can", "can of worms", "not bad at all")
    m = toxicity.Matcher(toxicity.ToxicityModel(lexicon, (0.0, 1.0, 1.0, 1.0), exceptions))
    rnd = random.Random(8)
    for _ in range(200):
        text = " ".join(rnd.choice(["bad", "badly", "badge", "trash", "can", "of", "worms", "not", "at", "all", "stupid", "forbad"]) for _ in range(30))
        spans = [(x.start(), x.end()) for e in exceptions for x in re.finditer(f"(?= {e} )", f" {text} ") for x in [re.compile(f" {e} ").match(f" {text} ", x.start())]]
        hits = {}
        for term, w in lexicon.items():
            for x in re.finditer(f" {term}", f" {text} "):
                if not any(a + 1 <= x.start() + 1 <= b - 1 for a, b in spans):
                    hits[x.start()] = max(w, hits.get(x.start(), 0.0))
        total = sum(hits.values())
        assert m.features(text)[1] == pytest.approx(np.log1p(total)) and m.features(text)[3] == max(hits.values(), default=0.0)


def test_toxicity_long_texts_take_linear_time():
    m = toxicity.Matcher(toxicity.ToxicityModel({"stupid": 5.0, "trash": 2.0}, (0.0, 1.0, 1.0, 1.0), ("trash can",)))
    start = time.process_time()
    one, many = (m.features("stupid words here trash can " * n) for n in (1, 100_000))
    assert time.process_time() - start < 10 and one[3] == many[3] == 5.0


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    for m in (toxicity.fit(odd, labels), toxicity.fit(odd, labels.limit(0)), toxicity.fit(none, labels)):
        got = toxicity.score(odd, m).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert toxicity.reject(odd, m).columns == odd.columns
        assert toxicity.score(none, m).count() == 0


# -- line rules -----------------------------------------------------------------------

def brute_rules(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    three = list(zip(w, w[1:], w[2:]))
    n, covered = collections.Counter(three), set()
    for i, g in enumerate(three):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_line_rules_base_counts(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    rep = spark.createDataFrame([(900, "a b a b a b a " * 30, "s"), (901, "x\n\n y\nx\r\nx \n", "s")], docs.schema)
    for rows in (docs.unionByName(rep), odd):
        want = sorted((str(r.doc_id), *brute_rules(r.text)) for r in rows.collect())
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                     for r in line_rules.judge(rows).collect())
        assert got == want
    assert line_rules.judge(none).count() == 0 and line_rules.strip_lines(none).count() == 0
    assert line_rules.strip_lines(odd).columns == odd.columns and line_rules.strip_lines(odd).count() == odd.count()


def test_line_rules_reject_depleted_documents(spark):
    rnd = random.Random(8)
    boiler = prose(rnd, 60)
    rows = [(i, prose(rnd, 70) + "\n" + boiler, "a") for i in range(30)]              # keeps most words
    rows += [(100 + i, boiler.upper() + "\n" + prose(rnd, 20), "a") for i in range(5)]  # depleted
    rows += [(200 + i, boiler + "\n" + prose(rnd, 20), "b") for i in range(5)]        # rare in this host
    rows += [(300 + i, "copy " + prose(random.Random(4), 80), "a") for i in range(60)]  # one text, many copies
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.judge(docs).collect()}
    assert all(got[i].kept and got[i].removed_words == 60 for i in range(30))
    assert not any(got[100 + i].kept for i in range(5)) and all(got[200 + i].kept for i in range(5))
    assert all(got[300 + i].kept for i in range(60))
    left = {r.doc_id: r.text for r in line_rules.strip_lines(docs).collect()}
    assert all(boiler not in left[i] for i in range(30)) and all(left[200 + i] == rows[35 + i][1] for i in range(5))


def test_line_rules_run_no_python(spark):
    plan = queries.op6_line_rules(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- HTML -----------------------------------------------------------------------------

def page(i, body):
    return f"""<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var x="</p>";</script></head><body class="with-sidebar">
<header><a href="/">Site</a></header><div class="top-menu"><ul><li><a>Home{i}</a><li><a>News</a></ul></div>{body}
<div class="comments"><p>reader {i} says</p></div><form><p>Send</p></form><footer>&copy; {i}</footer></body></html>"""


def test_html_article():
    body = '<article><header><h1>Head &amp; tail</h1></header><p>One <b>bo</b>ld<br>line\n two<p>Three<aside>x</aside><div class="ad-slot">Buy</div></article>'
    t = html_text.parse(page(1, body))
    assert html_text.read_page(t, html_text.infer([t])) == "Head & tail\nOne bold line two\nThree"


def wrapper_of(trees):
    slot = html_text.Slot()
    for t in trees:
        html_text.align(slot, t)
    return html_text.expression(slot)


def test_html_without_article_uses_the_wrapper():
    rnd = random.Random(5)
    texts = [[prose(rnd, 12) for _ in range(rnd.randint(1, 5))] for _ in range(6)]
    trees = [html_text.parse(page(i, "<div id=body><div class=note><p>Always the same words here</p></div>" + "".join(
        f"<p>{x}</p>" for x in ps) + "</div>")) for i, ps in enumerate(texts)]
    w = html_text.infer(trees)
    exp = wrapper_of(trees)
    assert "(?:<p>#PCDATA</p>)+" in exp and "Always\\ the\\ same\\ words\\ here" in exp and "|" not in exp.replace("\\|", "")
    assert [html_text.read_page(t, w) for t in trees] == ["\n".join(ps) for ps in texts]


def test_html_alignment_makes_optional_and_repeated_groups():
    trees = [html_text.parse(x) for x in ("<div><p>a<p>b</div><ul><li>x</ul>", "<div><p>c</div>", "<div><p>d</div><ul><li>x</ul>")]
    assert wrapper_of(trees) == wrapper_of(trees[::-1]) == "<div>(?:<p>#PCDATA</p>)+</div>(?:<ul><li>x</li></ul>)?"


def golden(rnd):
    """Hosts whose boilerplate has names of their own: (host, html, main text)."""
    def body(i, first, last=""):
        ps = [prose(rnd, rnd.randint(15, 50)) for _ in range(rnd.randint(2, 5))]
        return ps, "".join(f"<p>{x}</p>" for x in ps), first + last

    for i in range(24):                         # template blocks inside a semantic article, one of them optional
        ps, inner, _ = body(i, "")
        often = '<div class="x7-offer"><p>Read the <b>big</b> offer today</p></div>' if i % 4 else ""
        yield "in.example", page(i, f'''<article><div class="x7-tools">Pass it <a href="/s">on</a> now</div>{often}{inner}
            <section class="x7-voices"><h4>What others wrote</h4></section></article>'''), "\n".join(ps)
    for i in range(30):                         # sub-headings and sentences that return, also in a box
        ps, inner, _ = body(i, "")
        yield ("flow.example", page(i, f"<article><p>Written for the people of this town</p>{inner}<h2>Conclusion</h2><p>{ps[0]} again</p>"
                                       "<div class=box><h3>Sources</h3></div><p>All rights are with the author of this text</p></article>"),
               "\n".join(["Written for the people of this town", *ps, "Conclusion", ps[0] + " again", "Sources",
                          "All rights are with the author of this text"]))
    for i in range(60):                         # no semantic article: three layouts, unknown names, a notice on half of the pages
        ps, inner, _ = body(i, "")
        note = '<div class="zz1"><p>The office is shut on Monday</p></div>' if rnd.random() < 0.5 else ""
        kind = "abc"[i % 3]
        yield ("layouts.example", f'<html><body><div class="top{kind}"><ul class="q"><li>Home<li>Town<li>Sport</ul></div><div class="w{kind}">'
               f'<div class="text{kind}">{note}{inner}</div><div class="zz2"><p>Layout {kind} signs off with these words</p></div></div></body></html>',
               "\n".join(ps))
    yield "single.example", page(99, "<article><div class=x7-tools>Pass it on now</div><p>Read</p></article>"), "Pass it on now\nRead"


def test_html_golden_hosts(spark):
    hosts = list(golden(random.Random(15)))
    rows = [(i, f"https://{h}/{i}", x) for i, (h, x, _) in enumerate(hosts)]
    df = spark.createDataFrame(rows + rows[:5], "page_id long, url string, html string").repartition(7)
    got = collections.defaultdict(set)
    for r in html_text.extract(df).collect():
        got[r.page_id].add(r.text)
    for i, (host, _, want) in enumerate(hosts):
        assert got[i] == {want}, host
    # the same from one machine's alignment; without the wrapper these texts are not found
    for host in {h for h, *_ in hosts}:
        trees = [(html_text.parse(x), want) for h, x, want in hosts if h == host]
        w = html_text.infer([t for t, _ in trees])
        assert all(html_text.read_page(t, w) == want for t, want in trees)
        if host in ("in.example", "layouts.example"):
            assert not any(html_text.read_page(t, html_text.Wrapper(set(), {})) == want for t, want in trees)


def test_html_long_pages_take_linear_time(spark):
    """Pages of many lines, of many kinds of elements and of many nested boxes."""
    rnd = random.Random(3)
    many = "".join(f"<h{rnd.randint(1, 6)}>t{i}</h{rnd.randint(1, 6)}><{rnd.choice(['p', 'ul', 'table', 'pre'])}>x" for i in range(20_000))
    for body in ("<br>line of text" * 40_000, many, "<div>box" * 300 + "end" * 100_000):
        trees = [html_text.parse(page(i, f"<article>{body} {i}</article>")) for i in range(3)]
        start = time.process_time()
        w = html_text.infer(trees)
        assert wrapper_of(trees) and all(html_text.read_page(t, w).endswith(str(i)) for i, t in enumerate(trees))
        assert time.process_time() - start < 20


def test_html_closed_deep_elements():
    for closed in (600, 0):
        t = html_text.parse("<div><article><p>before</p>" + "<div>" * 600 + "deep<aside><p>advert</p></aside>" + "</div>" * closed
                            + "<p>after</p></article></div><p>outside</p>")
        assert html_text.read_page(t, html_text.infer([t])) == "before\ndeep\nafter"


def test_html_query_and_odd_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in queries.op7_html_text(spark, SMALL).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))
        import html
        assert got[r.page_id].text.split() == html.unescape(want).split()
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    rows = [(1, None, None), (None, "x", ""), (2, "http://h/", "<p>a<p>b"), (2, "http://h/", "<p>a<p>b"), (3, "http://h/1", "<a title=\"x>y</a> no"),
            (4, "http://h/2", "plain"), (5, "http://h/3", "<script>"), (6, "http://h/4", "<div>" * 2000 + "deep")]
    odd = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    out = html_text.extract(odd).collect()
    assert len(out) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 2] == ["a\nb"] * 2 and [r.text for r in out if r.page_id == 6] == ["deep"]
    assert html_text.extract(odd.limit(0)).count() == 0


# -- substring dedup ------------------------------------------------------------------

def test_substring_dedup_finds_passages_and_spares_clean_texts(spark):
    rnd = random.Random(6)
    rows, n = [], 40
    passages = [prose(rnd, 55) for _ in range(n)]
    for k, p in enumerate(passages):
        rows += [(2 * k, prose(rnd, 30) + " " + p + "\n" + prose(rnd, 40)), (2 * k + 1, prose(rnd, 11) + " x " + p.upper() + " y" + prose(rnd, 9))]
    rows += [(1000 + k, prose(rnd, 150)) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.find(docs).cache()
    got = {r.doc_id: r for r in found.collect()}
    hit = sum(got[2 * k + 1].other_doc_ids == [2 * k] and got[2 * k].other_doc_ids == [2 * k + 1] for k in range(n))
    assert hit == n and all(not got[1000 + k].spans and got[1000 + k].repeated_bytes == 0 for k in range(n))
    for i, t in rows:
        for s in got[i].spans or []:
            piece = t.encode()[s.start:s.start + s.length].decode().lower()
            other = dict(rows)[s.doc_ids[0]].lower()
            assert " ".join(piece.split()) in " ".join(other.split())
    left = {r.doc_id: r.text for r in substring_dedup.strip(docs, found).collect()}
    assert left[0] == rows[0][1] and len(left[1]) < 0.6 * len(rows[1][1])


def planted_runs(rnd, n):
    """Passages of 55 words that begin with, hold, end with or are a run of repeated words."""
    for k in range(n):
        unit = f"{prose(rnd, 1)[:5]}{k} " if k % 2 else f"{'abcdefgh'[k % 8]}{k} {prose(rnd, 1)[:6]} "
        run = lambda m: (unit * m).split()[:m]  # noqa: B023,E731
        head, mid, tail = ((0, 45, 10), (10, 45, 0), (5, 45, 5), (0, 55, 0))[k % 4]
        yield " ".join([*prose(rnd, head).split(), *run(mid), *prose(rnd, tail).split()])


def test_substring_dedup_finds_passages_of_repeated_words(spark):
    rnd = random.Random(16)
    rows, passages = [], list(planted_runs(rnd, 120))
    for k, p in enumerate(passages):
        rows += [(2 * k, prose(rnd, 30) + " " + p + "\n" + prose(rnd, 40)), (2 * k + 1, prose(rnd, 11) + " x " + p + " y" + prose(rnd, 9))]
    alone = [(1000, prose(rnd, 30) + " queen" * 200 + " " + prose(rnd, 30)), (1001, "=" * 3000)]
    docs = spark.createDataFrame(rows + alone + alone[:1], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.find(docs).collect()}
    assert all(got[i].spans is None for i, _ in alone)
    for i, t in rows:
        p = passages[i // 2]
        at = len(t[:t.index(p)].encode())
        seen = sum(min(s.start + s.length, at + len(p)) - max(s.start, at) for s in got[i].spans or [] if i ^ 1 in s.doc_ids)
        assert got[i].other_doc_ids == [i ^ 1] and seen >= 0.5 * len(p)
        assert got[i].repeated_bytes <= len(p) + 2


def test_chunks_of_runs_follow_the_content():
    def run(b):
        return list(substring_dedup.chunks(np.frombuffer(b, np.uint8), np.array([0]))[1])
    rnd = random.Random(17)
    tail = prose(rnd, 60)
    for unit in ("queen ", "=", "-+", "no, never. ", "fifteen bytes! "):
        a, b = (run(f"{prose(rnd, 20)} {unit * (n // len(unit))}{tail}".encode()) for n in (1200, 1711))
        (x, n), (y, m) = (collections.Counter(c).most_common(1)[0] for c in (a, b))
        assert a[-8:] == b[-8:] and x == y and m > n >= 24


def test_chunks_do_not_shift():
    rnd = random.Random(7)
    text = prose(rnd, 400).encode()
    def run(b):
        start, digest, _ = substring_dedup.chunks(np.frombuffer(b, np.uint8), np.array([0]))
        assert start[0] == 0 and (np.diff(start) > 0).all()
        return list(digest)
    a, b = run(text), run(b"inserted words " + text)
    assert a[3:] == b[-len(a) + 3:]
    assert np.diff(substring_dedup.chunks(np.frombuffer(text, np.uint8), np.array([0]))[0])[1:].min() > substring_dedup.REACH
    both = substring_dedup.chunks(np.frombuffer(text + text, np.uint8), np.array([0, len(text)]))[1]
    assert list(both) == a + a
    assert np.diff(substring_dedup.chunks(np.full(5000, 97, np.uint8), np.array([0]))[0]).max() <= substring_dedup.MAX_CHUNK


def test_substring_dedup_splits_hot_passages(spark, monkeypatch):
    """A passage of very many documents is joined apart; the result is the same."""
    rnd = random.Random(31)
    hot, other = prose(rnd, 60), prose(rnd, 60)
    rows = [(i, f"{prose(rnd, 20)} {hot if i % 3 else other if i % 2 else ''} {prose(rnd, 20)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(str, substring_dedup.find(docs).collect()))
    monkeypatch.setattr(substring_dedup, "HOT_PLACES", 15)
    assert sorted(map(str, substring_dedup.find(docs).collect())) == want


def test_cuts_keep_whole_characters():
    import pandas as pd
    text = "añb日本語c"                                      # a, 2 bytes, b, three of 3 bytes, c
    raw = text.encode()
    for start in range(len(raw)):
        for end in range(start + 1, len(raw) + 1):
            got = substring_dedup._cut(pd.Series([text]), pd.Series([[{"start": start, "length": end - start, "removed": True}]]))[0]
            inside = [c for i, c in enumerate(text) if start <= len(text[:i].encode()) and len(text[:i + 1].encode()) <= end]
            assert got == "".join(c for i, c in enumerate(text) if not (start <= len(text[:i].encode()) and len(text[:i + 1].encode()) <= end)), inside


def test_substring_dedup_odd_rows(odd, none):
    got = substring_dedup.find(odd).collect()
    assert len(got) == odd.count()
    assert all(r.spans is None and r.n_bytes == 0 for r in got if r.doc_id in (4, 5))
    assert substring_dedup.find(none).count() == 0


# -- sharding -------------------------------------------------------------------------

def brute_shards(rows, shards, seed=17):
    key = lambda r: (hashlib.md5(f"{seed}:{r[0]}:{r[2]}".encode()).hexdigest(), r[0], r[2])
    share = []
    for s in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == s), key=key)
        share += [((k + 0.5) / len(mine), s, key(r), r[0]) for k, r in enumerate(mine)]
    share.sort()
    out, n = {}, len(rows)
    for pos, (*_, i) in enumerate(share):
        shard = pos * shards // n
        out[i] = (shard, pos - -(-shard * n // shards))
    return out


def test_sharding_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    rows = [(r.doc_id, r.source, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    got = queries.op9_sharding(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == brute_shards(rows, 40)
    assert all(r.law == "rows" and r.grown_shard is None and r.text_crc32 == zlib.crc32(t.encode()) and r.size == len(t.encode()) + 16
               for r, t in ((r, {d.doc_id: d.text for d in docs.collect()}[r.doc_id]) for r in got[:50]))


def test_sharding_odd_rows(odd, none):
    rows = odd.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    got = sharding.assign(rows, 5).collect()
    n = collections.Counter(r.shard for r in got)
    assert len(got) == odd.count() and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    few = sharding.assign(rows.limit(3), 40).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)
    assert sharding.assign(none.withColumn("text_crc32", F.lit(0)), 5).count() == 0


# -- MinHash --------------------------------------------------------------------------

def brute_components(rows, size=3, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_matches_brute_force(spark):
    rnd = random.Random(9)
    base = prose(rnd, 120).split()
    rows = []
    for k in range(150):                       # a large chained group around the threshold
        w = list(base)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = prose(rnd, 1)
        rows.append((k, " ".join(w)))
    rows += [(1000, "A b"), (1001, "a  B"), (1002, "a"), (1003, ""), (1004, None), (1005, "a b c"), (1006, "\t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link(docs).collect()} == want
    kept = {r.doc_id for r in minhash.dedup(docs, 3, 85).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_minhash_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = queries.op10_minhash(spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_odd_rows(odd, none):
    got = minhash.link(odd).collect()
    assert len(got) == odd.count()
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id in (4, 5, 6))
    kept = minhash.dedup(odd)
    assert kept.columns == odd.columns
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(t is not None and t.startswith(odd.where("doc_id = 1").first().text[:20]) for _, t in ids) == 1
    assert sum(i == 7 for i, _ in ids) == 2 and sum(t is None for _, t in ids) == 2
    assert minhash.link(none).count() == 0 and minhash.dedup(none).count() == 0


def test_minhash_broadcasts_stay_small(spark, monkeypatch):
    rnd, hints, join = random.Random(4), [], type(spark.range(1)).join
    texts = [prose(rnd, 10) for _ in range(10_500)]      # each linked with itself less the last word: 7 of 8
    rows = [(k, t) for k, t in enumerate(texts)] + [(k + 20_000, t.rsplit(" ", 1)[0]) for k, t in enumerate(texts)]

    def joined(left, right, *a, **b):
        plan = right._jdf.queryExecution().analyzed().toString()
        if "UnresolvedHint" in plan or "ResolvedHint" in plan:
            hints.append(("broadcast" in plan.split("\n")[0], right.columns, right.count()))
        return join(left, right, *a, **b)

    monkeypatch.setattr(type(spark.range(1)), "join", joined)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.link(docs).groupBy("component_id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()
    assert len(got) == 10_500 and all(r.a == r.component_id and r.b == r.a + 20_000 for r in got)
    assert max(n for *_, n in hints) >= 21_000
    assert all(n <= 20_000 for broadcast, columns, n in hints if broadcast and columns != ["row_key"]), hints


def test_word_hash_ignores_place_and_case():
    texts = ["Ab cd  EF\n" + "q" * 5000, "  ab\tcd ef " + "Q" * 5000, "é ab"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    h, row = minhash.word_hashes(data, np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]))
    assert row.tolist() == [0] * 4 + [1] * 4 + [2] * 2 and (h[:4] == h[4:8]).all() and h[9] == h[0] and len(set(h[:4])) == 4
