"""File walk, text read, caches, snapshots, as-of, test reports."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from meritflow.sources import published, sinks, trees


def make_repo():
    root = tempfile.mkdtemp(prefix="meritflow-repo-")
    layout = {
        "pkg/a.py": "x = 1\n" * 20,
        "pkg/b.py": "y = 2\r\n" * 20,
        "pkg/c.py": "short",
        "pkg/_x.py": "# one underscore is an ordinary name\n" * 3,
        "_deep/a/b/c/_y.py": "deep = 1\n" * 10,
        "pkg/old.pyc": "no source",
        "pkg/__init__.py": "",
        "pkg/.hidden.py": "z = 3\n" * 20,
        ".git/x.py": "w = 0\n" * 20,
        "pkg/__pycache__/d.py": "q = 1\n" * 20,
        "pkg/notes.txt": "not python",
        "top.py": "print(1)\n" * 10,
    }
    for rel, text in layout.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", newline="") as f:
            f.write(text)
    with open(os.path.join(root, "pkg", "bad.py"), "wb") as f:
        f.write(b"\xff\xfe not utf8 " * 10)
    return root


def test_walk_and_read(spark):
    root = make_repo()
    listed = {(r.dir, r.name) for r in trees.list_files(spark, root).collect()}
    assert listed == {("pkg", "a.py"), ("pkg", "b.py"), ("pkg", "c.py"), ("pkg", "bad.py"), ("", "top.py"),
                      ("pkg", "_x.py"), ("_deep/a/b/c", "_y.py")}
    by_uri = {(r.dir, r.name) for r in trees.list_files(spark, f"file://{root}/").collect()}
    assert by_uri == listed
    cand = trees.candidate_files(spark, root, min_files=3, min_len=50)
    got = {r.name: r.contents for r in cand.collect()}
    assert set(got) == {"a.py", "b.py", "_x.py"}          # c.py too short, bad.py undecodable, top.py dir too small
    assert "\r" not in got["b.py"] and got["b.py"].startswith("y = 2\n")


@pytest.mark.parametrize("want", [1, 2, 3, 99])
def test_walk_partitions_share_out_the_tree(spark, want):
    """However many partitions are asked for, every file is found once."""
    root = make_repo()
    walk = trees._Walk(root, ".py", want)
    found = sorted((f[1], f[2]) for p in walk.partitions() for f in walk.read(p))
    assert found == sorted((r.dir, r.name) for r in trees.list_files(spark, root).collect()) and len(set(found)) == len(found)


def test_only_listed_files_are_opened(spark):
    root = make_repo()
    listed = trees.list_files(spark, root).where("name = 'a.py'").toArrow().to_batches()
    for other in ("b.py", "bad.py", "c.py"):
        os.remove(os.path.join(root, "pkg", other))
    assert [r["name"] for b in trees._contents(iter(listed)) for r in b.to_pylist()] == ["a.py"]


def test_missing_root_raises(spark):
    with pytest.raises(Exception, match="no-such-folder"):
        trees.list_files(spark, "/tmp/no-such-folder").collect()


def test_cache_by_fingerprint(spark):
    base, calls = os.path.join(tempfile.mkdtemp(), "cache"), []
    table = spark.createDataFrame([(1, [0.5], "a"), (2, None, None), (2, None, None)], "id int, v array<double>, s string")

    def get(df, **kw):
        def compute():
            calls.append(1)
            return df.groupBy("id").count()
        got, hit = sinks.read_or_compute(spark, base, [df], compute, min_files=3, **kw)
        return sorted(map(tuple, got.collect())), hit

    assert get(table) == ([(1, 1), (2, 2)], False) and get(table.repartition(5)) == ([(1, 1), (2, 2)], True)
    assert len(calls) == 1
    once, changed = table.dropDuplicates(["id"]), table.withColumn("s", F.coalesce("s", F.lit("b")))
    assert get(once)[1] is False and get(changed)[1] is False                  # a lost copy, a changed row
    assert get(table, min_len=50)[1] is False and get(table, refresh=True)[1] is False and get(table)[1] is True
    empty = table.limit(0)
    assert get(empty) == ([], False) and get(empty) == ([], False)            # an empty result does not count
    assert not [f for f in os.listdir(base) if f.startswith("staged")]


def test_published_rows_are_there_once(spark):
    import pyarrow as pa
    path = os.path.join(tempfile.mkdtemp(), "table")
    w = published._Writer(path)
    batch = lambda *v: iter([pa.RecordBatch.from_pydict({"v": pa.array(v, pa.int64())})])
    lost, first, second = w.write(batch(1, 2)), w.write(batch(1, 2)), w.write(batch(3))   # the first try of a task got lost
    assert published.published(spark, path, "v bigint").count() == 0                      # nothing before the commit
    w.commit([first, second, w.write(iter([]))], 0)
    w.commit([w.write(batch(1, 2)), None], 0)                                             # batch 0 replayed
    w.abort([w.write(batch(9))], 1)
    w.commit([w.write(batch(4))], 1)
    assert sorted(r.v for r in published.published(spark, path, "v bigint").collect()) == [1, 2, 3, 4]
    assert lost.rows == 2 and len(os.listdir(os.path.join(path, "data"))) == 4            # only the lost try is left over


def test_state_snapshots(spark):
    path = os.path.join(tempfile.mkdtemp(), "state")
    sinks.save_state(spark.createDataFrame([(0, "a", 0.5)], "uid int, hotkey string, score double"), path, 1)
    sinks.save_state(spark.createDataFrame([(0, "a", 0.7, 0.1)], "uid int, hotkey string, score double, pr_score double"), path, 2)
    last = sinks.load_state(spark, path).collect()
    assert len(last) == 1 and last[0].score == 0.7 and last[0].pr_score == 0.1
    sinks.save_state(spark.createDataFrame([(0, "b", 0.9)], "uid int, hotkey string, score double"), path, 3)
    last = sinks.load_state(spark, path).collect()
    assert last[0].hotkey == "b" and last[0].pr_score == 0.0 and last[0].step == 3
    one = spark.createDataFrame([(0, "b", 0.9)], "uid int, hotkey string, score double")
    with pytest.raises(ValueError, match="not above"):
        sinks.save_state(one, path, 3)
    assert sinks.save_state(one, path) == 4
    with pytest.raises(FileNotFoundError):
        sinks.load_state(spark, path + "-none")


def test_as_of(spark):
    snaps = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "x")], "uid int, sts int, hotkey string")
    ev = spark.createDataFrame([(1, 9, 100), (1, 10, 101), (1, 25, 102), (2, 1, 103)], "uid int, ts int, id int")
    for width in (1, 4, 100):
        got = {r.id: r.hotkey for r in sinks.as_of(snaps, ev, "uid", "sts", "ts", bucket_width=width).collect()}
        assert got == {100: None, 101: "a", 102: "b", 103: None}, width


def test_as_of_matches_brute_force(spark):
    import random
    random.seed(9)
    snaps = [(random.randrange(3), random.randrange(1000), f"h{i}") for i in range(200)]
    evs = [(random.randrange(3), random.randrange(1000), i) for i in range(300)]
    s = spark.createDataFrame(snaps, "uid int, sts int, hotkey string").dropDuplicates(["uid", "sts"])
    e = spark.createDataFrame(evs, "uid int, ts int, id int")
    sl = [(r.uid, r.sts, r.hotkey) for r in s.collect()]
    exp = {}
    for u, t, i in evs:
        best = max((x for x in sl if x[0] == u and x[1] <= t), key=lambda x: x[1], default=None)
        exp[i] = best[2] if best else None
    for width, most in ((37, 1_000_000), (400, 7), (100_000, 3)):            # full buckets are cut
        got = {r.id: r.hotkey for r in sinks.as_of(s, e, "uid", "sts", "ts", bucket_width=width, rows=most).collect()}
        assert got == exp


def test_report_outcomes(spark):
    rep = ('{"tests": [{"nodeid": "t1", "outcome": "passed"}, {"nodeid": "t2", "outcome": "skipped"},'
           ' {"nodeid": "t1", "outcome": "FAILED"}, {"nodeid": "t3", "outcome": "passed"}]}')
    df = spark.createDataFrame([(1, "before", rep)], "sub int, run string, report string")
    got = {r.test_id: r.status for r in sinks.test_report_outcomes(df, ["sub", "run"]).collect()}
    assert got == {"t1": "failed", "t3": "passed"}
