import pytest
from pyspark.sql import functions as F

from fernweh.operators import duplicates, health, incremental, metrics, policy, ranking, semantic, snippets, store
from fernweh.streaming import changes


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_changed_rows_nulls_and_repeats(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "z"), (4, "d")], "k int, content_hash string")
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x"), (3, None), (None, "z")], "k int, content_hash string")
    assert rows(incremental.changed_rows(cur, old, ["k"]).select("k")) == [(2,), (3,), (4,)]
    assert incremental.changed_rows(cur, old.limit(0), ["k"]).count() == 5
    assert rows(incremental.vanished_keys(cur, spark.createDataFrame([(1,), (9,)], "k int"), ["k"])) == [(9,)]


def test_content_hash_keeps_parts_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c")], "x string, y string").select(incremental.content_hash(F.col("x"), F.col("y")).alias("h"))
    a, b, c = [r.h for r in df.collect()]
    assert a != b and c is None and len(a) == 32


def test_run_state_survives_a_crash(spark, tmp_path):
    state = incremental.RunState(spark, f"file://{tmp_path}/s")
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "k int, content_hash string")
    seen = []

    def fail(fresh):
        seen.append(rows(fresh.select("k")))
        raise OSError("lost")

    with pytest.raises(OSError):
        state.run(cur, ["k"], fail)
    assert state.version() == 0
    state.run(cur, ["k"], lambda fresh: seen.append(rows(fresh.select("k"))))
    assert seen == [[(1,), (2,)], [(1,), (2,)]] and state.version() == 1
    state.run(cur.withColumn("content_hash", F.when(F.col("k") == 2, "c").otherwise("a")), ["k"], lambda fresh: seen.append(rows(fresh.select("k"))))
    assert seen[-1] == [(2,)]
    with pytest.raises(RuntimeError):
        state.commit(cur, 1)  # another run has committed version 2
    assert rows(state.load("k int, content_hash string")) == [(1, "a"), (2, "c")]  # and what it committed stays


def test_a_row_that_changes_during_a_run_is_not_skipped(spark, tmp_path):
    source, state = str(tmp_path / "rows"), incremental.RunState(spark, f"file://{tmp_path}/s")
    spark.createDataFrame([(1, "x")], "k int, content_hash string").write.parquet(source)
    seen = []

    def process(fresh):
        seen.append(rows(fresh))
        spark.createDataFrame([(1, "z")], "k int, content_hash string").write.mode("overwrite").parquet(source)

    state.run(spark.read.parquet(source), ["k"], process)
    assert rows(state.load("k int, content_hash string")) == [(1, "x")]
    state.run(spark.read.parquet(source), ["k"], lambda fresh: seen.append(rows(fresh)))
    assert seen == [[(1, "x")], [(1, "z")]]


def test_outputs_hold_each_record_once(spark, tmp_path):
    state = incremental.RunState(spark, f"file://{tmp_path}/s")
    cur = spark.createDataFrame([(1, "a", None), (2, None, "n"), (None, "c", "o")], "k int, content_hash string, extra string")

    def beaten(fresh):
        state.run(cur.filter("k = 1"), ["k"], lambda f: f)
        return fresh

    with pytest.raises(RuntimeError):
        state.run(cur, ["k"], beaten)
    state.run(cur, ["k"], lambda f: f)
    got = state.outputs("k int, content_hash string, extra string").collect()
    assert sorted((r.k or 0, r.extra) for r in got) == [(0, "o"), (1, None), (2, "n")]
    state.run(cur, ["k"], lambda f: f)  # a null hash is never vouched for, so its row comes again
    assert state.outputs("k int, content_hash string, extra string").count() == 4
    assert len(state.vacuum(-1000)) >= 1 and state.outputs("k int").count() == 4


def test_due_on_empty_tables(spark):
    from conftest import DATA

    from fernweh.runtime import read

    t = [read(spark, DATA, n).limit(0) for n in ("files", "content_map", "vec_files", "index_runs", "ocr_cache")]
    assert incremental.due(t[0], t[1], incremental.done(*t[2:])).count() == 0
    full = read(spark, DATA, "files")
    assert incremental.due(full, t[1], incremental.done(*t[2:])).filter("stage = 'ocr'").count() == full.filter("kind IN ('image','pdf') AND content_state IN (1,4)").count()


def test_lines_pages_and_ranges(spark):
    t = spark.createDataFrame([(1, "alpha\nbeta gamma\fpage two beta\nend"), (2, "")], "id long, data string")
    got = rows(snippets.lines(t).select("id", "line", "page", "text"))
    assert got == [(1, 1, 1, "alpha"), (1, 2, 1, "beta gamma"), (1, 3, 2, "page two beta"), (1, 4, 2, "end"), (2, 1, 1, "")]
    r = t.filter("id = 1").select(snippets.highlights(F.col("data"), "beta").alias("r")).first().r
    assert [(x.line, x.start_pos, x.end_pos) for x in r] == [(2, 0, 4), (3, 9, 13)]
    assert rows(snippets.page_starts(t.filter("id = 1"))) == [(1, 1, 1), (1, 2, 3)]


def test_clip(spark):
    df = spark.createDataFrame([("x" * 300 + " needle " + "y" * 300,), ("short\tline",)], "t string")
    out = [r[0] for r in df.select(snippets.clip(F.col("t"), F.instr("t", "needle") - 1)).collect()]
    assert out[0].startswith("…") and "needle" in out[0] and len(out[0]) <= 242 and out[1] == "short line"


def test_chunks_stay_when_another_changes():
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    paras = [" ".join(word() for _ in range(60)) for _ in range(40)]
    cut = lambda ps: [("\n\n".join(ps))[a:b] for a, b in semantic.chunk("\n\n".join(ps))]
    a = cut(paras)
    b = cut([*paras[:20], "something else " * 20, *paras[21:]])
    assert all(len(x) <= semantic.CHUNK for x in a) and len(set(a) - set(b)) <= 3
    assert [x for x in semantic.chunk("   ")] == [] and semantic.chunk("a" * 5000)[0] == (0, 1800)


def test_meaning_scale(spark):
    df = spark.createDataFrame([(i, i % 3 / 10.0, 0, True) for i in range(30)] + [(99, 0.9, 0, False)], "file long, score double, modality int, sets_scale boolean")
    z = {r.file: r.z for r in semantic.meaning(df).collect()}
    assert abs(sum(z[i] for i in range(30))) < 1e-6 and z[99] > 5


def test_related_orders(spark):
    v = {"s": [1.0, 0.0], "near": [0.98, 0.2], "mid": [0.9, 0.43], "far": [0.0, 1.0]}
    df = spark.createDataFrame([(i, 0, 0, h, x) for i, (h, x) in enumerate(v.items())], "file long, n long, start_pos long, hash string, vec array<double>")
    assert [r.file for r in semantic.related(df, 0).orderBy(F.desc("score")).collect()] == [1, 2]


def test_fusion_and_frecency(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, rank int")
    f = {r.id: r for r in ranking.fuse([(a, 1.0, "x"), (a.filter("id = 2").withColumn("rank", F.lit(0)), 1.0, "y")]).collect()}
    assert f[2].score > f[1].score and f[2].sources == ["x", "y"]
    o = spark.sql("SELECT 'p' AS path, timestamp_ntz'2024-01-01 00:00:00' AS ts, 'cli' AS via UNION ALL SELECT 'p', timestamp_ntz'2024-01-01 00:00:00', 'cli' UNION ALL SELECT NULL, NULL, 'x'")
    assert [tuple(r)[:2] for r in ranking.frecency(o).collect()] == [("p", 1)]


def test_moves_need_a_single_match(spark):
    old = spark.createDataFrame([("a", 1, 1, 5, 5), ("b", 1, 2, 5, 5), ("c", 1, 2, 5, 5)], "path string, dev long, ino long, size long, mtime long")
    new = spark.createDataFrame([("A", 1, 1, 5, 5), ("B", 1, 2, 5, 5)], "path string, dev long, ino long, size long, mtime long")
    assert rows(duplicates.moves(old, new)) == [("a", "A")]


def test_store(spark):
    m = spark.createDataFrame([(1, 10), (2, 11)], "id long, text long")
    t = spark.createDataFrame([(10, "x"), (11, "y")], "id long, data string")
    new = spark.createDataFrame([(1, "y"), (3, "z")], "id long, data string")
    added, removed, users = store.write_contents(m, t, new)
    assert [(r.id, r.data) for r in added.collect()] == [(12, "z")] and rows(removed) == [(10,)] and rows(users.select("id", "text")) == [(1, 11), (2, 11), (3, 12)]
    many = spark.createDataFrame([(k, f"t{k % 300}") for k in range(1000)] + [(5000, None)], "id long, data string")
    added, removed, users = store.write_contents(m, t, many)
    assert sorted(r.id for r in added.collect()) == list(range(12, 312)) and users.count() == 1000 and rows(removed) == [(10,), (11,)]
    nothing = store.write_contents(m.limit(0), t.limit(0), new)
    assert sorted(r.id for r in nothing[0].collect()) == [1, 2] and nothing[1].count() == 0
    v = spark.createDataFrame([("a",)], "term string")
    assert rows(store.append_vocabulary(v, spark.createDataFrame([("a",), ("b",), ("b",)], "term string"))) == [("b",)]


def test_ignore_rules(spark):
    f = spark.createDataFrame([(1, "/r/a.log", False), (2, "/r/keep/b.log", False), (3, "/r/build", True), (4, "/r/build/x.c", False), (5, "/r/src/c.py", False), (6, "/r/src/sub/c.py", False)], "id long, path string, is_dir boolean")
    got = policy.ignored(f, [("/r", "*.log"), ("/r/keep", "!b.log"), ("/r", "build/"), ("/r", "/src/*.py")])
    assert rows(got) == [(1,), (3,), (4,), (5,)]


def test_targets(spark):
    cat = spark.createDataFrame([("/r", True), ("/r/a", True), ("/r/a/x", False)], "path string, is_dir boolean")
    ch = spark.createDataFrame([("/r/a/x",), ("/r/a/.gitignore",), ("/r/gone/deep/f",), ("/o/y",)], "path string")
    assert rows(policy.targets(ch, cat, ["/r"])) == [("/r/a",), ("/r/gone",)]


def test_machine_names(spark):
    names = ["000123.png", "IMG_1234.jpg", "holiday beach.png", "frame_000123.png", "deadbeefdeadbeef.png", "20230512_143022.jpg", "plan.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(health.machine_named(F.col("n"))).collect()] == [True, False, False, True, True, False, False]


def test_evaluation(spark):
    run = spark.createDataFrame([("q", 1, 3.0), ("q", 2, 2.0), ("q", 3, 1.0)], "query string, doc long, score double")
    qrels = spark.createDataFrame([("q", 2, 2), ("q", 9, 1)], "query string, doc long, grade int")
    r = metrics.evaluate(run, qrels).first()
    assert abs(r.mrr - 0.5) < 1e-9 and abs(r.recall - 0.5) < 1e-9 and 0 < r.ndcg < 1
    mean, lo, hi = metrics.bootstrap([0.1, 0.2, 0.3, 0.2])
    assert lo <= mean <= hi and metrics.bootstrap([0.1, 0.2, 0.3, 0.2]) == (mean, lo, hi)


def test_applying_changes_twice_is_applying_them_once(spark):
    cat = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, path string, seq long")
    ch = spark.createDataFrame([(1, "A", 5), (3, "c", 6)], "id long, path string, seq long")
    gone = spark.createDataFrame([(2, 4), (3, 3)], "id long, seq long")
    once = changes.apply_changes(cat, ch, gone)
    assert rows(once) == [(1, "A", 5), (3, "c", 6)] == rows(changes.apply_changes(once, ch, gone))


def test_coalescing_rounds(spark):
    ch = spark.createDataFrame([(f"/r/d/{i}",) for i in range(5)] + [("/r/d/1/x",), ("/r/e/f",)], "path string")
    assert rows(changes.coalesced(ch, ["/r"], per_folder=3)) == [("/r/d",), ("/r/e/f",)]
    assert changes.coalesced(ch, ["/r"], per_folder=100, most=2) is None


def test_streaming_sink_keeps_the_latest(spark, tmp_path):
    src = tmp_path / "in"
    schema = "id long, path string, seq long"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 3)], schema).coalesce(1).write.parquet(str(src))
    state = changes.LatestTable(spark, f"file://{tmp_path}/state", "id", "seq", schema, most=2)
    q = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(changes.sink_latest(state)).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(state.rows()) == [(1, "c", 3), (2, "b", 1)]
    for number in (7, 7, 8):
        state.apply(spark.createDataFrame([(1, "d", 3 + number)], schema), number)
    assert rows(state.rows()) == [(1, "d", 11), (2, "b", 1)] and state.version() == 3
