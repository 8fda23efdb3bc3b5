"""Streaming upserts and file sources."""

import pytest

from affinix.operators import ease
from affinix.sources import files, tables
from affinix.streaming.upserts import current, upsert_stream


def test_upsert_stream(spark, tmp_path):
    schema = "k long, v string, t long"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["k"], "t", f"{tmp_path}/check").awaitTermination()
    run()
    spark.createDataFrame([(2, "B", 3), (3, "c", 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert {(r.k, r.v) for r in current(spark, f"{tmp_path}/out").collect()} == {(1, "a"), (2, "B"), (3, "c")}
    assert {(r.k, r.v) for r in current(spark, f"{tmp_path}/out", 1).collect()} == {(1, "a"), (2, "b")}


def test_upserts_touch_only_their_buckets_and_survive_a_restart(spark, tmp_path):
    schema, target = "k long, v string, t long", f"{tmp_path}/out"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(checkpoint):
        upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), target, ["k"], "t", f"{tmp_path}/{checkpoint}", 16).awaitTermination()

    add([(i, "a", 1) for i in range(200)])
    run("check")
    first = sorted(p.name for p in (tmp_path / "out/data/batch=0").iterdir() if p.name.startswith("bucket"))
    add([(5, "b", 2), (5, "old", 0), (900, "c", 1)])
    run("check")
    second = sorted(p.name for p in (tmp_path / "out/data/batch=1").iterdir() if p.name.startswith("bucket"))
    assert len(first) == 16 and 1 <= len(second) <= 2
    want = {(i, "a") for i in range(200) if i != 5} | {(5, "b"), (900, "c")}
    assert {(r.k, r.v) for r in current(spark, target).collect()} == want
    # The second batch is written again, as after a failure before its commit: the same rows, none twice.
    for name in ("1", ".1.crc"):
        (tmp_path / "check/commits" / name).unlink()
    run("check")
    got = [(r.k, r.v) for r in current(spark, target).collect()]
    assert len(got) == len(want) and set(got) == want
    with pytest.raises(ValueError):
        current(spark, f"{tmp_path}/nothing")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("id 76561190000000001")
    (tmp_path / "b.txt").write_text("id 76561190000000002")
    got = {r.name: r for r in files.fingerprints(spark, str(tmp_path), "*.txt").collect()}
    assert got["a.txt"].size == 20 and len(got["a.txt"].sha256) == 16
    assert [(r.extension, r.n) for r in files.summary(files.file_info(spark, str(tmp_path))).collect()] == [(".txt", 2)]
    texts = spark.read.text(str(tmp_path), wholetext=True)
    assert files.account_numbers(texts, "value", ["76561190000000001"]).count() == 1
    (tmp_path / "m.json").write_text('{"3": 1, "4": 2}')
    assert {(r.key, r.value) for r in tables.json_map(spark, f"{tmp_path}/m.json").collect()} == {("3", 1), ("4", 2)}
    (tmp_path / "c.csv").write_text("a,b\n1,x\nbad,y\n3,z\n")
    assert tables.csv(spark, f"{tmp_path}/c.csv", "a int, b string").count() == 2


def test_sinks_and_lists(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 2.5), (2, None, None)], "k int, v string, x double")
    tables.write_csv(df, f"{tmp_path}/csv")
    assert sorted(tables.csv(spark, f"{tmp_path}/csv", "k int, v string, x double").collect()) == sorted(df.collect())
    tables.write_stats(df, f"{tmp_path}/stats")
    assert {r.k: r.x for r in spark.read.json(f"{tmp_path}/stats").collect()} == {1: 2.5, 2: None}
    for write, path in ((tables.write_csv, "csv"), (tables.write_stats, "stats")):
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
            write(df, f"{tmp_path}/{path}")
    (tmp_path / "l.json").write_text('["x", "y"]')
    assert [(r.position, r.value) for r in tables.json_list(spark, f"{tmp_path}/l.json").collect()] == [(0, "x"), (1, "y")]
    tables.write_csv(df, f"{tmp_path}/scores.csv")
    tables.write_scores(df, f"{tmp_path}/scores")
    for path in ("scores.csv", "scores"):
        assert sorted((r.k, r.x) for r in tables.read_scores(spark, f"{tmp_path}/{path}", ["k", "x"]).collect()) == [(1, 2.5), (2, None)]
        with pytest.raises(ValueError, match="gone"):
            tables.read_scores(spark, f"{tmp_path}/{path}", ["gone"])
    weights = spark.createDataFrame([(1, 2, 0.5), (2, 1, -0.25)], "i long, j long, sim double")
    ease.save_weights(weights, f"{tmp_path}/b")
    assert sorted(ease.load_weights(spark, f"{tmp_path}/b").collect()) == sorted(weights.collect())
    files.new_run(df, f"{tmp_path}/run")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.new_run(df, f"{tmp_path}/run")
    files.append_log(df, f"{tmp_path}/log")
    files.append_log(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    assert spark.read.parquet(files.versioned(df, f"{tmp_path}/v", "3")).count() == 2


def test_a_run_folder(spark, tmp_path):
    from affinix.sources.runs import Run, manifests, means, registry

    run = Run(spark, str(tmp_path), "r1").begin({"k": 10, "seed": 42})
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        Run(spark, str(tmp_path), "r1").begin({})
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "a", 1.0), (3, "b", float("nan")), (4, "b", None)], "user_id long, system string, recall double")
    run.per_query(rows)
    assert run.read_per_query("user_id long, system string, recall double").count() == 4
    of_system = means(rows, ["system"], ["recall"])
    run.aggregate(of_system)
    assert [(r.system, r.metric, r.n, r["mean"]) for r in of_system.collect()] == [("a", "recall", 2, 0.75)]
    run.report("# Title\n\nbody", "2026-01-02", "keep")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/r1/report.md").collect()]
    assert lines == ["# Title", "", "> **run**: `r1` · **day**: 2026-01-02", "> **decision**: keep", "", "body"]
    run.register({"recall": 0.75})
    Run(spark, str(tmp_path), "r2").begin({}).register({"recall": 0.5})
    assert sorted(r.run_id for r in manifests(spark, str(tmp_path)).collect()) == ["r1", "r2"] == sorted(r.run_id for r in registry(spark, str(tmp_path)).collect())
    (tmp_path / "x.txt").write_text("x")
    got = {r.name: (r.there, r.size) for r in files.expected(spark, f"{tmp_path}/*.txt", ["x.txt", "y.txt"]).collect()}
    assert got == {"x.txt": (True, 1), "y.txt": (False, None)}


def test_fingerprints_of_large_files_are_streamed(spark, tmp_path):
    """Bytes of any kind, in several splits, with and without a last line's end or a byte order mark."""
    import hashlib
    import random

    from affinix.sources import files

    draw = random.Random(3)
    made = {"random.bin": draw.randbytes(300_000), "ended.txt": b"a\r\nb\n\n", "open.txt": b"\nx", "one": b"\n", "marked.txt": b"\xef\xbb\xbfab\nc", "marked_ended.txt": b"\xef\xbb\xbfab\n", "no_line.bin": b"\xff\xfe\x00"}
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        for whole in (0, 10_000, 2**28):
            got = {r.name: (r.sha256, r.size) for r in files.fingerprints(spark, str(tmp_path), whole=whole).collect()}
            assert got == {n: (hashlib.sha256(b).hexdigest()[:16], len(b)) for n, b in made.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
