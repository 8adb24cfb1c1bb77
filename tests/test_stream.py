"""Tail source and streaming jobs."""

from pyspark.sql import functions as F

from tracelake.streaming import jobs, tail, versions


def test_chunks_give_lines_with_byte_offsets(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    first, second = "one\r\nzwei é\n", "drei\n"
    (logs / "a.jsonl.0.0").write_bytes(first.encode())
    (logs / "b.jsonl").write_bytes(b"plain\n\nlast, no line end")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        q = tail.read_chunks(spark, str(logs)).writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.file.rsplit("/", 1)[1], r.epoch, r.ord, r.value) for r in spark.read.parquet(out).collect())

    b = [("b.jsonl", 0, 0, "plain"), ("b.jsonl", 0, 6, ""), ("b.jsonl", 0, 7, "last, no line end")]
    assert run() == [("a.jsonl", 0, 0, "one"), ("a.jsonl", 0, 5, "zwei é"), *b]
    (logs / f"a.jsonl.0.{len(first.encode())}").write_bytes(second.encode())
    (logs / "a.jsonl.1.0").write_bytes(b"anew\n")
    assert run() == [("a.jsonl", 0, 0, "one"), ("a.jsonl", 0, 5, "zwei é"), ("a.jsonl", 0, len(first.encode()), "drei"), ("a.jsonl", 1, 0, "anew"), *b]


def _stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def test_usage_stream_replaces(spark, tmp_path):
    schema = "file string, epoch int, message_key string, ord bigint, session_id string, model string, day string, input bigint, output bigint, cache_read bigint, cache_create bigint"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda k, o, m, i: ("f", 0, k, o, "s", m, "d", i, 1, 0, 0)

    def run():
        jobs.stream_usage(spark.readStream.schema(schema).json(src), out, str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination()
        sums = jobs.usage_deltas(spark, out).groupBy("model").agg(F.sum("input").alias("i"), F.sum("messages").alias("m"))
        return {r.model: (r.i, r.m) for r in sums.collect() if r.m}

    _stream(spark, src, [row("a", 1, "x", 10), row("a", 2, "x", 12), row("b", 3, "x", 5)], schema)
    assert run() == {"x": (17, 2)}
    _stream(spark, src, [row("a", 9, "y", 20), row("b", 2, "x", 99)], schema)  # a replaced, b late
    assert run() == {"x": (5, 1), "y": (20, 1)}


def test_lifecycle_turns_silent_agents_stalled(spark, tmp_path):
    schema = "session_id string, agent_key string, ts timestamp, ts_ms bigint, finished boolean"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev = lambda a, ms, fin=False: ("s", a, __import__("datetime").datetime.fromtimestamp(ms / 1000, __import__("datetime").timezone.utc), ms, fin)

    def run():
        jobs.stream_lifecycle(spark.readStream.schema(schema).json(src), out, str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination()
        return {(r.agent_key, r.state, r.at) for r in spark.read.parquet(f"{out}/changes").collect()}

    _stream(spark, src, [ev("a", 1_000), ev("b", 2_000, True)], schema)
    run()
    _stream(spark, src, [ev("c", 700_000)], schema)
    got = run()
    assert {("a", "running", 1_000), ("b", "done", 2_000), ("c", "running", 700_000), ("a", "stalled", 601_000)} == got
    _stream(spark, src, [ev("b", 1_500), ev("a", 650_000), ev("c", 900_000, True)], schema)  # b late, a speaks again
    assert run() - got == {("a", "running", 650_000), ("c", "done", 900_000)}


def test_versions_are_compacted_and_old_rows_leave(spark, tmp_path):
    store, schema = str(tmp_path / "s"), "k string, n bigint"
    for b in range(9):
        rows = spark.createDataFrame([("x", b), (f"k{b}", b)], schema)
        versions.write(rows, store, b, ["k"], F.col("n") >= b - 4, compact_every=3)
        versions.write(rows, store, b, ["k"], F.col("n") >= b - 4, compact_every=3)  # a replay
    got = {r.k: r.n for r in versions.current(spark, store, ["k"], schema).collect()}
    assert got == {"x": 8, **{f"k{b}": b for b in range(4, 9)}}
    assert sorted(p.name for p in (tmp_path / "s" / "base").iterdir()) == ["batch=5", "batch=8"]
    before = {r.k: r.n for r in versions.current(spark, store, ["k"], schema, before=8).collect()}
    assert before["x"] == 7 and "k8" not in before


def test_counts_keep_late_rows(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "out")
    stamp = lambda minute: __import__("datetime").datetime(2026, 1, 1, 10, minute)
    schema = "session_id string, ts timestamp"

    def run():
        jobs.stream_counts(spark.readStream.schema(schema).json(src), store, str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination()
        return sorted(r.n for r in jobs.window_counts(spark, store).collect())

    _stream(spark, src, [("a", stamp(50)), ("a", stamp(50))], schema)
    assert run() == [2]
    _stream(spark, src, [("a", stamp(1)), ("a", stamp(50))], schema)
    assert run() == [1, 3]


def test_change_feed(spark, tmp_path):
    schema = "id string, n int"
    src = str(tmp_path / "in")
    seen = []

    def run():
        s = spark.readStream.schema(schema).json(src)
        q = jobs.change_feed(s, ["id"], ["n"], str(tmp_path / "store"), lambda df, b: seen.append({(r.id, r.change) for r in df.collect()}), str(tmp_path / "ck"), {"availableNow": True})
        q.awaitTermination()

    _stream(spark, src, [("a", 1), ("b", 1)], schema)
    run()
    _stream(spark, src, [("a", 2), ("b", 1), ("c", 1)], schema)
    run()
    assert seen == [{("a", "added"), ("b", "added")}, {("a", "changed"), ("c", "added")}]
