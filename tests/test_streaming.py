import datetime as dt

from sheetwise.streaming import jobs, pairs


def test_states_and_batches(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    rows = [(1, "queued", at(0)), (1, "running", at(1)), (1, "completed", at(1)), (2, "queued", at(2))]
    spark.createDataFrame(rows, jobs.EVENTS).write.parquet(str(tmp_path / "in"))
    events = jobs.job_events(spark, str(tmp_path / "in"))
    q = jobs.latest_states(events).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["job_id"], r["status"]) for r in spark.table("states").collect()} == {(1, "completed"), (2, "queued")}
    q = jobs.run_pairs(events, lambda b: b.select("job_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_ended_jobs_leave_the_store_after_their_time(spark, tmp_path):
    at = lambda h, m: dt.datetime(2026, 1, 1, h, m)
    for rows in ([(1, "queued", at(0, 0)), (1, "completed", at(0, 1)), (2, "running", at(0, 2))], [(3, "queued", at(3, 0)), (1, "queued", at(0, 0))], [(4, "queued", at(3, 1))]):
        spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = jobs.job_events(spark, str(tmp_path / "in"), files_per_batch=1)
    q = jobs.stored(events, ttl_seconds=600).writeStream.outputMode("append").format("memory").queryName("store").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["job_id"], r["status"], r["gone"]) for r in spark.table("store").collect()}
    assert got == {(1, "completed", False), (1, "completed", True), (2, "running", False), (3, "queued", False), (4, "queued", False)}


def documents(spark, rows):
    """(pair_id, page, side, minute, texts) as page documents."""
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    data = []
    for pair, page, side, minute, texts in rows:
        spans = [(k, [(c,) for c in t], [20.0, 100.0 + 20 * k, 20.0 + 6 * len(t), 110.0 + 20 * k]) for k, t in enumerate(texts)]
        data.append((pair, page, side, at(minute), 800.0, 600.0, [(k, 0, [(0, [s])]) for k, s in enumerate(spans)]))
    return spark.createDataFrame(data, pairs.DOCUMENTS)


def test_pages_meet_across_sides(spark, tmp_path):
    batches = [
        [("A", 1, "ref", 0, ["x"]), ("A", 2, "ref", 1, ["x"]), ("A", 1, "cand", 2, ["x"])],
        [("A", 3, "cand", 20, ["x"]), ("A", 2, "cand", 25, ["x"]), ("B", 1, "ref", 26, ["x"])],
        [("C", 1, "ref", 200, ["x"]), ("C", 1, "cand", 205, ["x"])],
        [("C", 2, "ref", 206, ["x"]), ("C", 2, "cand", 206, ["x"])],
        [("B", 1, "cand", 30, ["late"]), ("D", 1, "ref", 210, ["x"])],
    ]
    for k, b in enumerate(batches):
        documents(spark, b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pairs.arriving(spark, str(tmp_path / "in"), files_per_batch=1)
    q = pairs.paired_pages(stream).select("pair_id", "page", "state").writeStream.outputMode("append").format("memory").queryName("met").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r["pair_id"], r["page"], r["state"]) for r in spark.table("met").collect()}
    # Pages meet early and late; lone sides come out when the watermark has passed their time, and D still waits.
    assert got == {("A", 1, "paired"), ("A", 2, "paired"), ("A", 3, "cand_only"), ("B", 1, "ref_only"), ("C", 1, "paired"), ("C", 2, "paired")}


def test_pairs_are_compared_and_one_may_fail(spark, tmp_path):
    texts = ["ALPHA ONE", "BETA TWO", "GAMMA THREE", "DELTA FOUR", "EPSILON FIVE"]
    rows = [(p, 1, s, 0, texts if (p, s) != ("B", "cand") else texts[:-1]) for p in "ABX" for s in ("ref", "cand")]
    documents(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = []

    def compare(batch):
        names = {r["pair_id"] for r in batch.select("pair_id").distinct().collect()}
        calls.append(names)
        if "X" in names:
            raise ArithmeticError("broken pair")
        return pairs.compared(batch)

    stream = pairs.arriving(spark, str(tmp_path / "in"))
    q = pairs.run_compared(pairs.paired_pages(stream), str(tmp_path / "out"), str(tmp_path / "cp"), compare)
    assert q.awaitTermination(300) and q.exception() is None
    got = {r["pair_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: r["status"] == "error" for k, r in got.items()} == {"A": False, "B": False, "X": True} and calls == [{"A", "B", "X"}, {"A"}, {"B"}, {"X"}]
    assert got["X"]["error"] == "broken pair" and (got["A"]["total_defects"], got["A"]["status"]) == (0, "clean") and got["B"]["total_defects"] >= 1


def test_job_states_by_pair(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
        source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")

        def arrive(rows):
            spark.createDataFrame(rows, pairs.STATES).coalesce(1).write.mode("append").parquet(source)

        def run():
            events = spark.readStream.schema(pairs.STATES).option("maxFilesPerTrigger", 1).parquet(source)
            q = pairs.job_states(events, ttl_seconds=600).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            assert q.awaitTermination(300) and q.exception() is None

        arrive([(1, None, 2, None, None, at(0)), (2, None, 1, None, None, at(0))])
        arrive([(1, "p", None, "error", "damaged", at(1))])
        run()
        arrive([(1, "q", None, "clean", None, at(2)), (1, "p", None, "clean", None, at(2))])  # after a restart; p has ended already
        arrive([(3, None, 1, None, None, at(200))])
        arrive([(3, None, 1, None, None, at(201))])
        run()
        got = {(r["job_id"], r["status"], r["pairs"], r["done"], r["errors"], r["gone"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == {(1, "queued", 2, 0, 0, False), (2, "queued", 1, 0, 0, False), (1, "running", 2, 1, 1, False), (1, "completed", 2, 2, 1, False), (1, "completed", 2, 2, 1, True), (3, "queued", 1, 0, 0, False)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
