"""Readers, generators and streams on small files."""

import datetime as dt
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from assayer import registry
from assayer.operators import answers as q
from assayer.operators import groups as grp
from assayer.operators import sketches
from assayer.plans import databases, generation, streams
from assayer.session import configure, settle, shared_dir
from assayer.sources import files, generators, sinks
from assayer.sources.tables import SCHEMAS, Tables
from assayer.streaming import jobs


def test_gold_csv_cells(spark, tmp_path):
    (tmp_path / "local1.csv").write_text('id,name\n1,"a, b"\n2,\n')
    (tmp_path / "local2_a.csv").write_text("n\n5\n")
    (tmp_path / "local2_b.csv").write_text('n,m\n"x\ny",7\n')
    tasks = spark.createDataFrame([("local1",), ("local2",), ("local2",)], "task STRING")
    cells, shapes, names = files.read_gold_csv(spark, str(tmp_path), tasks)
    got = {(r.task, r.gold_ix, r.row_ix, r.col_ix): r.val for r in cells.collect()}
    assert got == {
        ("local1", 0, 0, 0): "1", ("local1", 0, 0, 1): "a, b", ("local1", 0, 1, 0): "2", ("local1", 0, 1, 1): "",
        ("local2", 0, 0, 0): "5", ("local2", 1, 0, 0): "x\ny", ("local2", 1, 0, 1): "7",
    }
    assert {(r.task, r.gold_ix): (r.n_rows, r.n_cols) for r in shapes.collect()} == {
        ("local1", 0): (2, 2), ("local2", 0): (1, 1), ("local2", 1): (1, 2)
    }
    assert names.where("task = 'local1'").count() == 2


def test_gold_csv_of_any_width_and_suffix(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(70))
    for name, text in {"wide": f"{wide}\n{wide}\n", "t2": "n\n1\n", "t2_abc": "n\n2\n", "t2_B": "n\n3\n", "db_12": "n\n4\n",
                       "t22": "n\n5\n", "other": "n\n6\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    tasks = spark.createDataFrame([("wide",), ("t2",), ("db_12",), ("t22",)], "task STRING")
    cells, shapes, _ = files.read_gold_csv(spark, str(tmp_path), tasks)
    assert {(r.task, r.gold_ix): r.val for r in cells.where("task <> 'wide'").collect()} == {
        ("t2", 0): "1", ("t2", 1): "3", ("t2", 2): "2", ("db_12", 0): "4", ("t22", 0): "5"
    }
    assert shapes.where("task = 'wide'").first().n_cols == 70 and cells.where("val = 'c69'").count() == 1


def test_gold_csv_refuses_rows_beyond_every_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,m\n1,2,3\n")
    with pytest.raises(Exception, match="wider than every header"):
        files.read_gold_csv(spark, str(tmp_path), spark.createDataFrame([("a",)], "task STRING"))[0].collect()


@pytest.mark.parametrize("rows", [40, 0])
def test_event_streams_read_folders_of_files(spark, tmp_path, rows):
    table = spark.range(rows).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts",
        "id % 3 AS user_id", "'click' AS event_type", "1.0D AS value", "'' AS props",
    )
    table.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    tables = Tables(configure(spark), str(tmp_path))
    counts = streams.st_tumbling(tables)
    assert counts.agg(F.sum("n")).first()[0] == (rows or None)
    assert streams.st_session(tables).count() == (15 if rows else 0)  # those closed a day before the last event


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_episode_logs_and_resume(spark, tmp_path):
    lines = [json.dumps({"task": f"t{i}", "seed": 1, "pass": i % 2 == 0, "turns": i}) for i in range(4)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:2]) + "\n\n")
    (tmp_path / "b.jsonl").write_text(lines[2] + "\n{broken\n" + lines[3])
    log = files.read_episodes(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
    assert log.groupBy().agg(F.count("task"), F.count("_corrupt_record"), F.count_if("pass")).first()[:] == (4, 1, 2)
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(5)], "task STRING")
    assert {(r.task, r.seed) for r in sinks.todo(tasks, [1, 2], log).collect()} == {("t4", 1)} | {(f"t{i}", 2) for i in range(5)}


@pytest.mark.parametrize("cap", [3, 1500])
def test_bounded_results_keep_their_flag(spark, cap):
    rows = [(k, i) for k, n in ((1, 2), (2, cap), (3, cap + 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k INT, i INT")
    cut = {r.k: (r.n, r.o) for r in sinks.bounded(df, ["k"], ["i"], cap, True).groupBy("k").agg(
        F.count("i").alias("n"), F.bool_or("overflow").alias("o")).collect()}
    assert cut == {1: (2, False), 2: (cap, False), 3: (cap, True)}
    kept = sinks.bounded(df, ["k"], ["i"], cap, False).where("k = 3").collect()
    assert [(r.i, r.overflow) for r in kept] == [(None, True)]


SHOP = {
    "n": "SELECT snapshot, count(*) AS n FROM orders WHERE status = 'paid' GROUP BY ALL",
    "gap": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY snapshot, customer_id ORDER BY order_date, id) AS rn FROM orders
      WHERE status = 'paid') SELECT a.snapshot, count(*) AS n FROM r a JOIN r b ON b.snapshot = a.snapshot
      AND b.customer_id = a.customer_id AND b.rn = 2 WHERE a.rn = 1 AND b.order_date - a.order_date <= 30 GROUP BY ALL""",
}


def test_generated_databases_answer_the_tasks(spark):
    seeds = spark.createDataFrame([(0,), (101,), (202,), (303,)], "snapshot INT")
    db = generators.generate(seeds, "shop")
    con = duckdb.connect()
    for name, df in db.items():
        con.register(name, df.toArrow())
    sizes = con.execute("SELECT snapshot, count(*) n FROM orders GROUP BY ALL").fetchall()
    assert len(sizes) == 4 and all(150 <= n <= 260 for _, n in sizes)
    assert con.execute("SELECT count(*) FROM customers WHERE country IS NULL").fetchone()[0] > 0
    paid = q.status_counts(db).where("status = 'paid'").select("snapshot", "n").collect()
    assert sorted(tuple(r) for r in paid) == sorted(con.execute(SHOP["n"]).fetchall())
    gaps = q.repeat_within(db, (2,), (30,)).where("status = 'paid'").select("snapshot", "n").collect()
    assert sorted(tuple(r) for r in gaps) == sorted(con.execute(SHOP["gap"]).fetchall())
    hr = generators.generate(seeds, "hr")
    assert {r.name for r in q.tree_headcount(hr).collect()} == {"Engineering", "Sales"}
    assert hr["employees"].where("manager_id >= id").count() == 0
    events = generators.generate(seeds, "events")
    assert events["events"].where("(kind = 'purchase') <> (value IS NOT NULL)").count() == 0
    assert q.silent_users(events).agg(F.sum("n")).first()[0] > 0


@pytest.fixture
def slices(spark, tmp_path):
    rows = [(i, i * 600, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id BIGINT, s BIGINT, user_id BIGINT").select(
        "event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id",
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
    )
    folder = str(tmp_path / "in")
    return df, folder, [df.where(F.col("event_id").between(a, a + 99)) for a in (0, 100, 200)]


def test_stream_in_slices_equals_batch(spark, slices, tmp_path):
    df, folder, parts = slices
    out = str(tmp_path / "out")
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"
    for part in parts:  # the stream stops and goes on from its checkpoint
        part.write.mode("append").parquet(folder)
        stream = jobs.window_counts(jobs.timed(jobs.file_stream(spark, folder, schema)), "1 hour")
        jobs.run_available(stream, "update", out)
    rows = jobs.written(spark, out, stream).groupBy("start").agg(F.max_by("n", "batch").alias("n"))
    batch = df.groupBy(F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("n"))
    assert {r.n for r in rows.collect()} == {r.n for r in batch.collect()} and rows.count() == batch.count()


def test_rest_state_is_carried_between_batches(spark, tmp_path):
    folder, out = str(tmp_path / "g"), str(tmp_path / "o")
    flat = [True, True, False, True, True, True]
    for a in (0, 2, 4):
        rows = [(t, s, flat[s] or t == 1) for t in (0, 1) for s in (a, a + 1)]
        spark.createDataFrame(rows, "task BIGINT, step INT, flat BOOLEAN").write.mode("append").parquet(folder)
        stream = jobs.rest_streaks(jobs.file_stream(spark, folder, "task BIGINT, step INT, flat BOOLEAN"))
        jobs.run_available(stream, "append", out)
    got = {(r.task, r.step): r.streak for r in jobs.written(spark, out, stream).collect()}
    assert [got[(0, s)] for s in range(6)] == [1, 2, 0, 1, 2, 3] and [got[(1, s)] for s in range(6)] == [1, 2, 3, 4, 5, 6]


def test_late_rows_are_counted(spark, tmp_path):
    log = str(tmp_path / "log")
    batches = [[(1, "2026-01-10 00:00:00")], [(2, "2026-01-01 00:00:00")],
               [(3, "2026-01-01 00:00:00"), (4, "2026-01-08 23:59:59"), (5, "2026-01-09 00:00:01"), (1, "2026-01-10 00:00:00")]]
    for rows in batches:
        frame = spark.createDataFrame(rows, "event_id BIGINT, ts STRING").selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts")
        frame.coalesce(1).write.mode("append").parquet(log)
    stream = jobs.file_stream(spark, log, "event_id BIGINT, ts TIMESTAMP_NTZ", files_per_batch=1)
    once = jobs.resent_once(stream, ["event_id"], "ts", "1 day")
    folder = jobs.run_available(once, "append", str(tmp_path / "out"))
    counts = {r.batch: (r.read, r.late) for r in jobs.row_counts(spark, folder).collect() if r.read}
    assert counts == {0: (1, 0), 1: (1, 0), 2: (4, 2)}
    assert sorted(r.event_id for r in jobs.written(spark, folder, once).collect()) == [1, 2, 5]


@pytest.mark.parametrize("limit", [1000, 0])
def test_bounded_results_by_rank_and_by_stretches(spark, monkeypatch, limit):
    monkeypatch.setattr(sinks, "RANK_LIMIT", limit)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 3), (2, 4), (3, 50)) for i in range(n)], "k INT, v INT")
    cut = sorted((r.k, r.v, r.overflow) for r in sinks.bounded(rows, ["k"], [F.col("v").desc()], 4, True).collect())
    assert cut == [(1, v, False) for v in range(3)] + [(2, v, False) for v in range(4)] + [(3, v, True) for v in range(46, 50)]
    error = [(r.k, r.v, r.overflow) for r in sinks.bounded(rows, ["k"], [F.col("v").desc()], 4, False).where("k = 3").collect()]
    assert error == [(3, None, True)]


def test_sketches_of_days_merge_for_any_period(spark):
    rows = spark.range(60_000).selectExpr("id % 3 AS k", "id % 20 AS day", "id % 2 AS half", "id * 7919 % 30000 AS v")
    days = sketches.daily(rows, ["k"], "day", ["v"])
    assert days.count() == 60
    merged = sketches.merged(days.selectExpr("*", "day % 2 AS half"), ["k"], ["half"], ["v"]).collect()
    exact = {(r.k, r.half): r.n for r in rows.cube("k", "half").agg(F.count_distinct("v").alias("n")).collect()}
    assert len(merged) == 9
    for r in merged:
        assert abs(r.v - exact[r.k, r.half]) <= 4 * sketches.ERROR * exact[r.k, r.half] + 1


@pytest.mark.parametrize("cuts", [(7,), (3, 4, 20)])
def test_rest_pool_on_a_stream_equals_the_batch_form(spark, tmp_path, cuts):
    rnd = random.Random(len(cuts))
    rows = [(t, s, rnd.random() < 0.7) for s in range(40) for t in range(9) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, "task BIGINT, step INT, flat BOOLEAN")
    want = sorted(map(tuple, grp.rest_pool(df, 2, 5, 4)[0].collect()))
    tasks = df.select("task").distinct()
    pool = jobs.RestPool(tasks, str(tmp_path / "pool"), 2, 5, 4)
    # slices cut steps in two as well
    edges = [0, *sorted(len([r for r in rows if r[1] < cut]) + 2 for cut in cuts), len(rows)]
    slices = [rows[a:b] for a, b in zip(edges, edges[1:]) if b > a]
    for i, part in enumerate(slices):
        frame = spark.createDataFrame(part, "task BIGINT, step INT, flat BOOLEAN")
        pool.take(frame, i)
        if i == 1:  # a batch that is replayed
            pool.take(frame, i)
    assert sorted(map(tuple, pool.finish().collect())) == want and len(want) > 10


def test_rest_pool_reads_a_folder_and_an_empty_one(spark, tmp_path):
    empty = jobs.RestPool(spark.range(3).withColumnRenamed("id", "task"), str(tmp_path / "none"))
    assert empty.finish().count() == 0
    rows = [(t, s, True) for s in range(6) for t in range(2)]
    pool = jobs.RestPool(spark.range(2).withColumnRenamed("id", "task"), str(tmp_path / "p"), 2, 3, 0)
    for a in (0, 4):
        part = [r for r in rows if a <= r[1] < a + 4]
        spark.createDataFrame(part, jobs.PENDING).write.mode("append").parquet(str(tmp_path / "in"))
        pool.run_available(jobs.file_stream(spark, str(tmp_path / "in"), jobs.PENDING))
    got = sorted(map(tuple, pool.finish().collect()))
    assert got == sorted(map(tuple, grp.rest_pool(spark.createDataFrame(rows, jobs.PENDING), 2, 3, 0)[0].collect())) and got


def given(spark, folder, **rows):
    """Tables of the given rows; the others are empty."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


def test_databases_are_made_by_all_cores(spark):
    seeds = spark.range(40).select(F.col("id").alias("snapshot")).coalesce(1)
    db = generators.generate(seeds, "events")
    assert db["users"].rdd.getNumPartitions() > 1
    per = db["events"].groupBy("snapshot").agg(F.count("*").alias("n"))
    plan = per._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # seeds are dealt out, events stay where they are made
    assert per.count() == 40


def test_rows_in_every_snapshot_are_not_planned_as_read(spark, tmp_path):
    customers = [(i, f"c{i}", i % 25, 1.0, "x") for i in range(1000)]
    t = given(spark, tmp_path / "t", customer=customers)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    every = databases.in_every_snapshot(t.customer.select("c_custkey"))
    assert size(every) >= 4 * size(t.customer.select("c_custkey"))
    assert {tuple(r) for r in every.collect()} == {(i, s) for i in range(1000) for s in databases.SNAPSHOTS}


def test_templates_are_judged_one_plan_at_a_time(spark, tmp_path, monkeypatch):
    day = dt.datetime(2024, 5, 1)
    orders = [(i, i % 3, "O", 10.0, day, "1-URGENT") for i in range(40)]
    t = given(spark, tmp_path / "t", customer=[(i, f"c{i}", i, 1.0, "x") for i in range(3)], orders=orders)
    plans = []

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df)

    monkeypatch.setattr(generation, "settle", spy)
    monkeypatch.setattr(generation, "TEMPLATES", [x for x in generation.TEMPLATES if x.name in ("shop_1", "shop_5", "hr_1")])
    found = {r.key.split("|")[0] for r in generation.verdicts(t).collect()}
    assert found == {"shop_1", "shop_5", "hr_1"}
    assert max(plan.count("parquet") for plan in plans) <= 1


def test_distinct_counts_keep_no_sketch_beside_a_value(spark, tmp_path):
    day = dt.datetime(1996, 5, 1)
    lines = [(i, i % 7, i % 3, 1, 1.0, 1.0, 0.0, 0.0, ("A", "B", None)[i % 3 if i else 0], "O", day) for i in range(60)]
    t = given(spark, tmp_path / "t", lineitem=lines + [(99, None, None, 1, 1.0, 1.0, 0.0, 0.0, "C", "O", None)])
    expected = {}
    for line in [*lines, (99, None, None, *[0] * 5, "C")]:
        supp, part = expected.setdefault(line[8], (set(), set()))
        supp.update({line[2]} - {None})
        part.update({line[1]} - {None})
    plan = registry.PLANS["a_count_distinct_approx"](t)
    assert {r.l_returnflag: (r.suppliers, r.parts, r.within) for r in plan.collect()} == {
        k: (len(s), len(p), True) for k, (s, p) in expected.items()
    }
    assert "Expand" not in plan._jdf.queryExecution().optimizedPlan().toString()
