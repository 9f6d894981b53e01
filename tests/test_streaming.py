from __future__ import annotations

import datetime as dt

from lumenfold.streaming import streams as T

T0 = dt.datetime(2025, 1, 1)


def log(spark, tmp_path, rows):
    path = str(tmp_path / "log.parquet")
    spark.createDataFrame([(i, u, None if m is None else T0 + dt.timedelta(minutes=m)) for i, u, m in rows], "id long, user long, ts timestamp_ntz").coalesce(1).write.parquet(path)
    return path


def test_repeats_and_undated_rows_are_dropped(spark, scratch, tmp_path):
    path = log(spark, tmp_path, [(1, 1, 0), (1, 1, 0), (2, 1, 5), (3, 2, None)])
    out = T.run_once(T.deduplicated(T.read_stream(spark, path), "id", "ts"), "append", scratch)
    assert sorted(r.id for r in out.collect()) == [1, 2]


def test_windows_agree_with_a_batch(spark, scratch, tmp_path):
    rows = [(i, i % 3, i * 300) for i in range(40)]
    path = log(spark, tmp_path, rows)
    out = T.run_once(T.windowed(T.read_stream(spark, path), "ts", "user"), "complete", scratch)
    want = {}
    for _, u, m in rows:
        k = ((T0 + dt.timedelta(minutes=m)).date(), u)
        want[k] = want.get(k, 0) + 1
    assert {(r.start.date(), r.user): r.events for r in out.collect()} == want


def test_closed_sessions_only(spark, scratch, tmp_path):
    path = log(spark, tmp_path, [(1, 1, 0), (2, 1, 20), (3, 1, 90), (4, 2, 10), (5, 9, 60 * 24 * 5)])
    out = T.run_once(T.sessions(T.read_stream(spark, path), "user", "ts"), "append", scratch)
    assert sorted((r.user, r.events) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_memory_states_over_several_batches_equal_a_replay(spark, scratch, tmp_path):
    from lumenfold.operators import retention as R

    path = str(tmp_path / "log.parquet")
    rows = [(i, i % 3, T0 + dt.timedelta(minutes=i * 700), [1, 3, 2, 4, 3][i % 5]) for i in range(30)]
    schema = "id long, user long, ts timestamp_ntz, g int"
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(path)
    import os
    import time

    files = sorted((f for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: spark.read.parquet(f"{path}/{f}").agg({"id": "min"}).first()[0])
    for n, f in enumerate(files):  # the source takes files in order of their age
        os.utime(f"{path}/{f}", (time.time() - 100 + n * 10,) * 2)
    out = T.run_once(T.memory(T.read_stream(spark, path, files=1), "user", "ts", "g"), "update", scratch, ["key"])
    got = {r.key: r for r in out.collect()}
    log = spark.createDataFrame(rows, schema).selectExpr("id", "user as quiz_item_id", "cast(ts as timestamp) as presented_at", "g as machine_rating", "cast(null as int) as user_grade_override", "cast(null as int) as self_rating")
    want = {r.quiz_item_id: r for r in R.memory_states(log).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert abs(got[k].stability - w.stability) < 1e-9 and abs(got[k].difficulty - w.difficulty) < 1e-9 and (got[k].reps, got[k].lapses) == (w.reps, w.lapses)


def test_children_come_out_once_their_parent_is_there(spark, scratch, tmp_path):
    child, parent = str(tmp_path / "c.parquet"), str(tmp_path / "p.parquet")
    spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", "x")], "id string, ref string").coalesce(1).write.parquet(child)
    spark.createDataFrame([("x",), ("x",), (None,)], "id string").coalesce(1).write.parquet(parent)
    first = T.run_once(T.redelivered(T.read_stream(spark, child), "ref", T.read_stream(spark, parent), "id"), "append", scratch)
    assert sorted(r.id for r in first.collect()) == ["a", "d"]
    spark.createDataFrame([("y",)], "id string").coalesce(1).write.mode("append").parquet(parent)
    later = T.run_once(T.redelivered(T.read_stream(spark, child), "ref", T.read_stream(spark, parent), "id"), "append", scratch)
    assert sorted(r.id for r in later.collect()) == ["a", "b", "d"]


def test_late_rows_go_to_a_table_of_their_own(spark, scratch, tmp_path):
    import os
    import time

    path = str(tmp_path / "log.parquet")
    for n, rows in enumerate(([(1, 0), (2, 500)], [(3, 100), (4, 490), (5, None)])):
        spark.createDataFrame([(i, None if m is None else T0 + dt.timedelta(minutes=m)) for i, m in rows], "id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if n == 0 and f.endswith(".parquet"):
                os.utime(f"{path}/{f}", (time.time() - 100,) * 2)
    on_time, late = T.split_late(T.read_stream(spark, path, files=1), "ts", 3600, scratch)
    assert sorted(r.id for r in on_time.collect()) == [1, 2, 4, 5] and [r.id for r in late.collect()] == [3]
