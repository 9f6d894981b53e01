from __future__ import annotations

from lumenfold.operators import references as R

T = "2025-01-0{} 00:00:00"
CHILD = "id string, ref string, recorded_at timestamp_ntz, child_table string, key string"
PARENT = "id string, recorded_at timestamp_ntz, deleted_at timestamp_ntz"


def frames(spark, child, parent):
    import datetime as dt

    at = lambda n: None if n is None else dt.datetime(2025, 1, n)
    c = spark.createDataFrame([(a, b, at(n), "clash", "clash") for a, b, n in child], CHILD)
    p = spark.createDataFrame([(a, at(n), at(d)) for a, n, d in parent], PARENT)
    return R.references(c, "child", "id", "ref", "s"), R.records(p, "id", "s")


def found(spark, scratch, child, parent):
    refs, recs = frames(spark, child, parent)
    return {(r.child_key, r.parent_key): r.reason for r in R.orphans(refs, R.ledger(R.deltas(refs, recs)), scratch).collect()}


def test_reasons_nulls_and_repeats(spark, scratch):
    child = [("a", "gone", 3), ("b", "none", 3), ("c", "late", 3), ("d", "ok", 3), ("d", "ok", 3), ("e", None, 3), (None, "none", 3), ("f", "late", None), ("g", "late", 6), ("b", "none", 3)]
    parent = [("gone", 1, 2), ("gone", 2, 2), ("late", 5, None), ("late", 7, None), ("ok", 1, None), ("ok", 2, 3), (None, 1, None)]
    assert found(spark, scratch, child, parent) == {("a", "gone"): "deleted", ("b", "none"): "missing", ("c", "late"): "late", (None, "none"): "missing"}


def test_empty_tables(spark, scratch):
    assert found(spark, scratch, [], []) == {}
    assert found(spark, scratch, [("a", "x", 1)], []) == {("a", "x"): "missing"}


def test_hot_keys_take_the_broadcast_way_with_the_same_result(spark, scratch, monkeypatch):
    child = [(str(i), "hot" if i % 3 else f"k{i}", 3) for i in range(60)]
    parent = [("k3", 1, None)]
    plain = found(spark, scratch, child, parent)
    monkeypatch.setattr(R, "HOT_ROWS", 5)
    monkeypatch.setattr(R, "HOT_SHARE", 1000)
    assert found(spark, scratch, child, parent) == plain
    assert len(plain) == 59


def test_advancing_a_state_equals_folding_everything(spark):
    refs, recs = frames(spark, [("a", "x", 1), ("b", "y", 2)], [("x", 3, None)])
    more_refs, more_recs = frames(spark, [("c", "x", 4)], [("y", 1, None)])
    step = R.advance(R.ledger(R.deltas(refs, recs)), R.deltas(more_refs, more_recs))
    whole = R.ledger(R.deltas(refs, recs).unionByName(R.deltas(more_refs, more_recs)))
    assert sorted(step.collect(), key=str) == sorted(whole.collect(), key=str)
    undone = R.advance(step, R.deltas(more_refs, more_recs, sign=-1))
    keep = ["space", "key", "live_at", "n_ref", "n_live", "n_dead"]
    assert sorted(undone.select(keep).collect(), key=str) == sorted(R.ledger(R.deltas(refs, recs)).select(keep).collect(), key=str)


def test_times_follow_a_retraction(spark, scratch):
    refs, recs = frames(spark, [("a", "x", 3), ("b", "x", 6)], [("x", 2, None), ("x", 5, None)])
    state = R.ledger(R.deltas(refs, recs))
    assert R.orphans(refs, state, scratch).count() == 0
    _, first = frames(spark, [], [("x", 2, None)])
    R.save(R.advance(state, R.deltas(recs=first, sign=-1)), scratch.base, 1)
    after = R.load(spark, scratch.base, 1)
    assert [(r.child_key, r.reason) for r in R.orphans(refs, after, scratch).collect()] == [("a", "late")]
    _, second = frames(spark, [], [("x", 5, None)])
    gone = R.advance(after, R.deltas(recs=second, sign=-1))
    assert sorted((r.child_key, r.reason) for r in R.orphans(refs, gone, scratch).collect()) == [("a", "missing"), ("b", "missing")]


def test_dois_compare_by_normal_form(spark, scratch):
    c = spark.createDataFrame([("10.1/a", "https://doi.org/10.1234/AbC.", None), ("10.1/a", "no doi", None)], "from_doi string, to_doi string, recorded_at timestamp_ntz")
    p = spark.createDataFrame([("DOI: 10.1234/abc", None, None), (None, None, None)], "doi string, recorded_at timestamp_ntz, deleted_at timestamp_ntz")
    refs, recs = R.references(c, "citation", "from_doi", "to_doi", "work", doi=True), R.records(p, "doi", "work", doi=True)
    assert [r.parent_key for r in R.orphans(refs, R.ledger(R.deltas(refs, recs)), scratch).collect()] == ["no doi"]
