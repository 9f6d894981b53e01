from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import identity as I
from lumenfold.functions import privacy as P
from lumenfold.functions import scheduler as S
from lumenfold.functions import spotter as W
from lumenfold.operators import citations as C
from lumenfold.operators import coverage as V
from lumenfold.operators import linking as L
from lumenfold.operators import suggest as U
from lumenfold.operators import sync as Y
from lumenfold.operators import telemetry as T
from lumenfold.sources import exchange as X


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Example.com:80//a//b/?b=2&utm_source=x&a=1#top", "https://example.com/a/b?a=1&b=2"),
        ("https://youtube.com/watch?v=1&si=z", "https://youtube.com/watch?v=1"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:8443/x/", "https://example.com:8443/x"),
        ("ftp://example.com/x", None),
        ("not a url", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, I.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    ("raw", "want"), [("https://dx.doi.org/10.1000/XYZ).", "10.1000/xyz"), ("doi: 10.1000/a", "10.1000/a"), ("see 10.12345/q;", "10.12345/q"), ("10.1/x", None), ("10.1000/.", None), ("", None), (None, None)]
)
def test_normal_doi(spark, raw, want):
    assert one(spark, I.normal_doi(F.col("d")), d=raw) == want


def test_fingerprint_folds_alike_in_both_engines(spark):
    assert one(spark, I.fingerprint(F.col("t")), t=" A  b\n") == one(spark, I.fingerprint(F.col("t")), t="Ａ b")


def test_redaction_in_order_with_valid_cards_only(spark):
    text, n = P.redact(F.col("t"))
    row = spark.createDataFrame([("mail a.b@c.org token: xyz 4111 1111 1111 1111 and 4111 1111 1111 1112",)], "t string").select(text.alias("x"), *[c.alias(k) for k, c in n.items()]).first()
    assert row["x"] == "mail [email] [token] [card] and 4111 1111 1111 1112"
    assert (row["email"], row["bearer_token"], row["card_number"]) == (1, 1, 1)


@pytest.mark.parametrize(("url", "rule"), [("https://intranet/x", "internal_host"), ("https://a.paypal.com/", "service"), ("https://sso.corp.example.com/", "label"), ("https://shop.com/checkout/1", "path"), ("https://u:p@site.com/", "credentials"), ("https://site.com/a", None)])
def test_classify_url(spark, url, rule):
    assert one(spark, P.classify_url(F.col("u")), u=url) == rule


def test_recall_is_nine_tenths_after_one_stability(spark):
    assert abs(spark.range(1).select(S.recall(F.lit(7.0), F.lit(7.0))).first()[0] - 0.9) < 1e-9


def test_merge_does_not_depend_on_order(spark):
    rows = [("s", "web", None, "b", True), ("s", "paper", "u", None, False), ("s", "web", "t", "a", None)]
    schema = "id string, kind string, canonical_url string, title string, is_private boolean"
    extra = {"doi": "string", "content_hash": "string", "authors": "array<string>", "published_at": "timestamp", "first_seen_at": "timestamp", "deleted_at": "timestamp"}
    frame = lambda r: spark.createDataFrame(r, schema).withColumns({k: F.lit(None).cast(v) for k, v in extra.items()})
    a, b = Y.merged_sources(frame(rows)).first(), Y.merged_sources(frame(rows[::-1])).first()
    assert a == b and a["kind"] == "paper" and a["is_private"] and a["title"] == "a" and a["canonical_url"] == "t"


def test_seal_needs_its_key(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "k string, n int")
    key = Y.derive_key("secret", b"salt", 10)
    assert sorted(Y.opened(Y.sealed(df, "t", key), "k string, n int", key).collect(), key=str) == sorted(df.collect(), key=str)
    with pytest.raises(Exception):  # noqa: B017
        Y.opened(Y.sealed(df, "t", key), "k string, n int", Y.derive_key("other", b"salt", 10)).collect()


def test_slate_caps_the_largest_cluster_and_keeps_a_place(spark):
    rows = [("coverage_gap", f"c{i}", f"c{i}", 1.0, 1.0 - i / 100, 0.8, 0.0) for i in range(12)] + [("bridge", "a|b", "zz", 0.1, 0.1, 0.1, 0.0), ("citation", "d1", None, 0.5, 0.2, 0.4, 0.0)]
    cand = spark.createDataFrame(rows, "kind string, target string, concept_id string, evidence double, gap double, reach double, redundancy double")
    cluster = spark.createDataFrame([(f"c{i}", "c0", 12) for i in range(12)] + [("zz", "zz", 1)], "concept_id string, cluster_id string, size long")
    got = U.slate(cand, spark.createDataFrame([("c1",)], "target string"), cluster, 10).collect()
    assert [r.target for r in got if r.serendipity] in (["a|b"], ["c6"], ["c5"])
    assert sum(r.target.startswith("c") and not r.serendipity for r in got) == 4 and all(r.target != "c1" for r in got)


def test_rollup_is_idempotent_and_counts_contacts_once(spark):
    m = spark.createDataFrame([("k", "x", True), ("k", "x", False), ("k2", "x", None), ("k", None, True)], "chunk_id string, concept_id string, is_primary boolean")
    c = spark.createDataFrame([("k", "v"), ("k2", "v"), ("k2", "v")], "id string, document_version_id string")
    v = spark.createDataFrame([("v", "s")], "id string, source_id string")
    day = dt.datetime(2025, 1, 1)
    e = spark.createDataFrame([("e1", "s", day, "skim"), ("e2", "s", day + dt.timedelta(days=3), "apply"), ("e2", "s", day + dt.timedelta(days=3), "apply")], "id string, source_id string, occurred_at timestamp, engagement string")
    r = V.rollup(m, c, v, e, spark.createDataFrame([], "source_id string")).collect()
    assert len(r) == 1 and (r[0].distinct_sources, r[0].primary_sources, r[0].contact_count, r[0].temporal_spread_days, r[0].max_engagement) == (1, 1, 2, 3, "apply")


def test_telemetry_rules_in_order(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(1, 1000, 0.9, 600, 400, 0), (2, 60000, 0.0, 600, 400, None), (3, 9_000_000, 0.9, 9000, 400, 0), (4, 90_000, 0.9, 60, 400, 0), (5, 90_000, 0.9, 120, 400, 0), (6, 20_000, 0.3, 120, 400, 0), (7, 90_000, None, 120, 400, 2)]
    df = spark.createDataFrame([(i, t, t + dt.timedelta(seconds=el), a, s, w, r) for i, a, s, el, w, r in rows], "i int, started_at timestamp, ended_at timestamp, active_ms long, max_scroll_pct double, word_count long, scroll_reversals int")
    got = {r.i: (r.reject, r.engagement) for r in T.engagement(T.assess(df)).collect()}
    assert got == {1: ("too_short", None), 2: ("no_scroll", None), 3: ("too_long", None), 4: ("beyond_wall_clock", None), 5: (None, "read"), 6: (None, "skim"), 7: (None, "skim")}


def test_similar_labels_against_brute_force(spark):
    labels = ["deep learning models", "learning model", "deep models", "garden kiln", "gardens kiln", "kiln", "", None, "model learning"]
    df = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(labels)], "id string, label string")
    pairs, member = L.similar_labels(df, 0.5)
    cls = {r.concept_id: r.class_id for r in member.collect()}
    assert cls["c8"] == cls["c1"] == "c1" and cls["c4"] == cls["c3"] == "c3" and "c6" not in cls
    assert {(r.a, r.b) for r in pairs.collect()} == {("c0", "c1"), ("c0", "c2"), ("c3", "c5")}


MENTION = "id string, chunk_id string, start_char long, end_char long, surface_form string, concept_id string, confidence double, is_primary boolean"


def test_greedy_span_matching_and_evaluation(spark):
    gold = spark.createDataFrame([("g1", "k", 0, 5, "a", "x", 1.0, True), ("g2", "k", 4, 9, "b", "y", 1.0, False), ("g3", "q", 0, 2, "c", "z", 1.0, False), ("g4", "q", 5, 9, "d", None, 1.0, False), ("g5", "q", 20, 25, "e", "w", 1.0, True), ("g6", "q", 40, 45, "f", None, 1.0, None)], MENTION)
    pred = spark.createDataFrame([("p1", "k", 3, 6, "a", "x", 1.0, True), ("p2", "k", 8, 9, "b", "n", 1.0, False), ("p3", "k", 20, 30, "u", "n", 1.0, False), ("p4", "q", 6, 7, "d", "v", 0.6, False), ("p5", "q", 20, 21, "e", "w", 0.9, False), ("p6", "q", 41, 42, "f", "v", 0.5, False)], MENTION)
    assert {(r.g_id, r.p_id) for r in L.match_spans(gold, pred).collect()} == {("g1", "p1"), ("g2", "p2"), ("g4", "p4"), ("g5", "p5"), ("g6", "p6")}
    j = L.judged(gold, pred)
    assert {r.g_id: r.kind for r in j.collect()} == {"g1": "correct", "g2": "wrong_concept", "g3": "not_spotted", "g4": "spurious_link", "g5": "wrong_primary", "g6": "correct_nil"}
    e = L.evaluation(j).first()
    assert (e.linkable, e.tp, e.fp, e.fn, e.nil_total, e.nil_correct, e.missed_by_spotter) == (4, 2, 2, 2, 2, 1, 1) and e.precision == 0.5 and e.primary_accuracy == 0.5
    assert L.evaluation(L.judged(gold.filter("false"), pred)).first().f1 == 0.0
    st = L.stability(j, L.judged(gold, pred, 0.7)).first()
    assert (st.comparable, st.stable) == (5, 5)  # two right, and g2, g3, g5 alike; g4 is an error in one run only


def test_candidates_are_exact_or_contain_one_another(spark):
    concept = spark.createDataFrame([("c2", "Spaced  Repetition", ["SRS"]), ("c1", "repetition", None), ("c3", "ﬁeld", ["x"]), (None, "none", None), ("c4", None, None)], "id string, label string, aliases array<string>")
    forms = spark.createDataFrame([("spaced repetition systems",), ("SPACED repetition",), ("petit",), ("field",), ("zzz",), (None,), ("",), ("ax",)], "form string")
    got = {r.form: (r.concept_id, r.confidence) for r in L.link(forms, L.names(concept)).collect()}
    assert got == {"spaced repetition systems": ("c1", 0.7), "spaced repetition": ("c2", 1.0), "petit": ("c1", 0.7), "field": ("c3", 1.0), "zzz": (None, 1.0), "ax": ("c3", 0.7)}
    assert [r.concepts for r in L.candidates(forms, L.names(concept)).filter("form = 'spaced repetition systems'").collect()] == [["c1", "c2"]]


def test_candidates_of_all_lengths_are_joined_by_shuffles(spark, scratch):
    """Pieces of a string are many more than the planner thinks: none of their joins goes through the driver."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("ab ") for _ in range(r.choice((1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 20, 40)))).strip()
    labels = [(f"c{i:03}", word(), [word(), "aé" * r.randrange(8)]) for i in range(60)]
    texts, limit = {word() for _ in range(300)} | {"éa" * k for k in range(9)}, 3
    concept, forms = scratch.put(spark.createDataFrame(labels, "id string, label string, aliases array<string>")), scratch.put(spark.createDataFrame([(t,) for t in texts], "form string"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = L.candidates(forms, L.names(concept), limit)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {x.form: (x.concepts, x.exact) for x in found.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin [_g#" in plan and "BroadcastHashJoin [_g#" not in plan
    plain = lambda t: " ".join(t.split())
    names = {(plain(t), i) for i, label, more in labels for t in (label, *more) if plain(t)}
    want = {}
    for t in {plain(t) for t in texts} - {""}:
        same, part = {i for n, i in names if n == t}, {i for n, i in names if n in t or t in n}
        if same or part:
            want[t] = (sorted(same or part)[:limit], bool(same))
    assert got == want and len({e for _, e in got.values()}) == 2


def test_only_hashes_of_pieces_are_sent_through_the_driver(spark, scratch, monkeypatch):
    """However many pieces there are; that several have one hash changes no row."""
    monkeypatch.setattr(L, "BUCKETS", 64, raising=False)
    texts = [f"{i * 7919:05x} {i * 104729:06x}" for i in range(1, 400)]
    side = lambda c, rows: scratch.put(spark.createDataFrame([(t,) for t in rows], f"{c} string"))
    inner, outer = side("a", [t[i % 5 : 5 + i % 9] for i, t in enumerate(texts)]), side("b", texts)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = L.contained(inner, "a", outer, "b")
        got = {(r.a, r.b) for r in found.collect()}
        plan, sent = [found._jdf.queryExecution().executedPlan()], []
        while plan:
            node = plan.pop()
            if node.nodeName() == "BroadcastExchange":
                sent.append(node.metrics().apply("numOutputRows").value())
            plan += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert got == {(a, b) for a in {r.a for r in inner.collect()} for b in texts if a in b} and len(got) > 399
    assert max(sent) <= 64


def test_spots_linked_to_concepts_or_local_ones(spark):
    concept = spark.createDataFrame([("c1", "kiln", None)], "id string, label string, aliases array<string>")
    spots = spark.createDataFrame([("k", 0, 4, "Kiln"), ("k", 0, 4, "kiln"), ("k", 9, 17, "New Term"), ("p", 0, 4, "kiln"), ("gone", 0, 4, "kiln"), ("k", 20, 21, "!")], "chunk_id string, start_char long, end_char long, surface_form string")
    chunks = spark.createDataFrame([("k", "kiln and kiln", None, 1), ("p", "kiln", "On a KILN", 2)], "chunk_id string, text string, title string, start_char int")
    targets = spark.createDataFrame([("local:new-term", "c9")], "concept_id string, target_id string")
    got = {(r.chunk_id, r.concept_id, r.start_char): (r.confidence, r.is_primary) for r in L.link_spots(spots, chunks, L.names(concept), targets).collect()}
    assert got == {("k", "c1", 0): (1.0, True), ("k", "c9", 9): (1.0, False), ("p", "c1", 0): (1.0, True)}


def test_overrides(spark):
    m = spark.createDataFrame([("k", "a", 0, 3, 0.9, False), ("k", "b", 5, 8, 0.8, True), ("k", "b", 5, 8, 0.8, True), ("k", "c", 9, 12, 0.7, False), ("q", "c", 1, 2, 0.6, False), ("q", "c", 4, 6, 0.9, False)], "chunk_id string, concept_id string, start_char long, end_char long, confidence double, is_primary boolean")
    pair = "chunk_id string, concept_id string"
    chunks = spark.createDataFrame([("k", 100, "the Old Kiln stands"), ("q", 0, "x")], "chunk_id string, start_char long, text string")
    concept = spark.createDataFrame([("n", "old kiln"), ("o", "absent")], "id string, label string")
    targets = spark.createDataFrame([("c", "b")], "concept_id string, target_id string")
    out = L.apply_overrides(m, spark.createDataFrame([("k", "a")], pair), spark.createDataFrame([("k", "n"), ("q", "o"), ("k", "b"), ("z", "n"), ("k", "zz")], pair), targets, chunks, concept)
    assert {(r.chunk_id, r.concept_id, r.start_char, r.end_char, r.confidence) for r in out.collect()} == {("k", "b", 5, 8, 0.8), ("k", "n", 104, 112, 1.0), ("q", "o", 0, 1, 1.0), ("q", "b", 1, 2, 0.6)}


def test_decisions_answer_only_what_was_asked(spark):
    ask = spark.createDataFrame([("1", "k", 0, 2, "a", None, None, None), ("2", "k", 5, 7, "a", None, None, None), ("3", "k", 9, 11, "b", None, None, None)], MENTION)
    say = spark.createDataFrame([("x", "k", 0, 2, "a", "c1", 1.7, True), ("y", "k", 5, 7, "a", "zz", 0.9, True)], MENTION)
    found = spark.createDataFrame([("a", ["c1", "c2"]), ("b", ["c3"])], "form string, concepts array<string>")
    assert {r.id: (r.concept_id, r.confidence, r.is_primary) for r in L.reconcile(ask, say, found).collect()} == {"1": ("c1", 1.0, True), "2": (None, 0.0, False), "3": (None, 0.0, False)}


def test_decisions_answer_by_place_and_never_by_a_null_key(spark):
    kind = "id string, chunk_id string, surface_form string, start_char long, end_char long"
    ask = spark.createDataFrame([("1", "k", "Ab", 0, 2), ("2", "k", "Ab", 5, 7), ("3", None, "Ab", 0, 2), ("4", "k", None, 0, 2), ("5", "k", "cd", 0, 2), ("6", "l", "Ab", 0, 2)], kind)
    say = spark.createDataFrame([("a", "k", "Ab", 9, 11, "c2", 0.5, True), ("b", "k", "Ab", 1, 3, "c1", None, None), ("c", None, "Ab", 0, 2, "c1", 1.0, True), ("d", "k", None, 0, 2, "c1", 1.0, True), ("e", "k", "cd", 0, 2, None, 0.9, True), ("f", "k", "Ab", 12, 14, "c1", 1.0, True)], kind + ", concept_id string, confidence double, is_primary boolean")
    found = spark.createDataFrame([("ab", ["c1", "c2"], True)], "form string, concepts array<string>, exact boolean")
    none = (None, 0.0, False)
    got = [(r.id, (r.concept_id, r.confidence, r.is_primary)) for r in L.reconcile(ask, say, found).collect()]
    assert sorted(got) == [("1", ("c1", 0.0, False)), ("2", ("c2", 0.5, True)), ("3", none), ("4", none), ("5", none), ("6", none)]


def ranked_spots(spark, text, keywords=()):
    return [(text[r.start_char : r.end_char], r.signal) for r in W.spot(spark.createDataFrame([("k", text)], "k string, t string"), "k", "t", keywords).orderBy("start_char").collect()]


def test_spots_by_signal(spark):
    text = "The ATP cycle is a pathway. Later Marie Curie met Marie Curie and Marie Curie again; ATPs matter near Bank of England."
    got = ranked_spots(spark, text, ("curie  again",))
    forms = [s.lower() for s, _ in got]
    assert len(forms) == len(set(forms))
    signals = dict(got)
    assert signals["Marie Curie"] == "recurring" and signals["ATP"] == "acronym" and signals["The ATP cycle"] == "definition" and signals["Curie again"] == "keyword" and signals["Bank of"] == "proper_noun" and signals["England"] == "proper_noun"
    assert ranked_spots(spark, "") == [] and "is" not in forms and "pathway. later" not in forms


def test_the_strongest_and_longest_forms_stay_within_the_limit(spark):
    word = lambda i: "".join(chr(97 + int(x)) for x in f"{i:03}") * 3
    got = ranked_spots(spark, "We met Ada Lovelace. " + ". ".join(word(i) for i in range(200)) + ". XML")
    assert len(got) == 60 and ("XML", "acronym") in got and ("Ada Lovelace", "proper_noun") in got


def test_every_stage_of_linking_all_chunks_counts(spark, tmp_path):
    """Whole texts are spotted, so places are those of the text; the linker counts in what redaction leaves."""
    from lumenfold.plans import linking as Q

    names = [f"Mor{chr(97 + i // 10)}{chr(97 + i % 10)}wick" for i in range(60)]
    texts = {
        "v1": "Ask kiln@kiln.org of old pottery, by pottery@pottery.org. ", "v2": "Old pottery, by pottery. ", "v3": "Old pottery, by pottery. ",
        "v4": "lid is a thing; we met " + ", ".join(names) + ", Ada, Ada, Ada, DNA",
    }
    stamp = "cast(null as timestamp)"
    source = spark.createDataFrame([("open", False), ("shut", True)], "id string, is_private boolean")
    nulls = {"kind": "string", "canonical_url": "string", "doi": "string", "content_hash": "string", "title": "string", "authors": "array<string>"}
    source.select("*", *[F.lit(None).cast(t).alias(c) for c, t in nulls.items()], *[F.expr(stamp).alias(c) for c in ("published_at", "first_seen_at", "deleted_at")]).write.parquet(f"{tmp_path}/reading_source.parquet")
    spark.createDataFrame([(v, "shut" if v == "v3" else "open", "Front. " + t) for v, t in texts.items()], "id string, source_id string, text string").write.parquet(f"{tmp_path}/document_version.parquet")
    spark.createDataFrame([("k" + v, v, 7, 7 + len(t)) for v, t in texts.items()], "id string, document_version_id string, start_char long, end_char long").write.parquet(f"{tmp_path}/chunk.parquet")
    spark.createDataFrame([("c1", "pottery", None)], "id string, label string, aliases array<string>").write.parquet(f"{tmp_path}/concept.parquet")
    spark.createDataFrame([("local:dna", "c2", "user_linked")], "from_concept string, to_concept string, relation string").write.parquet(f"{tmp_path}/edge.parquet")
    got = Q.link_all(spark, str(tmp_path)).collect()
    assert {(r.chunk_id, r.surface_form, r.start_char, r.end_char): (r.confidence, r.is_primary) for r in got if r.concept_id == "c1" and r.confidence == 1.0} == {("kv1", "pottery", 32, 39): (1.0, False), ("kv2", "pottery", 11, 18): (1.0, True)}
    # A definition, a name that recurs and an acronym come before names; of these the first of one length stay.
    assert {r.concept_id for r in got if r.chunk_id == "kv4"} == {"local:lid", "local:ada", "c2", *("local:" + n.lower() for n in names[:57])}
    assert {r.chunk_id for r in got} == {"kv1", "kv2", "kv4"}


def test_local_keys_fold_compatible_forms(spark):
    assert one(spark, I.local_key(F.col("a")), a="ＡＢ ﬁne") == one(spark, I.local_key(F.col("a")), a="ab FINE!") == "local:ab-fine"
    assert one(spark, I.local_key(F.col("a")), a="…!") is None


def test_grades_of_three_pass_and_ungraded_reviews_count(spark):
    from lumenfold.operators import retention as R

    rows = [(1, 7, 2, None, 0.5), (2, 7, 3, None, 0.5), (3, 7, None, None, 0.5), (4, 7, 1, 4, None), (5, 8, None, None, None), (6, 8, None, None, 0.1), (7, 8, None, None, 0.1), (8, 8, None, None, 0.1)]
    r = spark.createDataFrame(rows, "id long, quiz_item_id long, machine_rating int, user_grade_override int, predicted_recall double")
    c = R.calibration(r).first()
    assert (c.scored, c.excluded, c.brier, c.bias) == (2, 2, 0.25, 0.0)
    assert [(x.bin, x.n, x.actual) for x in R.calibration_bins(r).collect()] == [(5, 2, 0.5)]
    assert {x.quiz_item_id: (x.reviews, x.pass_rate) for x in R.anomalous(r).collect()} == {8: (4, 0.0)}


def test_captures_meet_by_any_key(spark, scratch):
    from lumenfold.operators import capture as K

    t = dt.datetime(2025, 1, 1)
    rows = [("a", "web", "https://x.example/1", None, None, t, False), ("b", "web", "https://x.example/1?utm_source=q", "10.1234/z", None, t, None), ("c", "pdf", None, "doi:10.1234/Z", "h", t, True), ("d", "note", None, None, "h", t, False), ("e", "note", None, None, None, t, None), ("e", "note", None, None, None, t, None), (None, "web", None, None, None, t, None)]
    got = K.captured(spark.createDataFrame(rows, "id string, kind string, canonical_url string, doi string, content_hash string, first_seen_at timestamp, is_private boolean"), scratch).collect()
    assert sorted((r.kind, r.ids, r.is_private) for r in got) == [("note", 1, False), ("paper", 4, True)]


def test_drafts_that_cite_another_text_are_not_grounded(spark):
    from lumenfold.operators import items as Q

    text = "A first sentence that is long enough to count. Another one follows here as well."
    version = spark.createDataFrame([("v", text), ("w", "x" * 200)], "id string, text string")
    found = spark.createDataFrame([("c", "k", "v", "s1", 0, len(text), 1), ("c", "k2", "w", "s2", 0, 200, 2)], "concept_id string, chunk_id string, document_version_id string, source_id string, start_char long, end_char long, rank int")
    d = Q.drafts(found, version, spark.createDataFrame([("c", "FIRST sentence")], "id string, label string"))
    got = {r.kind: r for r in d.collect()}
    assert set(got) == {"free_recall", "cloze", "synthesis"} and "A _____ that" in got["cloze"].prompt
    assert {r.grounded for r in Q.grounded(d, version).collect()} == {True}
    for change in (lambda p: p.withField("document_version_id", F.lit("w")), lambda p: p.withField("document_version_id", F.lit("none")), lambda p: p.withField("end", F.lit(9_999).cast("long"))):
        assert {r.grounded for r in Q.grounded(d.withColumn("points", F.transform("points", change)), version).collect()} == {False}


def test_cooccurrence_of_a_source_cut_into_blocks(spark, monkeypatch):
    from itertools import combinations

    from lumenfold.operators import graph as G

    monkeypatch.setattr(G, "BLOCK", 4)
    rows = [("s1", f"c{i:02}") for i in range(17)] + [("s2", "c01"), ("s2", "c05"), ("s3", "c09")]
    got = {(r.a, r.b): r.shared for r in G.cooccurrence(spark.createDataFrame(rows, "source_id string, concept_id string")).collect()}
    want = {p: 1 for p in combinations([f"c{i:02}" for i in range(17)], 2)} | {("c01", "c05"): 2}
    assert got == want


def test_groups_by_contraction(spark, scratch):
    from lumenfold.operators import graph as G

    names = [f"n{(i * 37) % 60:02}" for i in range(60)]
    links = list(zip(names, names[1:30])) + [("x", "y"), ("z", "z"), (None, "x"), ("q", None)]
    got = {r.v: r.l for r in G.groups(spark.createDataFrame(links, "a string, b string"), scratch).collect()}
    assert {got[n] for n in names[:30]} == {min(names[:30])} and got["x"] == got["y"] == "x" and got["z"] == "z" and "q" not in got
    assert G.groups(spark.createDataFrame([], "a string, b string"), scratch).count() == 0


def test_vectors_put_blobs_and_blocks(spark, scratch, monkeypatch):
    from lumenfold.operators import vectors as E

    s = "chunk_id string, document_version_id string, model_id string, dim int, vector array<float>, computed_at timestamp"
    t = dt.datetime(2025, 1, 1)
    old = spark.createDataFrame([("a", "v", "m", 2, [1.0, 0.0], t), ("b", "v", "m", 2, [0.0, 1.0], t)], s)
    new = spark.createDataFrame([("a", "v", "m", 2, [0.5, 0.5], t), ("c", "v", "m", 3, [0.5, 0.5], t), ("d", "w", "m", 2, None, t)], s)
    assert {r.chunk_id: r.vector for r in E.put(old, new).collect()} == {"a": [0.5, 0.5], "b": [0.0, 1.0]}
    back = old.select("chunk_id", E.from_blob(E.to_blob(F.col("vector")), F.lit(2)).alias("v")).collect()
    assert {r.chunk_id: r.v for r in back} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    with pytest.raises(Exception, match="another length"):
        old.select(E.from_blob(E.to_blob(F.col("vector")), F.lit(3))).collect()
    monkeypatch.setattr(E, "BLOCK", 6)
    import numpy as np

    u = np.random.default_rng(1).normal(size=(12, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    store = spark.createDataFrame([(f"k{i:02}", f"v{i // 2}", x.tolist()) for i, x in enumerate(u)], "chunk_id string, document_version_id string, u array<double>")
    sims = u @ u.T
    for r in E.novelty(store, scratch).collect():
        i = int(r.document_version_id[1:])
        best = max(sims[a, b] for a in (2 * i, 2 * i + 1) for b in range(12) if b // 2 != i)
        assert abs(r.novelty - (1 - max(0, best))) < 1e-9 and r.comparable
    near = {}
    for r in E.top_k_each(store, store.filter("chunk_id < 'k03'"), scratch, k=4, min_score=-1.0).orderBy("rank").collect():
        near.setdefault(r.query_id, []).append(r.chunk_id)
    assert near == {f"k{i:02}": [f"k{j:02}" for j in sorted(set(range(12)) - {i}, key=lambda j: -sims[i, j])[:4]] for i in range(3)}
    empty = store.filter("false")
    assert E.novelty(empty, scratch).count() == 0 and E.top_k_each(store, empty, scratch).count() == 0


def test_a_pull_rewrites_known_sources_and_defers_the_rest(spark):
    src = "id string, kind string, canonical_url string, doi string, content_hash string, title string, authors array<string>, published_at timestamp, first_seen_at timestamp, is_private boolean, deleted_at timestamp"
    row = lambda i, url=None, doi=None: (i, "web", url, doi, None, None, None, None, None, False, None)
    local = {"source": spark.createDataFrame([row("s1", "u1"), row("s2", None, "d2")], src), "event": spark.createDataFrame([("e1", "s1")], "id string, source_id string")}
    theirs = {"source": spark.createDataFrame([row("t1", "u1"), row("t3", "u3"), row("s2", None, "d2")], src), "event": spark.createDataFrame([("e1", "s1"), ("e2", "t1"), ("e3", "t3"), ("e4", "gone"), ("e5", None)], "id string, source_id string")}
    sources, events = Y.pulled(theirs, local)
    assert sorted(r.id for r in sources.collect()) == ["s1", "s2", "t3"]
    assert {r.id: (r.source_id, r.state) for r in events.collect()} == {"e1": ("s1", "merged"), "e2": ("s1", "applied"), "e3": ("t3", "applied"), "e4": ("gone", "deferred"), "e5": (None, "applied")}
    batches = spark.createDataFrame([("me", 1, "t", "x"), ("you", 1, "t", "y")], "device string, version int, table string, payload string")
    assert [r.payload for r in Y.received(batches, "me").collect()] == ["y"]
    with pytest.raises(Exception, match="another version"):
        Y.received(batches.withColumn("version", F.lit(9)), "me").collect()


def test_older_tables_get_the_columns_added_since(spark):
    from lumenfold import schema

    df = spark.createDataFrame([("a",)], "id string")
    assert schema.upgraded(df, "mention", 1).columns == ["id", "model_id"] and schema.upgraded(df, "mention", 3).columns == ["id"]
    with pytest.raises(ValueError):
        schema.upgraded(df, "mention", 99)


def test_ports_can_be_replaced(spark, scratch, tmp_path):
    from lumenfold.functions import ports as O

    concept = spark.createDataFrame([("c1", "kiln", None)], "id string, label string, aliases array<string>")
    edge = spark.createDataFrame([("c1", "c0", "subclass_of", "vocabulary")], "from_concept string, to_concept string, relation string, provenance string")
    ask = spark.createDataFrame([("1", "k", 0, 4, "kiln", None, None, None), ("2", "k", 5, 7, "zz", None, None, None)], MENTION)

    class Liar:
        model_id = "liar"

        def decide(self, requests, found):
            return requests.drop("concept_id", "confidence", "is_primary").withColumns({"concept_id": F.lit("made up"), "confidence": F.lit(1.0), "is_primary": F.lit(True)})

    v = O.TableVocabulary(concept, edge, scratch)
    assert {r.id: r.concept_id for r in O.linked(O.RuleLinker(), ask, v).collect()} == {"1": "c1", "2": None}
    assert {r.concept_id for r in O.linked(Liar(), ask, v).collect()} == {None}
    assert [r.to_concept for r in v.hierarchy(concept.select("id")).collect()] == ["c0"]
    cites = O.TableScholarGraph(spark.createDataFrame([("a", "b"), ("c", "b")], "from_doi string, to_doi string"))
    assert cites.cited_by(spark.createDataFrame([("b",)], "doi string")).count() == 2 and cites.references(spark.createDataFrame([("a",)], "doi string")).count() == 1
    relay = O.FolderRelay(str(tmp_path / "relay"))
    relay.push(spark.range(2), 1)
    relay.push(spark.range(3), 2)
    assert relay.pull(spark, 1).count() == 3 and O.Pbkdf2(10).derive("p", b"s") != O.Pbkdf2(10).derive("q", b"s")
    assert O.HashEmbedder().embed(spark.createDataFrame([("k", "some words")], "k string, t string"), "k", "t").count() > 0


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.5), ("b", ["x"], None)], "id string, tags array<string>, w double")
    X.export_jsonl({"t": (df, ["id"])}, str(tmp_path / "out"))
    back, diff = X.import_jsonl(spark, str(tmp_path / "out"), {"t": df.schema})
    assert sorted(back["t"].collect()) == sorted(df.collect()) and diff.count() == 0
    with pytest.raises(ValueError):
        X.import_jsonl(spark, str(tmp_path / "out"), {"u": df.schema})


def test_works_keep_the_latest_known_value(spark):
    t = dt.datetime(2025, 1, 1)
    s = "doi string, title string, published_year int, open_access boolean, cited_by_count long, source_id string, fetched_at timestamp, recorded_at timestamp, deleted_at timestamp"
    rows = [("10.1234/a", "old", 2001, True, 5, None, t, t, None), ("DOI:10.1234/A", None, None, False, 7, "s", t, t + dt.timedelta(days=1), None), ("10.1234/b", "x", None, None, None, None, t, t, t), (None, "y", None, None, None, None, t, t, None)]
    got = C.works(spark.createDataFrame(rows, s)).collect()
    assert [(r.doi, r.title, r.open_access, r.cited_by_count, r.source_id) for r in got] == [("10.1234/a", "old", True, 7, "s")]


def test_spots_cover_every_chunk_and_language(spark, monkeypatch):
    from lumenfold.plans import text as X

    word = lambda i: "".join(chr(97 + int(x)) for x in f"{i:03}") * 3
    texts = {"a": ". ".join(word(i) for i in range(200)), "b": "Die Stadt heisst Neu Ulm. Sie liegt im Donautal"}
    ends = [(0, 600), (600, 1200), (1200, len(texts["a"]))]
    tables = {
        "document_version": spark.createDataFrame([("a", texts["a"], "en"), ("b", texts["b"], None)], "id string, text string, lang string"),
        "chunk": spark.createDataFrame([("a", x, y) for x, y in ends] + [("b", 0, len(texts["b"]))], "document_version_id string, start_char long, end_char long"),
    }
    monkeypatch.setattr(X, "table", lambda s, d, name: tables[name])
    got = X.spots(spark, "").collect()
    assert all(texts[r.key][r.start_char : r.end_char] == r.surface_form for r in got)
    assert sum(r.key == "a" for r in got) > 120 and any(r.key == "b" for r in got)
