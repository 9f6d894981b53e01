"""Linking surface forms to vocabulary concepts, corrections by the user, merge proposals and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.identity import folded, local_key
from lumenfold.operators import hierarchy as H
from lumenfold.operators.vectors import dot
from lumenfold.session import Scratch

#: Confidence of an exact and of a partial match, the least that links, candidates per form, occurrences that
#: make a concept primary.
EXACT, PARTIAL, NIL_BELOW, CANDIDATES, PRIMARY_FROM = 1.0, 0.7, 0.55, 8, 2
#: Lengths of the pieces on which partial matches are joined; values of a hash that tells which pieces occur at all.
PIECES, BUCKETS = (1, 2, 3, 4, 5, 8, 12), 1 << 20


def fold(c: Column) -> Column:
    """Lower case, NFKC, white space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(folded(c), r"[\s\u00a0]+", " "))


def names(concept: DataFrame) -> DataFrame:
    """Distinct ``(alias, concept_id)`` of all labels and aliases, folded."""
    forms = concept.select(F.col("id").alias("concept_id"), F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("f"))
    return forms.select(fold(F.col("f")).alias("alias"), "concept_id").filter("alias <> '' and concept_id is not null").distinct()


def _head(n: Column) -> Column:
    """The longest of PIECES that a string of ``n`` characters has."""
    return F.coalesce(*[F.when(n >= k, k) for k in reversed(PIECES)])


def contained(inner: DataFrame, a: str, outer: DataFrame, b: str) -> DataFrame:
    """Rows of ``inner`` and ``outer`` where string ``a`` is part of string ``b``: an equi-join on the first characters of
    ``a``, as many as the longest of PIECES, and the pieces of ``b`` of the lengths that are met, then the exact test.

    The planner takes cut rows for as small as those they are cut from and would send them to every executor through the
    driver, so the join is told to shuffle; only one row of lengths and at most BUCKETS hashes are sent.
    """
    left = inner.withColumn("_g", F.left(F.col(a), _head(F.length(a))))
    met = left.select(F.length("_g").alias("k")).distinct().agg(F.collect_set("k").alias("_k"))
    cut = F.transform(F.filter("_k", lambda k: k <= F.length(b)), lambda k: F.transform(F.sequence(F.lit(1), F.length(b) - k + 1), lambda i: F.substring(F.col(b), i, k)))
    bucket = F.pmod(F.xxhash64("_g"), F.lit(BUCKETS)).alias("_h")
    right = outer.crossJoin(F.broadcast(met)).withColumn("_g", F.explode(F.array_distinct(F.flatten(cut)))).drop("_k").select("*", bucket)
    right = right.join(F.broadcast(left.select(bucket).distinct()), "_h", "left_semi").drop("_h")
    return left.hint("merge").join(right.hint("merge"), "_g").filter(F.col(b).contains(F.col(a))).drop("_g")


def _smallest(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """``(key, concepts)``: the ``limit`` smallest of the distinct concepts of each key, in order."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("concept_id"))).filter(F.col("n") <= limit)
    return first.groupBy(key).agg(F.array_sort(F.collect_list("concept_id")).alias("concepts"))


def folded_forms(forms: DataFrame) -> DataFrame:
    """Distinct folded ``form``; each spelling is folded once, as a count keeps the planner from moving that before the groups."""
    spelt = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    return spelt.select(fold(F.when(F.col("n") > 0, F.col("form"))).alias("form")).filter("form <> ''").distinct()


def candidates(forms: DataFrame, name: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """``(form, concepts, exact)`` per distinct folded form with a match: the concepts of that alias, or else those with an
    alias that contains the form or is part of it; the ``limit`` smallest ids.

    The smallest of a form are among the smallest of its aliases, so aliases are matched without their concepts.
    """
    known = _smallest(name, "alias", limit)
    f = folded_forms(forms).join(known.hint("merge"), F.col("form") == F.col("alias"), "left")
    exact = f.filter("alias is not null").select("form", "concepts", F.lit(True).alias("exact"))
    rest, alias = f.filter("alias is null").select("form"), known.select("alias")
    pairs = contained(alias, "alias", rest, "form").select("form", "alias").unionByName(contained(rest, "form", alias, "alias").select("form", "alias"))
    fuzzy = pairs.join(known.hint("merge"), "alias").select("form", F.explode("concepts").alias("concept_id")).distinct()
    return exact.unionByName(_smallest(fuzzy, "form", limit).withColumn("exact", F.lit(False)))


def link(forms: DataFrame, name: DataFrame) -> DataFrame:
    """``(form, concept_id, confidence)`` per distinct folded form: the first of its candidates, or no concept, surely."""
    f = folded_forms(forms)
    found = candidates(forms, name)
    sure = F.when(F.col("concepts").isNull() | F.col("exact"), EXACT).otherwise(PARTIAL)
    return f.join(found, "form", "left").select("form", F.col("concepts")[0].alias("concept_id"), sure.alias("confidence"))


def occurrences(text: Column, form: Column) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, form, F.lit("")))) / F.length(form))


def spelt_concepts(spots: DataFrame, name: DataFrame, targets: DataFrame) -> DataFrame:
    """``(surface_form, form, found, confidence, concept_id)`` of each spelling that names a concept, once for each.

    A form without a concept of enough confidence becomes a local concept named by the form; merged concepts are followed
    to their ``targets``.
    """
    spelt = spots.groupBy("surface_form").agg(F.count(F.lit(1)).alias("n"))
    once = F.when(F.col("n") > 0, F.col("surface_form"))  # as in folded_forms
    linked = link(spelt.select(F.col("surface_form").alias("form")), name).withColumn("found", F.col("concept_id").isNotNull())
    known = F.when(F.col("confidence") >= NIL_BELOW, F.col("concept_id"))
    said = spelt.select("surface_form", fold(once).alias("form"), local_key(once).alias("local")).join(linked, "form").withColumn("concept_id", F.coalesce(known, "local")).filter("concept_id is not null")
    return said.join(targets.select("concept_id", "target_id"), "concept_id", "left").select("surface_form", "form", "found", "confidence", F.coalesce("target_id", "concept_id").alias("concept_id"))


def link_spots(spots: DataFrame, chunks: DataFrame, name: DataFrame, targets: DataFrame) -> DataFrame:
    """Mentions ``(chunk_id, concept_id, start_char, end_char, surface_form, confidence, is_primary)`` of the given spots.

    ``chunks`` has ``(chunk_id, text, title)``; chunks of private sources are left out by the caller.  Spellings are linked
    by ``spelt_concepts``; a concept is primary where its form is in the title or twice in the chunk; one span names a
    concept once.  All that depends on the spelling alone is found once for each, so spots are shuffled by spelling and by
    chunk only.
    """
    said = spelt_concepts(spots, name, targets)
    texts = chunks.select("chunk_id", fold(F.col("text")).alias("text"), fold(F.col("title")).alias("title"))
    primary = F.col("found") & (F.coalesce(F.col("title").contains(F.col("form")), F.lit(False)) | (occurrences(F.col("text"), F.col("form")) >= PRIMARY_FROM))
    out = spots.join(said, "surface_form").join(texts, "chunk_id").withColumn("is_primary", F.coalesce(primary, F.lit(False)))
    best = F.max(F.struct("confidence", "is_primary", "surface_form"))
    return out.groupBy("chunk_id", "concept_id", "start_char", "end_char").agg(best.alias("b")).select("chunk_id", "concept_id", "start_char", "end_char", "b.surface_form", "b.confidence", "b.is_primary")


def local_mentions(spots: DataFrame, chunk_ids: DataFrame, name: DataFrame, concept: DataFrame) -> DataFrame:
    """``(concept_id, surface_form)`` of the spots in the given chunks that make a local concept not known yet.

    These spellings are few as a rule, so a spot is shuffled only where the hash of its spelling is among theirs (at most
    BUCKETS hashes are sent); then it is joined with the spelling and the chunk.  No text is read.
    """
    none = spots.sparkSession.createDataFrame([], "concept_id string, target_id string")
    made = spelt_concepts(spots, name, none).filter("concept_id like 'local:%'").select("surface_form", "concept_id")
    new = made.join(concept.select(F.col("id").alias("concept_id")).distinct().hint("merge"), "concept_id", "left_anti")
    bucket = F.pmod(F.xxhash64("surface_form"), F.lit(BUCKETS)).alias("_h")
    rest = spots.select("*", bucket).join(F.broadcast(new.select(bucket).distinct()), "_h", "left_semi").drop("_h")
    hits = rest.join(new.hint("merge"), "surface_form").select("chunk_id", "concept_id", "surface_form").distinct()
    return hits.join(chunk_ids.hint("merge"), "chunk_id", "left_semi").select("concept_id", "surface_form")


def new_locals(mentions: DataFrame, concept: DataFrame) -> DataFrame:
    """Local concepts ``(id, scheme, label)`` that linking created; those that exist are left as they are."""
    made = mentions.filter("concept_id like 'local:%'").groupBy(F.col("concept_id").alias("id")).agg(F.min("surface_form").alias("label"))
    return made.join(concept.select("id").distinct(), "id", "left_anti").select("id", F.lit("local").alias("scheme"), "label")


def reconcile(requests: DataFrame, decisions: DataFrame, found: DataFrame) -> DataFrame:
    """Decisions of a model beside the mentions it was asked about: ``requests`` with ``concept_id, confidence, is_primary``.

    The n-th decision on a form of a chunk answers its n-th mention; a concept that was not among the form's candidates
    counts as none with confidence 0; confidences are cut to 0..1.
    """
    side = lambda rows, asked, *own: rows.select("chunk_id", "surface_form", "start_char", "end_char", "id", F.lit(asked).alias("asked"), *own)
    none = [F.lit(None).cast(decisions.schema[c].dataType).alias(c) for c in ("concept_id", "confidence", "is_primary")]
    given = side(decisions.filter("chunk_id is not null and surface_form is not null"), False, "concept_id", "confidence", "is_primary")
    # Both sides are numbered in one order and meet in their group, so they are shuffled once.
    w = Window.partitionBy("chunk_id", "surface_form").orderBy("start_char", "end_char", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.when(F.col("asked"), F.count_if(F.col("asked")).over(w)).otherwise(F.count_if(~F.col("asked")).over(w))
    numbered = side(requests, True, *none).unionByName(given).withColumn("n", nth)
    said = F.max(F.when(~F.col("asked"), F.struct("concept_id", "confidence", "is_primary")))
    both = numbered.groupBy("chunk_id", "surface_form", "n").agg(F.max(F.when(F.col("asked"), F.struct("id"))).alias("q"), said.alias("s")).filter("q is not null")
    # Only an answer that names a concept is looked up; the others are spread by keys that no form can have.
    form = F.when(F.col("s.concept_id").isNotNull(), fold(F.col("surface_form"))).otherwise(F.concat(F.lit(" "), F.pmod(F.xxhash64("q.id"), F.lit(BUCKETS))))
    looked = both.select(F.col("q.id").alias("id"), form.alias("form"), F.col("s.concept_id").alias("said"), F.col("s.confidence").alias("c"), F.col("s.is_primary").alias("p")).join(found.select("form", "concepts"), "form", "left")
    ok = F.coalesce(F.array_contains("concepts", F.col("said")), F.lit(False))
    return looked.select("id", F.when(ok, F.col("said")).alias("concept_id"), F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0))))).otherwise(0.0).alias("confidence"), (ok & F.coalesce("p", F.lit(False))).alias("is_primary"))


def ancestors(edge: DataFrame, start: DataFrame, scratch: Scratch, depth: int = 4) -> DataFrame:
    """Vocabulary edges ``(from_concept, to_concept, relation)`` met on the way up from the ids in ``start``, level by level."""
    up = edge.filter("provenance = 'vocabulary' and from_concept is not null and to_concept is not null").select("from_concept", "to_concept", "relation").distinct()
    seen = frontier = scratch.put(start.select(F.col("id").alias("from_concept")).filter("from_concept is not null").distinct())
    found = None
    for _ in range(depth):
        step = scratch.put(up.join(frontier, "from_concept", "left_semi"))
        found = step if found is None else found.unionByName(step)
        frontier = scratch.put(step.select(F.col("to_concept").alias("from_concept")).distinct().join(seen, "from_concept", "left_anti"))
        seen = seen.unionByName(frontier)
    return found


def resolve_merges(merges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """``(concept_id, target_id)``: where a chain of merges ends; a chain into a cycle ends at the cycle's smallest id."""
    tree = H.parents(merges.withColumn("_forest", F.lit("merge")), a, b, "_forest")
    state, _, lost = H.sizes_upward(tree, scratch)
    out = state.filter("anc is null and parent is not null").select(F.col("node").alias("concept_id"), F.col("root").alias("target_id"))
    return out.unionByName(H.cycles(state, scratch).select(F.col("node").alias("concept_id"), F.col("cycle_id").alias("target_id"))) if lost else out


def apply_overrides(mention: DataFrame, rejected: DataFrame, added: DataFrame, targets: DataFrame, chunks: DataFrame, concept: DataFrame) -> DataFrame:
    """Mentions ``(chunk_id, concept_id, start_char, end_char, confidence, is_primary)`` after the user's corrections.

    Rejected (chunk, concept) pairs go; added pairs that have no mention yet come in as primary with confidence 1, at the
    place of the concept's label in the chunk or else with one character at its start (unknown chunks and concepts are
    ignored); merged concepts are renamed, and where the chunk has a mention of the target already, or had another one
    renamed before, the later row goes.
    """
    m = mention.select("chunk_id", "concept_id", "start_char", "end_char", "confidence", "is_primary").distinct().join(rejected.select("chunk_id", "concept_id").distinct(), ["chunk_id", "concept_id"], "left_anti")
    fresh = added.select("chunk_id", "concept_id").distinct().join(m.select("chunk_id", "concept_id").distinct(), ["chunk_id", "concept_id"], "left_anti")
    placed = fresh.join(chunks.select("chunk_id", F.col("start_char").alias("at"), "text"), "chunk_id").join(concept.select(F.col("id").alias("concept_id"), "label"), "concept_id")
    hit = F.position(F.lower("label"), F.lower("text"))
    forced = placed.select(
        "chunk_id", "concept_id", (F.col("at") + F.greatest(hit - 1, F.lit(0))).cast("long").alias("start_char"), (F.col("at") + F.when(hit > 0, hit - 1 + F.length("label")).otherwise(1)).cast("long").alias("end_char"),
        F.lit(1.0).alias("confidence"), F.lit(True).alias("is_primary"),
    )
    both = m.unionByName(forced).join(targets.select("concept_id", "target_id"), "concept_id", "left")
    moved = both.filter("target_id is not null and target_id <> concept_id").withColumn("concept_id", F.col("target_id"))
    stay = both.filter("target_id is null or target_id = concept_id")
    w = Window.partitionBy("chunk_id", "concept_id").orderBy("start_char", "end_char", F.desc_nulls_last("confidence"), F.desc_nulls_last("is_primary"))
    first = moved.join(stay.select("chunk_id", "concept_id").distinct(), ["chunk_id", "concept_id"], "left_anti").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return stay.unionByName(first).drop("target_id")


def label_tokens(c: Column) -> Column:
    """Sorted set of a label's words with plural endings dropped."""
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " ")
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    stem = lambda w: F.when(w.rlike("^[a-z0-9_]+ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("^[a-z0-9_]+es$"), F.regexp_replace(w, "es$", "")).when(w.rlike("^[a-z0-9_]+s$"), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.array_sort(F.array_distinct(F.transform(words, stem)))


def similar_labels(concept: DataFrame, at_least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Pairs of label classes ``(a, b, similarity)`` by Jaccard similarity of their words, and ``(concept_id, class_id)``.

    Concepts of equal words are one class, named by its smallest id.  A pair at the threshold must share one of the
    rarest words of either side (prefix filter), so only those words are joined on.
    """
    t = concept.select(F.col("id").alias("concept_id"), label_tokens(F.col("label")).alias("t")).filter(F.size("t") > 0).groupBy("concept_id").agg(F.min("t").alias("t"))
    classes = t.groupBy("t").agg(F.min("concept_id").alias("class_id"))
    df = classes.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    ranked = classes.select("class_id", F.explode("t").alias("w")).join(df, "w").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("r"))
    head = F.slice("r", F.lit(1), F.size("r") - F.ceil(F.size("r") * at_least).cast("int") + 1)
    prefix = ranked.select("class_id", F.explode(F.transform(head, lambda s: s["w"])).alias("w"))
    pairs = prefix.select(F.col("class_id").alias("a"), "w").join(prefix.select(F.col("class_id").alias("b"), "w"), "w").filter("a < b").select("a", "b").distinct()
    side = lambda c: classes.select(F.col("class_id").alias(c), F.col("t").alias("t" + c))
    both = F.size(F.array_intersect("ta", "tb"))
    sim = both / (F.size("ta") + F.size("tb") - both)
    found = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", sim).filter(F.col("similarity") >= at_least).select("a", "b", "similarity")
    return found, t.join(classes, "t").select("concept_id", "class_id")


def proposed_merges(concept: DataFrame, centroid: DataFrame, blocked: DataFrame, min_label: float = 0.5, min_centroid: float = 0.6, auto: float = 0.9) -> DataFrame:
    """``(from_id, to_id, label_similarity, centroid_similarity, auto_applicable)``: local concepts whose labels and
    centroids are similar and which the user did not keep apart; the later id merges into the earlier.

    Concepts of equal label words are one class: each member is compared with the class's smallest id, and classes by
    these, so a label that a third of all concepts bear gives one row per concept.
    """
    pairs, classes = similar_labels(concept.filter("scheme = 'local'"), min_label)
    same = classes.filter("concept_id <> class_id").select(F.col("class_id").alias("a"), F.col("concept_id").alias("b"), F.lit(1.0).alias("similarity"))
    side = lambda c: centroid.select(F.col("concept_id").alias(c), F.col("u").alias("u" + c))
    both = pairs.unionByName(same).join(side("a"), "a").join(side("b"), "b").withColumn("centroid_similarity", dot(F.col("ua"), F.col("ub"))).filter(F.col("centroid_similarity") >= min_centroid)
    apart = blocked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ok = both.join(apart, ["a", "b"], "left_anti")
    return ok.select(F.col("b").alias("from_id"), F.col("a").alias("to_id"), F.col("similarity").alias("label_similarity"), "centroid_similarity", ((F.col("similarity") >= auto) & (F.col("centroid_similarity") >= auto)).alias("auto_applicable"))


def match_spans(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One-to-one matches ``(g_id, p_id)`` of overlapping spans of a chunk: each gold span in order takes the first
    prediction that is still free.  The overlaps of one chunk are folded in one row."""
    side = lambda d, p: d.select("chunk_id", *[F.col(c).alias(p + c) for c in ("start_char", "end_char", "id")]).distinct()
    pairs = side(gold, "g_").join(side(predicted, "p_"), "chunk_id").filter("g_start_char < p_end_char and p_start_char < g_end_char")
    order = F.array_sort(F.collect_list(F.struct("g_start_char", "g_end_char", "g_id", "p_start_char", "p_end_char", "p_id")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("g"), none.alias("p"))

    def take(s: Column, x: Column) -> Column:
        free = ~F.array_contains(s["g"], x["g_id"]) & ~F.array_contains(s["p"], x["p_id"])
        more = lambda a, v: F.when(free, F.concat(a, F.array(v))).otherwise(a)
        return F.struct(more(s["g"], x["g_id"]).alias("g"), more(s["p"], x["p_id"]).alias("p"))

    taken = pairs.groupBy("chunk_id").agg(order.alias("o")).select(F.aggregate("o", start, take).alias("t"))
    return taken.select(F.explode(F.arrays_zip("t.g", "t.p")).alias("x")).select(F.col("x.g").alias("g_id"), F.col("x.p").alias("p_id"))


def judged(gold: DataFrame, predicted: DataFrame, min_confidence: float = NIL_BELOW) -> DataFrame:
    """Every gold mention with ``kind``: correct, wrong_primary, wrong_concept, missed_link, not_spotted, spurious_link or
    correct_nil; ``expected`` and ``actual`` are the concepts, or the flag that is wrong."""
    p = predicted.filter("id is not null")
    m = match_spans(gold, p)
    g = gold.select(F.col("id").alias("g_id"), "chunk_id", "start_char", "end_char", "surface_form", F.col("concept_id").alias("expected"), F.coalesce("is_primary", F.lit(False)).alias("g_primary")).dropDuplicates(["g_id"])
    said = p.select(F.col("id").alias("p_id"), F.when(F.col("confidence") >= min_confidence, F.col("concept_id")).alias("actual"), F.coalesce("is_primary", F.lit(False)).alias("p_primary")).dropDuplicates(["p_id"])
    x = g.join(m, "g_id", "left").join(said, "p_id", "left")
    e, a = F.col("expected"), F.col("actual")
    kind = (
        F.when(e.isNull(), F.when(a.isNull(), "correct_nil").otherwise("spurious_link")).when(F.col("p_id").isNull(), "not_spotted").when(a.isNull(), "missed_link").when(a != e, "wrong_concept")
        .when(F.col("g_primary") == F.col("p_primary"), "correct").otherwise("wrong_primary")
    )
    y = x.withColumn("kind", kind)
    shown = F.when(F.col("kind") == "wrong_primary", F.concat(F.lit("primary="), F.col("p_primary").cast("string"))).otherwise(F.col("actual"))
    return y.select("g_id", "chunk_id", "start_char", "end_char", "surface_form", "expected", shown.alias("actual"), "kind")


def evaluation(j: DataFrame) -> DataFrame:
    """Counts and ratios of ``judged`` mentions: a wrong concept is a false positive and a false negative, a wrong primary
    flag is still a true positive, unmatched predictions are ignored, empty ratios are 0."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    x = j.agg(
        F.count("expected").alias("linkable"), n("correct", "wrong_primary").alias("tp"), n("wrong_concept", "spurious_link").alias("fp"), n("not_spotted", "missed_link", "wrong_concept").alias("fn"),
        n("correct_nil", "spurious_link").alias("nil_total"), n("correct_nil").alias("nil_correct"), n("correct").alias("primary_correct"), n("not_spotted").alias("missed_by_spotter"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return x.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("nil_correct"), F.col("nil_total")).alias("nil_accuracy"), ratio(F.col("primary_correct"), F.col("tp")).alias("primary_accuracy"))


def stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(comparable, stable, stability)`` of two runs (``judged``): errors on the same form of the same chunk count as stable
    if both gave the same concept; what both got right is stable."""
    last = lambda j, c: j.filter("kind not in ('correct', 'correct_nil')").groupBy("chunk_id", "surface_form").agg(F.max_by(F.struct("actual"), F.struct("start_char", "end_char", "g_id"))["actual"].alias(c))
    shared = last(before, "a").join(last(after, "b"), ["chunk_id", "surface_form"]).agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same")).withColumn("k", F.lit(1))
    right = lambda j, c: evaluation(j).select(F.col("tp").alias(c), F.lit(1).alias("k"))
    x = shared.join(right(before, "t1"), "k").join(right(after, "t2"), "k").withColumn("agreed", F.least("t1", "t2"))
    return x.select((F.col("errors") + F.col("agreed")).alias("comparable"), (F.col("same") + F.col("agreed")).alias("stable")).withColumn("stability", F.coalesce(F.try_divide("stable", "comparable"), F.lit(0.0)))


def report(e: DataFrame) -> DataFrame:
    """``(n, line)``: an evaluation as text."""
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    lines = [
        F.concat(F.lit("linkable "), F.col("linkable"), F.lit(", without concept "), F.col("nil_total")),
        F.concat(F.lit("precision "), pct("precision"), F.lit(" ("), F.col("tp"), F.lit(" right, "), F.col("fp"), F.lit(" wrong)")),
        F.concat(F.lit("recall "), pct("recall"), F.lit(" ("), F.col("fn"), F.lit(" missed, "), F.col("missed_by_spotter"), F.lit(" not spotted)")),
        F.concat(F.lit("f1 "), pct("f1")), F.concat(F.lit("nil accuracy "), pct("nil_accuracy")), F.concat(F.lit("primary accuracy "), pct("primary_accuracy")),
    ]
    return e.select(F.posexplode(F.array(*lines)).alias("n", "line"))
