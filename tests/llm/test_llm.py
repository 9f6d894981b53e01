from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from oracle import DATA, check
from pyspark.sql import functions as F

from lumenfold.llm import boilerplate as B
from lumenfold.llm import chunks as K
from lumenfold.llm import components as P
from lumenfold.llm import cooccurrence as O
from lumenfold.llm import mixture as M
from lumenfold.llm import mojibake as J
from lumenfold.llm import neighbours as N
from lumenfold.llm import packing as S
from lumenfold.llm import queries
from lumenfold.llm.tokens import n_tokens


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    queries.QUERIES[name](spark, str(DATA)).count()


# components


def groups(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                top(x)
        if a is not None and b is not None:
            lo, hi = sorted((top(a), top(b)))
            up[hi] = lo
    return {x: top(x) for x in up}


def labelled(spark, scratch, pairs):
    df = spark.createDataFrame([(a, b, "clash", 1.0) for a, b in pairs], "x string, y string, id string, v double")
    return {r.id: r.group_id for r in P.components(df, "x", "y", scratch).collect()}


def test_components_of_hub_chain_loops_and_nulls(spark, scratch):
    rng = random.Random(5)
    names = [f"n{i:03}" for i in range(90)]
    rng.shuffle(names)
    pairs = [("hub", f"s{i}") for i in range(25)] + list(zip(names, names[1:])) + [("s3", names[0]), ("self", "self"), ("lone", None), (None, "other"), (None, None), ("b", "a"), ("a", "b"), ("c", "b")]
    assert labelled(spark, scratch, pairs) == groups(pairs)


def test_components_of_nothing_and_of_small_ones_only(spark, scratch):
    assert labelled(spark, scratch, []) == {}
    assert labelled(spark, scratch, [("z", "z")]) == {"z": "z"}
    pairs = [(f"p{i}", f"q{i}") for i in range(30)]
    assert labelled(spark, scratch, pairs) == groups(pairs)


# co-occurrence


def basket_rows(rng):
    rows = [(f"b{rng.randrange(25)}", f"i{min(rng.randrange(12), rng.randrange(12)):02}") for _ in range(240)]
    return rows + [("b1", None), (None, "i01"), ("empty", None), *[("big", f"i{i:02}") for i in range(12)]]


@pytest.mark.parametrize(("shared", "lift", "block"), [(1, None, 4096), (3, 1.1, 4096), (1, None, 5)])
def test_cooccurrence_against_all_pairs(spark, scratch, monkeypatch, shared, lift, block):
    monkeypatch.setattr(O, "BLOCK", block)
    rows = basket_rows(random.Random(1))
    sets = defaultdict(set)
    for b, i in rows:
        if b is not None:
            sets[b] |= {i} - {None}
    n, one, two = len(sets), Counter(), Counter()
    for s in sets.values():
        one.update(s)
        two.update(combinations(sorted(s), 2))
    want = {k: (one[k[0]], one[k[1]], v) for k, v in two.items() if v >= shared and (lift is None or v * n >= lift * one[k[0]] * one[k[1]])}
    df = spark.createDataFrame([(b, i, "clash") for b, i in rows], "basket string, item string, n string")
    got = O.cooccurrence(df, "basket", "item", scratch, shared, lift).collect()
    assert {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r.n_baskets == n and math.isclose(r.lift, r.n_ab * n / (r.n_a * r.n_b))


def test_cooccurrence_of_an_empty_table(spark, scratch):
    assert O.cooccurrence(spark.createDataFrame([], "b string, i string"), "b", "i", scratch).count() == 0


# neighbours

VECTORS = "model string, key string, v array<float>, dim int, at timestamp_ntz, id string"


def test_neighbours_reach_the_recall_of_brute_force(spark, scratch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 64))
    near = base[:150] + rng.normal(size=(150, 64)) * 0.22
    x = np.vstack([base, near]).astype("float32")
    x[5] *= 40  # length does not matter
    rows = [("m", f"k{i:04}", v.tolist(), 64, None, "clash") for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u.astype("float64") @ u.T
    np.fill_diagonal(sim, -1)
    want = {(f"k{i:04}", f"k{j:04}") for i in range(len(x)) for j in np.argsort(-sim[i])[:10] if sim[i, j] >= 0.92}
    got = {(r.key, r.neighbour) for r in N.nearest(spark.createDataFrame(rows, VECTORS), "model", "key", "v", "dim", "at", scratch).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 100


def test_recall_of_pairs_right_at_the_threshold(spark, scratch):
    rng = np.random.default_rng(8)
    a, e = rng.normal(size=(3000, 64)), rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e -= (e * a).sum(1, keepdims=True) * a
    b = 0.9201 * a + math.sqrt(1 - 0.9201**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    rows = [("m", f"{side}{i:04}", v.tolist(), 64, None, "") for side, x in (("a", a), ("b", b)) for i, v in enumerate(x.astype("float32"))]
    got = {(r.key, r.neighbour) for r in N.nearest(spark.createDataFrame(rows, VECTORS), "model", "key", "v", "dim", "at", scratch).collect()}
    assert sum((f"a{i:04}", f"b{i:04}") in got for i in range(3000)) >= 0.95 * 3000


def test_substrings_grow_with_the_number_of_vectors():
    few, many = N.shape(20_000, 0.92), N.shape(100_000_000, 0.92)
    assert few[0] == 15 and many[0] == 27 and few[1] < many[1] < few[1] * 10


def test_a_cloud_of_near_copies_is_compared_block_by_block(spark, scratch, monkeypatch):
    monkeypatch.setattr(N, "DENSE", 12)
    monkeypatch.setattr(N, "ROWS", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=64) + rng.normal(size=(90, 64)) * 0.05
    x = np.vstack([x, rng.normal(size=(40, 64))]).astype("float32")
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    want = {f"k{i:03}": [f"k{j:03}" for j in sorted(set(range(130)) - {i}, key=lambda j: (-sim[i, j], j)) if sim[i, j] >= 0.92][:10] for i in range(130)}
    got = defaultdict(list)
    rows = [("m", f"k{i:03}", v.tolist(), 64, None, "") for i, v in enumerate(x)]
    for r in N.nearest(spark.createDataFrame(rows, VECTORS), "model", "key", "v", "dim", "at", scratch).orderBy("rank").collect():
        got[r.key].append(r.neighbour)
    assert got == {k: v for k, v in want.items() if v} and len(got) == 90


def test_neighbours_of_copies_unusable_and_small_vectors(spark, scratch):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [("m", f"c{i:02}", a, 3, None, "") for i in range(15)] + [("m", "c00", a, 3, None, ""), ("m", "other", b, 3, None, ""), ("x", "c00", a, 3, None, ""), ("m", "n1", None, 3, None, ""), ("m", "n2", [0.0] * 3, 3, None, "")]
    rows += [("m", "n3", a, 4, None, ""), ("m", "n4", [1.0, None, 0.0], 3, None, ""), ("m", "n5", [float("nan"), 1.0, 0.0], 3, None, ""), (None, "n6", a, 3, None, ""), ("m", None, a, 3, None, "")]
    got = defaultdict(list)
    for r in N.nearest(spark.createDataFrame(rows, VECTORS), "model", "key", "v", "dim", "at", scratch, k=4).orderBy("rank").collect():
        got[r.key].append(r.neighbour)
    assert set(got) == {f"c{i:02}" for i in range(15)}
    assert got["c00"] == ["c01", "c02", "c03", "c04"] and got["c02"] == ["c00", "c01", "c03", "c04"] and got["c14"] == ["c00", "c01", "c02", "c03"]


def test_neighbours_of_an_empty_table(spark, scratch):
    assert N.nearest(spark.createDataFrame([], VECTORS), "model", "key", "v", "dim", "at", scratch).count() == 0


def test_neighbours_without_threshold_are_those_of_brute_force(spark, scratch, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64 * 150)  # three blocks
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64)).astype("float32")
    x[290:] = x[0]  # a class of eleven copies
    rows = [("m", f"k{i:04}", v.tolist(), 64, None, "") for i, v in enumerate(x)] + [("s", f"s{i}", v.tolist(), 64, None, "") for i, v in enumerate(x[:4])]
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    want = {f"k{i:04}": [f"k{j:04}" for j in sorted(set(range(300)) - {i}, key=lambda j: (-sim[i, j], j))[:10]] for i in range(300)}
    got = defaultdict(list)
    for r in N.nearest(spark.createDataFrame(rows, VECTORS), "model", "key", "v", "dim", "at", scratch, min_similarity=None).orderBy("rank").collect():
        got[r.key].append(r.neighbour)
    assert {k: v for k, v in got.items() if k[0] == "k"} == want
    assert all(len(got[f"s{i}"]) == 3 for i in range(4))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_every_usable_vector_has_its_ten_neighbours(spark):
    n = Counter((r.model_id, r.chunk_id) for r in queries.p6_neighbours(spark, str(DATA)).collect())
    assert n and set(n.values()) == {10}


# packing


def test_packing_never_overfills_and_places_everything(spark, scratch, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 200)
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 7, 50, 99, 100, 101, 230, 1000])) for i in range(700)] + [(700, 0), (701, None), (3, 100)]
    got = S.containers(spark.createDataFrame(rows, "id long, n long"), "id", "n", scratch, capacity=100).collect()
    fill, whole = Counter(), Counter()
    for r in got:
        whole[r.id] += r.size
        if r.size:
            fill[r.container] += r.size
        else:
            assert r.container is None
    assert max(fill.values()) <= 100 and all(r.fill == fill[r.container] for r in got if r.size)
    want = Counter()
    for i, n in rows:
        want[i] += n or 0
    assert +whole == +want and {700, 701} <= set(whole)
    divided = Counter(r.id for r in got if r.size)
    assert all(divided[i] == -(-n // 100) for i, n in rows if n and i != 3)
    assert sum(want.values()) / (100 * len(fill)) > 0.9


def test_sum_of_squares_choice_against_trying_every_gap():
    rng = random.Random(8)
    sizes = np.array([rng.randrange(1, 21) for _ in range(300)])
    bins = S.pack(sizes, 20)
    levels, count = {}, Counter()
    for s, b in zip(sizes.tolist(), bins.tolist()):
        def cost(old, new):
            c = count.copy()
            c[old] -= 1
            c[new] += 1
            return sum(v * v for g, v in c.items() if 0 < g < 20)
        options = [cost(g, g - s) for g in {g for g in levels.values() if s <= g < 20}] + [cost(20, 20 - s)]
        old = levels.get(b, 20)
        assert cost(old, old - s) == min(options)
        count[old] -= 1
        count[old - s] += 1
        levels[b] = old - s


def test_tokens_of_null_empty_and_special_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("<|endoftext|> a word",), ("x" * 20000,)], "t string")
    got = [r[0] for r in df.select(n_tokens(F.col("t"))).collect()]
    assert got[:2] == [0, 0] and all(n > 3 for n in got[2:])


# mixture


def mix(spark, scratch, texts, targets, **kw):
    t = spark.createDataFrame(texts, "doc_id long, source string, key string, n_tokens long")
    chosen, shares = M.mixture(t, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), scratch, **kw)
    return chosen.collect(), {r.source: r for r in shares.collect()}


def test_mixture_meets_shares_within_repeats(spark, scratch):
    rng = random.Random(6)
    texts = [(i, "big", f"t{i}", rng.randrange(1, 9)) for i in range(1500)] + [(2000 + i, "small", f"t{i}" if i < 20 else f"s{i}", rng.randrange(1, 9) if i >= 20 else 4) for i in range(80)]
    texts += [(9000, None, "z", 5), (9001, "unlisted", "y", 5), (9002, "big", None, 5), (9003, "big", "w", 0)]
    chosen, shares = mix(spark, scratch, texts, [("big", 0.7, 1), ("small", 0.25, 3), ("absent", 0.05, 2), (None, 0.1, 1)])
    assert shares["absent"].tokens == 0
    assert abs(shares["big"].share - 0.7 / 0.95) < 0.02 and abs(shares["small"].share - 0.25 / 0.95) < 0.02
    uses = Counter()
    for r in chosen:
        uses[r.doc_id] += r.uses
        assert r.uses <= {"big": 1, "small": 3}[r.source]
    assert max(uses.values()) <= 3 and not {9000, 9001, 9002, 9003} & set(uses)


def test_mixture_without_texts_or_targets(spark, scratch):
    chosen, shares = mix(spark, scratch, [], [("a", 1.0, 1)])
    assert chosen == [] and shares["a"].tokens == 0


def test_flow_repeats_only_when_it_must():
    total, given = M.route({("a",): 10, ("a", "b"): 10}, {"a": 12, "b": 8}, {"a": 2, "b": 1})
    assert total == 20 and given[("a", "b"), "b"] == 8 and given[("a",), "a"] == 10 and given[("a", "b"), "a"] == 2
    assert M.route({("a",): 10}, {"a": 50}, {"a": 3})[0] == 30


# encoding


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", ["Déjà vu à l’été", "«Мы не спим» — сказал он", "Größe und Übung", "żółć i gęś"])
def test_wrongly_read_utf8_comes_back(text, codec):
    try:
        bad = text.encode("utf-8").decode(codec)
    except UnicodeDecodeError:
        pytest.skip("bytes that this encoding cannot read")
    good, n, _ = J.repair(f"before. {bad} after.")
    assert n and good == f"before. {text} after."


@pytest.mark.parametrize("text", ["À la fin", "SÃO PAULO, MANHÃ.", "«США» и СССР…", "naïve café — “fine”", "ÉTÉ À L’ÂGE D’OR", "«Сёстры» в лесу", "Straße „Übung“", "Łódź, ŹDŹBŁO", "静かな工房", "", "— él dijo"])
def test_ordinary_text_is_left_alone(text):
    assert J.repair(text) == (text, 0, "")


def test_kana_with_ascii_trail_bytes_comes_back_between_ascii_words():
    for word in ("テスト", "データ"):
        text = f"word {bytes(word, 'shift_jis').decode('latin-1').translate({0x83: 'ƒ'})} word"
        assert J.repair(text) == (f"word {word} word", 1, "shift_jis")


def test_double_damage_and_damage_in_places():
    twice = "é–".encode().decode("cp1252").encode().decode("cp1252")
    assert J.repair(f"a {twice} b")[0] == "a é– b"
    stats = J.Stats({"à": 9, "é": 9}, {"Ã©": 1})
    assert J.repair("à côté, voilÃ\u00a0 une clÃ©", stats)[0] == "à côté, voilà une clé"
    layers = "Déjà vu à l’été"
    for _ in range(7):
        layers = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in layers.encode())
    assert J.repair(layers)[0] == "Déjà vu à l’été"


@pytest.mark.parametrize("text", ["שלום עולם", "مرحبا بالعالم", "สวัสดีชาวโลก", "नमस्ते दुनिया", "Xin chào thế giới", "안녕하세요 세계", "γειά σου Κόσμε", "გამარჯობა", "smile 😀 here"])
def test_any_script_comes_back_from_latin_1(text):
    assert J.repair(text.encode().decode("latin-1"))[0] == text
    assert J.repair(text) == (text, 0, "")


@pytest.mark.parametrize("text", ["clé\u00a0» et été\u00a0»", "СССР… её Её сёстры СЁСТРЫ", "Він і її дім", "ÉTÉ» CAFÉ” ÂGÉ…", "está»—dijo", "MANHû", "┌─┐ ╔═╗"])
def test_lone_sequences_of_ordinary_text_stay(text):
    # As many texts hold the characters as usual, none the ones that decoding would give.
    stats = J.Stats({c: 500 for c in "éêàèçôûîïëñáíóúöäüßÉёЁії’“”«»…—Ã"}, {})
    assert J.repair(text, stats) == (text, 0, "")


def test_lone_sequences_need_attested_characters():
    stats = J.Stats({"é": 500, "’": 300, "ê": 60}, {"Ã©": 40, "â€™": 30, "Ãª": 50, "É»": 2})
    assert J.repair("une clÃ© perdue", stats)[0] == "une clé perdue"
    assert J.repair("itâ€™s", stats)[0] == "it’s"
    assert J.repair("une forÃªt", stats) == ("une forÃªt", 0, "")  # half of the texts with the letter are damaged: one place is not enough
    assert J.repair("une forÃªt et une clÃ©", stats)[0] == "une forêt et une clé"


def test_recover_finds_single_byte_confusions_by_attested_words(spark, scratch):
    good = [(i, "Сегодня утром тихая печь объясняет вопрос", "clash") for i in range(30)]
    bad = [(100, "Сегодня утром тихая печь".encode("cp1251").decode("latin-1"), ""), (101, "тихая печь объясняет".encode("koi8_r").decode("cp1251"), ""), (102, "lost � here", ""), (103, None, ""), (104, "", ""), (105, "plain", ""), (106, "Ð¿ÐµÑ‡ÑŒ", "")]
    got = {r.key: r for r in J.recover(spark.createDataFrame(good + bad, "doc_id long, text string, key string"), "doc_id", "text", scratch).collect() if r.found}
    assert set(got) == {100, 101, 102, 106}
    assert got[100].text == "Сегодня утром тихая печь" and got[101].text == "тихая печь объясняет" and got[102].lost and got[106].text == "печь"


def test_frequent_single_byte_damage_and_damaged_copies_are_found(spark, scratch):
    some = "сегодня утром тихая печь объясняет вопрос другая книга старого города".split()
    texts = [" ".join(["Вот", *some[i % 7 : i % 7 + 4], "x" * i]) for i in range(30)]
    wrong = lambda t: t.encode("cp1251").decode("latin-1")
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, wrong(t) + " y") for i, t in enumerate(texts[:20])] + [(200 + i, wrong("Сегодня утром тихая печь")) for i in range(25)]
    rows += [(300 + i, f"une forêt près de l'église {'z' * i}") for i in range(5)]
    got = {r.key: r for r in J.recover(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", scratch).collect() if r.found}
    assert set(got) == set(range(100, 120)) | set(range(200, 225))
    assert got[200].text == "Сегодня утром тихая печь" and all(got[100 + i].text == texts[i] + " y" for i in range(20))


# chunks


def pieces_hold(text):
    out = K.split(text)
    at, last = 0, None
    for a, b, path in out:
        assert 0 <= a < b <= len(text) and b - a <= K.LIMIT
        if last and path == last[2]:
            assert a == max(last[0], last[1] - K.OVERLAP)
        else:
            assert a >= at and not text[at:a].strip()
        at, last = b, (a, b, path)
    assert not text[at:].strip()
    return out


@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randrange(1, 25)):
        kind = rng.randrange(6)
        words = " ".join("".join(rng.choice("abcdé漢") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", ".", "!", "。"]) for _ in range(rng.randrange(1, 400)))
        parts.append({0: "# " + words[:30], 1: "2.1 Title Words", 2: words, 3: words.replace(" ", ""), 4: "- a\r\n- b\r\n" + words, 5: " \t\r"}[kind])
        parts.append(rng.choice(["\n\n", "\n", "\r\n\r\n", "\n" + " " * 1300 + "\n\n"]))
    text = "".join(parts)
    out = pieces_hold(text)
    assert K.divided(text, out) == [x for x in K.paragraphs(text) if x[1] - x[0] > K.LIMIT]


def test_smallest_neighbours_are_merged_first():
    text = "\n\n".join(c * n for c, n in zip("abcd", (700, 300, 200, 900)))
    assert [(a, b) for a, b, _ in pieces_hold(text)] == [(0, 700), (580, 1204), (1084, 2106)]
    gap = "# H\n\n" + "word " * 300 + "\n\n" + " " * 700 + "\n\n" + "more " * 100
    out = pieces_hold(gap)
    assert len({p for _, _, p in out}) == 1 and all(b[0] == a[1] - K.OVERLAP for a, b in zip(out, out[1:]))
    assert [b - a for a, b, _ in pieces_hold("x" * 3000)] == [1200, 1200, 840]


def test_sections_paths_and_merging():
    text = "# One\n\nshort\n\n## Inner\n\nalso short\n\n# Two\n\n" + "A sentence here. " * 200
    out = pieces_hold(text)
    assert out[0][2] == "One" and {p for _, _, p in out[1:]} == {"Two"} and len(out) > 3
    assert all(b[0] == a[1] - K.OVERLAP for a, b in zip(out[1:], out[2:]))
    assert K.split("") == [] and K.split(" \n\t") == []


def test_paragraphs_by_definition():
    text = "\n \ta b\r\nc \r\n\r\n \n\nlast"
    assert [text[a:b] for a, b in K.paragraphs(text)] == ["a b\r\nc", " ", "last"]


# boilerplate

PAGE = """<html><head><title>t</title></head><body>
<nav><ul>
<li><a href="/a">Home</a></li>
<li><a href="/b">Topics</a></li>
</ul></nav>
<{tag}>
<h1>Headline {w} of ours</h1>
<p>By Some Body, 3 May 2020</p>
<p>The first paragraph {w} tells a long story about rivers, and it goes on. It has two sentences.</p>
<p>Share this page</p>
<p>Another paragraph {w} follows with many more words about the same rivers and the towns beside them.</p>
<div style="display:none">Hidden words that nobody sees.</div>
</{tag}>
<div><h3>Most read</h3>
<p><a href="/x{i}">Teaser {w} number</a></p>
</div>
<footer><a href="/c">Imprint</a>
</footer></body></html>"""


def page(tag, i):
    return PAGE.format(tag=tag, i=i, w="".join(chr(97 + int(x)) for x in f"{i:02}") * 2 + tag)


def test_main_body_of_pages_with_and_without_labels(spark, scratch):
    rows = [(f"l{i}", page("article", i), True, "clash") for i in range(30)] + [(f"d{i}", page("div", i), True, "") for i in range(5)] + [("n", None, True, ""), ("e", "", True, ""), ("d0", page("div", 0), True, "")]
    clean = spark.createDataFrame([("The first paragraph tells a long story.",)], "text string")
    got = defaultdict(list)
    for r in B.extract(spark.createDataFrame(rows, "key string, body string, markup boolean, line_no string"), "key", "body", "markup", clean, "text", scratch).collect():
        got[r.key].append(r.line_no)
    assert set(got) == {f"l{i}" for i in range(30)} | {f"d{i}" for i in range(5)}
    assert all(sorted(v) == [7, 9, 11] for v in got.values())


def test_copies_of_a_page_do_not_make_its_lines_furniture(spark, scratch):
    rows = [(f"l{i}", page("article", i), True) for i in range(30)] + [(f"c{i}", page("div", 3), True) for i in range(40)] + [(f"a{i}", page("article", 0), True) for i in range(40)]
    got = defaultdict(list)
    for r in B.extract(spark.createDataFrame(rows, "key string, body string, markup boolean"), "key", "body", "markup", spark.createDataFrame([("The first paragraph tells a long story.",)], "text string"), "text", scratch).collect():
        got[r.key].append(r.line_no)
    lines = page("div", 3).split("\n")
    want = [i for i, x in enumerate(lines) if x.startswith(("<h1>", "<p>The first", "<p>Another"))]
    first = min(got["l1"]) - next(i for i, x in enumerate(lines) if x.startswith("<h1>"))  # whether lines count from 0 or 1
    assert all(sorted(got[k]) == [i + first for i in want] for k in [f"c{i}" for i in range(40)] + [f"a{i}" for i in range(40)] + ["l1"])


def test_scores_are_features_times_weights():
    pages = [B.html_page(page("article", i)) for i in range(5)]
    said = frozenset(["share this page", "home"])
    for tagged in (True, False):
        w = B.fit(pages, said, tagged)
        for p in (B.html_page(page("article", 7)), B.html_page("<title>x y</title><ul><li><a>x</a></li><li><a>y</a></li><li>three words here.</li></ul>"), B.text_page("one\n\n two three")):
            want = [sum(w.w[x] for x in words) / math.sqrt(max(1, len(words))) + sum(w.w[B._slot(x)] for x in named) for words, named in B.features(p, said, tagged)]
            assert np.allclose(w.score(p, said, tagged)[0], want)


def test_phrases_fold_digits_names_and_marks():
    assert B.phrase("By Some Body, 3 May 2020") == B.phrase("By Any Other Name, 21 June 2019") == "by X, 0 X 0"
    assert B.phrase("## Tidal Index") == B.phrase("2.1 Tidal Index") == B.phrase("Tidal Margin") == "tidal X"
    assert B.phrase("x" * 161) == "" and B.phrase("…") == "…"


def test_lines_of_a_page_keep_their_numbers():
    p = B.html_page("<html><head>\n<title>a &amp; b</title></head><body><p>one\ntwo <b>three</b></p>\n\n<script>no\nno</script><div style='display: none'>no<div>no</div></div>\n<a href=x>four</a> <!-- no\nno --> five</body>")
    assert list(zip(p.nos, p.texts, p.linked)) == [(2, "one", 0), (3, "two three", 0), (7, "four", 1), (8, "five", 0)] and p.title == "a & b"


def index_page(i):
    teasers = "\n".join(f'<p><a href="/t{k}">Teaser {chr(97 + i)}{chr(97 + k)} word</a></p>\n<p>It goes on in a few words here.</p>' for k in range(8))
    return page("div", i).split("<div>\n<h1>")[0] + "<div><h3>Most read</h3>\n" + teasers + '</div>\n<footer><a href="/c">Imprint</a>\n</footer></body></html>'


def test_pages_that_only_list_others_have_no_main_body(spark, scratch):
    long = lambda i: page("article", i).replace("<p><a href", "\n".join(f"<p>Teaser {chr(97 + i)} it goes on in a few words {k} here.</p>" for k in range(6)) + "<p><a href")
    rows = [(f"l{i}", long(i), True) for i in range(30)] + [(f"x{i}", index_page(i), True) for i in range(5)] + [(f"s{i}", "\n".join(B.html_page(page("div", i)).texts), False) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, body string, markup boolean")
    got = defaultdict(list)
    for r in B.extract(df, "key", "body", "markup", spark.createDataFrame([], "text string"), "text", scratch).collect():
        got[r.key].append(r.line_no)
    assert not {f"x{i}" for i in range(5)} & set(got)
    for i in range(5):
        texts = B.html_page(page("div", i)).texts
        assert [texts[k - 1][:5] for k in sorted(got[f"s{i}"])] == ["Headl", "The f", "Anoth"]


def test_no_labelled_pages_and_no_pages(spark, scratch):
    none = spark.createDataFrame([], "key string, body string, markup boolean")
    clean = spark.createDataFrame([(None,), ("",)], "text string")
    assert B.extract(none, "key", "body", "markup", clean, "text", scratch).count() == 0
    some = spark.createDataFrame([("a", page("div", 1), True), ("b", "plain words.", None), (None, "x", False)], "key string, body string, markup boolean")
    assert B.extract(some, "key", "body", "markup", clean, "text", scratch).count() == 0


def test_region_is_the_maximum_scoring_subsequence():
    rng = random.Random(9)
    for _ in range(50):
        s = np.array([rng.uniform(-3, 3) for _ in range(rng.randrange(0, 12))])
        a, b, best = B.best_region(s.tolist())
        brute = max([0.0, *(s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert math.isclose(best, brute, abs_tol=1e-9) and math.isclose(s[a:b].sum(), brute, abs_tol=1e-9)
