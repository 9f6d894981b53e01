"""Main content of web pages by a maximum-scoring subsequence.

Words score positive and tags negative: a line is a run of tags and words, its score the sum of what they and the lines
beside it weigh, and all weights are log-odds fitted on labelled pages (logistic regression).  Pages label themselves
where they put their article into an ``article`` or ``main`` element; that element's name is hidden from the fit, so the
weights carry over to pages without such elements and, with the tags left out, to pages already stripped of theirs.  A
linear scan finds the contiguous region of the greatest sum, and the lines of that region are the main body.  The weights for
stripped pages are fitted on the same pages without their tags and on others whose region the first fit has found.  A page has
none if its best region stays below what the menus and side columns of labelled pages reach.

Furniture inside the region (by-lines, sharing, sign-up and read-on lines) is left out.  It is recognised by repetition:
a line whose phrase (digits and names folded) recurs on many pages but hardly in any clean text.  Those counts cover the
whole corpus and count a phrase once for each distinct body, told apart by hash, so copies of a page do not make its
lines furniture.  A phrase must make up a fixed share of all lines, so there are at most 1 / ``SHARE`` of them whatever
the size of the corpus.

Every page is parsed once; counting, fitting and scanning read the parsed lines from the shared folder.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import Scratch

#: The fit sees at most so many labelled pages, and as many others with tags, those with the smallest hash of their body.
LABELLED = 500
#: Longer labelled pages are not used for the fit (all pages are extracted).
LABELLED_CHARS = 64_000
#: A phrase is furniture from three pages and this share of all short lines on; at most 1 / SHARE phrases can be.
SHARE = 1 / 20_000
#: A furniture phrase is on at least so many times more pages than clean texts.
CLEAN = 50
#: Longer lines are prose and have no phrase.
PHRASE_CHARS = 160
#: Columns of words, and of all other features, in the fit.
WORDS, OTHERS = 8192, 8192
#: Share of labelled pages whose menus and side columns must stay below the score that makes a main body.
QUIET = 0.98

_TOKEN = re.compile(r"<!--.*?-->|<![^>]*>|<(/?)([A-Za-z][A-Za-z0-9-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|[^<]+|<", re.S)
_VOID = frozenset(["br", "img", "meta", "link", "hr", "input", "source", "wbr", "area", "base", "col", "embed", "param", "track"])
#: Elements whose end tag is often left out, and those inside a line; neither counts as a container.
_LOOSE = frozenset(
    ["p", "li", "td", "th", "tr", "dt", "dd", "option", "tbody", "thead", "tfoot", "a", "span", "b", "i", "em", "strong", "small", "sup", "sub", "u", "s", "code", "label", "time", "button"]
    + ["h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "cite", "q", "mark", "abbr"]
)
_UNSEEN = frozenset(["script", "style", "head", "noscript", "template", "svg"])
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\bhidden\b", re.I)
_MAIN = frozenset(["article", "main"])
#: Containers count as ``div`` in the fit, as what they are called differs from site to site.
_BLOCKS = frozenset(["article", "main", "section", "aside", "nav", "footer", "header", "table"])
_WORD = re.compile(r"[^\W_]+(?:[’'][^\W_]+)*")
_DIGITS = re.compile(r"\d+")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.I | re.S)


@dataclass
class Page:
    """Lines with visible text: number from 1, text, words inside links, tags before it, container, inside the article."""

    nos: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    title: str = ""


def _name(tag: str, closing: bool) -> str:
    return ("/" if closing else "") + ("div" if tag in _BLOCKS else tag)


def html_page(body: str) -> Page:
    """Visible lines of a page with tags; hidden elements, scripts and the like are left out."""
    texts: dict[int, list[str]] = {}
    facts: dict[int, tuple[list[str], tuple[int, ...], bool]] = {}
    linked: dict[int, int] = {}
    no, serial, link, unseen = 1, 0, 0, []
    stack: list[tuple[str, int, bool]] = []
    path: tuple[int, ...] = ()
    inside = False
    pending: list[str] = []
    for m in _TOKEN.finditer(body):
        raw = m.group()
        if m[2]:
            tag, closing = m[2].lower(), m[1] == "/"
            if unseen:
                if tag == unseen[0]:
                    if closing:
                        unseen.pop()
                    else:
                        unseen.append(tag)
            elif not closing and (tag in _UNSEEN or (len(m[3]) > 4 and tag not in _VOID and _HIDDEN.search(m[3]))):
                unseen = [tag]
            else:
                pending.append(_name(tag, closing))
                if tag == "a":
                    link = 0 if closing else 1
                elif tag not in _VOID and tag not in _LOOSE and tag != "html" and tag != "body":
                    if not closing:
                        serial += 1
                        stack.append((tag, serial, tag in _MAIN))
                    elif any(t == tag for t, _, _ in stack):
                        while stack.pop()[0] != tag:
                            pass
                    path, inside = tuple(s for _, s, _ in stack), any(x for _, _, x in stack)
            no += raw.count("\n")
        elif raw.startswith("<!"):
            no += raw.count("\n")
        else:
            for i, part in enumerate(raw.split("\n")):
                no += i > 0
                if unseen or not part or part.isspace():
                    continue
                part = html.unescape(part)
                if part.isspace():
                    continue
                if no not in texts:
                    texts[no], facts[no] = [part], (pending, path, inside)
                else:
                    texts[no].append(part)
                    facts[no][0].extend(pending)
                if link:
                    linked[no] = linked.get(no, 0) + len(_WORD.findall(part))
                pending = []
    nos = sorted(texts)
    paths = [facts[k][1] for k in nos]
    depth = 0
    while len({p[: depth + 1] for p in paths}) == 1 and any(len(p) > depth + 1 for p in paths):
        depth += 1
    number: dict[tuple[int, ...], int] = {}
    title = _TITLE.search(body)
    return Page(
        nos, ["".join(texts[k]).strip() for k in nos], [linked.get(k, 0) for k in nos], [" ".join(facts[k][0]) for k in nos],
        [number.setdefault(p[: depth + 1], len(number)) for p in paths], [facts[k][2] for k in nos], html.unescape(title[1]).strip() if title else "",
    )


def text_page(body: str) -> Page:
    """Lines of a page without tags."""
    lines = [(i, t.strip()) for i, t in enumerate(body.split("\n"), 1) if t and not t.isspace()]
    n = len(lines)
    return Page([i for i, _ in lines], [t for _, t in lines], [0] * n, [""] * n, [0] * n, [False] * n)


#: Heading marks, section numbers and bullets before a line's first letter.
_MARKS = re.compile(r"\A(?:[^\w\s“„«\"'(©]+ *|(?:\d+\.)+\d* +|\d+\) +)+(?=\w)")


@lru_cache(maxsize=30_000)
def phrase(text: str) -> str:
    """A line as furniture is counted: digits folded to 0, capitalised words after the first to X, lower case, without
    heading marks.  Long lines have none."""
    if len(text) > PHRASE_CHARS:
        return ""
    words = _DIGITS.sub("0", _MARKS.sub("", text)).split()
    out: list[str] = []
    for k, w in enumerate(words):
        if k and w[0].isupper():
            w = "X" + (w[-1] if not w[-1].isalnum() else "")
            if w == "X" and out[-1] == "X":
                continue
            if out[-1] == "X":
                out.pop()
        else:
            w = w.lower()
        out.append(w)
    return " ".join(out)


@lru_cache(maxsize=100_000)
def _slot(feature: str) -> int:
    return WORDS + zlib.crc32(feature.encode()) % OTHERS


@lru_cache(maxsize=100_000)
def _word_slot(word: str) -> int:
    return zlib.crc32(_DIGITS.sub("0", word.lower()).encode()) % WORDS


_NUMBERED, _VALUE = re.compile(r"\d+\. "), re.compile(r": ?[\d.,]+\Z")
_INNER_END = re.compile(r"[.!?] |。.")


def _shape(t: str, n: int) -> list[str]:
    size = "0" if n <= 2 else "1" if n <= 6 else "2" if n <= 14 else "3" if n <= 30 else "4"
    out = ["n" + size, "end" + ("a" if t[-1].isalpha() else "0" if t[-1].isdigit() else t[-1])]
    if _NUMBERED.match(t):
        out.append("numbered")
    if " | " in t or " · " in t or " » " in t:
        out.append("bars")
    if t[-1].isdigit() and _VALUE.search(t):
        out.append("value")
    if not t[0].isalnum():
        out.append("begins" + t[0])
    if _INNER_END.search(t):
        out.append("sentences")
    if "©" in t:
        out.append("©")
    out.append("capital" if t[0].isupper() else "small")
    return out


def _cls(t: str, n: int, linked: int) -> str:
    """What a line looks like to its neighbours."""
    return f"{0 if n <= 2 else 1 if n <= 6 else 2 if n <= 14 else 3}{'.' if not t[-1].isalnum() else ''}{'L' if linked and linked >= n else ''}"


def _share(x: float) -> str:
    return "0" if x == 0 else "1" if x < 0.34 else "2" if x < 0.67 else "3"


def contexts(page: Page, said: list[str | None], counts: list[int], tagged: bool) -> list[list[str]]:
    """Features of each line that stem from the lines around it, from its container and from the page's title.

    ``said`` holds the furniture phrase of each line or None, ``counts`` its number of words.
    """
    n = len(page.nos)
    cls = [f"f{s}" if s is not None else _cls(t, c, k) for s, t, c, k in zip(said, page.texts, counts, page.linked)]
    block: dict[int, list[str]] = {}
    if tagged:
        rows: dict[int, list[int]] = {}
        for i, b in enumerate(page.blocks):
            rows.setdefault(b, []).append(i)
        titles = [page.title.startswith(t) and not page.title[len(t) : len(t) + 1].isalnum() for t in page.texts]
        held = {b: any(titles[i] for i in own) for b, own in rows.items()}
        unlinked = {b: sum(counts[i] for i in own if not page.linked[i]) for b, own in rows.items()}
        most = max(unlinked, key=unlinked.get, default=None)
        for b, own in rows.items():
            m = len(own)
            words = sum(counts[i] for i in own) / m
            first = said[own[0]]
            links = _share(sum(page.linked[i] > 0 and page.linked[i] >= counts[i] for i in own) / m)
            furnished = _share(sum(said[i] is not None for i in own) / m)
            size = "0" if words < 3 else "1" if words < 6 else "2" if words < 12 else "3" if words < 24 else "4"
            block[b] = [f"b-links{links}", f"b-said{furnished}", f"b-words{size}", f"b-head{first}", f"b{links}{furnished}{size}"]
            block[b] += ["b-title" if held[b] else "b-notitle" if any(held.values()) else "b-untitled", "b-most" if b == most else "b-less"]
    out = []
    under, since = "", 0
    for i in range(n):
        if tagged and i and page.blocks[i] != page.blocks[i - 1]:
            under, since = "", 0
        f = [f"prev{cls[i - 1] if i else ''}", f"next{cls[i + 1] if i + 1 < n else ''}", f"under{under}", f"since{min(since, 4)}{'' if under else '-'}"]
        if tagged:
            f += block[page.blocks[i]]
            if titles[i]:
                f.append("title")
        out.append(f)
        since += 1
        if said[i] is not None:
            under, since = said[i], 0
    return out


def features(page: Page, furniture: frozenset[str], tagged: bool) -> list[tuple[tuple[int, ...], list[str]]]:
    """Per line: hashed words (they count 1 / sqrt(number) each) and the other features by name."""
    words = [_WORD.findall(t) for t in page.texts]
    said = [p if (p := phrase(t)) in furniture else None for t in page.texts]
    out = []
    for i, ctx in enumerate(contexts(page, said, [len(w) for w in words], tagged)):
        out.append((tuple({_word_slot(w) for w in words[i]}), _own(page.texts[i], len(words[i]), page.linked[i], page.tags[i] if tagged else "", said[i]) + ctx))
    return out


def _own(text: str, n: int, linked: int, tags: str, said: str | None) -> list[str]:
    f = ["line", *_shape(text, n)]
    if said is not None:
        f.append("said" + said)
    if linked:
        f.append("linked" if linked >= n else "partly")
    return f + _tag_features(tags)


@lru_cache(maxsize=30_000)
def _tag_features(tags: str) -> list[str]:
    return ["<" + t for t in tags.split(" ")] if tags else []


class Weights:
    """Fitted log-odds; scores of texts, tags and neighbourhoods are kept, as most of them recur."""

    def __init__(self, w: np.ndarray, least: float):
        self.w = w.tolist()
        self.least = least  # a region must score more
        self._texts: dict[str, tuple[float, int, str | None]] = {}
        self._parts: dict[str, float] = {}

    def __reduce__(self):
        return Weights, (np.array(self.w), self.least)

    def part(self, feature: str) -> float:
        got = self._parts.get(feature)
        if got is None:
            got = self._parts[feature] = self.w[_slot(feature)]
        return got

    def score(self, page: Page, furniture: frozenset[str], tagged: bool) -> tuple[list[float], list[str | None]]:
        """Score and furniture phrase of each line: its ``features`` times the weights."""
        if len(self._texts) > 50_000:
            self._texts.clear()
        if len(self._parts) > 200_000:
            self._parts.clear()
        base = []
        for t in page.texts:
            got = self._texts.get(t)
            if got is None:
                words = _WORD.findall(t)
                p = phrase(t)
                said = p if p in furniture else None
                slots = {_word_slot(x) for x in words}
                s = sum(map(self.w.__getitem__, slots)) / math.sqrt(max(1, len(slots)))
                got = self._texts[t] = (s + sum(map(self.part, _own(t, len(words), 0, "", said))), len(words), said)
            base.append(got)
        said = [b[2] for b in base]
        counts = [b[1] for b in base]
        out = []
        for i, ctx in enumerate(contexts(page, said, counts, tagged)):
            s = base[i][0] + sum(map(self.part, ctx))
            if page.linked[i]:
                s += self.part("linked" if page.linked[i] >= counts[i] else "partly")
            if tagged and page.tags[i]:
                s += sum(map(self.part, _tag_features(page.tags[i])))
            out.append(s)
        return out, said


def fit(pages: list[Page], furniture: frozenset[str], tagged: bool, rounds: int = 200, l2: float = 2e-6) -> Weights:
    """Logistic regression of "inside the article" by full-batch adaptive gradient steps; deterministic."""
    rows, cols, vals, y = [], [], [], []
    for p in pages:
        for (words, named), inside in zip(features(p, furniture, tagged), p.main):
            r = len(y)
            cols += words
            vals += [1 / math.sqrt(max(1, len(words)))] * len(words)
            cols += map(_slot, named)
            vals += [1.0] * len(named)
            rows += [r] * (len(words) + len(named))
            y.append(inside)
    d = WORDS + OTHERS
    w = np.zeros(d)
    if not y:
        return Weights(w, 0.0)
    row, col, val, want, n = np.array(rows), np.array(cols), np.array(vals), np.array(y, dtype=np.float64), len(y)
    seen = np.full(d, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * val, n), -30, 30)))
        g = np.bincount(col, (p - want)[row] * val, d) / n + l2 * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    out = Weights(w, 0.0)
    beside = []
    for p in pages:
        s, _ = out.score(p, furniture, tagged)
        beside.append(max((best_region([x for x, m in zip(part, flags) if not m])[2] for part, flags in _apart(s, p.main)), default=0.0))
    out.least = float(np.quantile(beside, QUIET)) if beside else 0.0
    return out


def _apart(scores: list[float], main: list[bool]) -> Iterator[tuple[list[float], list[bool]]]:
    """The scores before and after the main body; all of them if there is none."""
    if True not in main:
        yield scores, main
    else:
        a, b = main.index(True), len(main) - main[::-1].index(True)
        yield scores[:a], main[:a]
        yield scores[b:], main[b:]


def best_region(scores: list[float]) -> tuple[int, int, float]:
    """Half-open range of the contiguous lines with the greatest sum; empty if no score is positive."""
    best, at, start, out = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if at <= 0:
            at, start = 0.0, i
        at += s
        if at > best:
            best, out = at, (start, i + 1)
    return *out, best


def within(page: Page, weights: Weights, furniture: frozenset[str], tagged: bool) -> tuple[list[bool], list[str | None]]:
    """Whether each line is in the best region, which must be better than a menu, and the furniture among the lines."""
    s, said = weights.score(page, furniture, tagged)
    a, b, best = best_region(s)
    return [a <= i < b and best > weights.least for i in range(len(s))], said


def main_lines(page: Page, weights: Weights, furniture: frozenset[str], tagged: bool) -> list[int]:
    """Numbers of the lines of the best region without its furniture."""
    return [no for no, x, f in zip(page.nos, *within(page, weights, furniture, tagged)) if x and f is None]


_PARSED = "h long, nos array<int>, texts array<string>, linked array<int>, tags array<string>, blocks array<int>, main array<boolean>, title string, phrases array<string>"


def _phrases(texts: list[str]) -> list[str]:
    return sorted({p for p in map(phrase, texts) if p})


def extract(pages: DataFrame, key: str, body: str, markup: str, clean: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """``(key, line_no)`` of every line with visible text of the main body of each page.

    ``markup`` is a boolean column: whether ``body`` has tags.  ``clean`` holds texts known to be free of boilerplate.
    Null and empty bodies, pages without a main body and lines without visible text have no rows; rows repeated under one
    key come out once (repeats are dropped among the line numbers, so no page is shuffled); without any labelled page no
    page has a main body.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(body).alias("body"), F.coalesce(F.col(markup), F.lit(False)).alias("markup"), F.xxhash64(F.col(body)).alias("h")).filter("key is not null and body <> ''")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            got = [html_page(t) if m else text_page(t) for t, m in zip(c["body"], c["markup"])]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": b.column("key"), "markup": b.column("markup"), "usable": pa.array([m and len(t) <= LABELLED_CHARS for t, m in zip(c["body"], c["markup"])]), "h": b.column("h"),
                    "nos": pa.array([p.nos for p in got], pa.list_(pa.int32())), "texts": pa.array([p.texts for p in got], pa.list_(pa.string())), "linked": pa.array([p.linked for p in got], pa.list_(pa.int32())),
                    "tags": pa.array([p.tags for p in got], pa.list_(pa.string())), "blocks": pa.array([p.blocks for p in got], pa.list_(pa.int32())), "main": pa.array([p.main for p in got], pa.list_(pa.bool_())),
                    "title": pa.array([p.title for p in got], pa.string()), "phrases": pa.array([_phrases(p.texts) for p in got], pa.list_(pa.string())),
                }
            )

    parsed = scratch.put(rows.mapInArrow(parse, f"key {kind}, markup boolean, usable boolean, {_PARSED}"))

    def phrases_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"h": b.column("h"), "phrases": pa.array([_phrases([x for x in map(str.strip, t.split("\n")) if x]) for t in b.column("text").to_pylist()], pa.list_(pa.string()))})

    clean_rows = clean.filter(F.col(text) != "").select(F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")).mapInArrow(phrases_of, "h long, phrases array<string>")
    own = F.lit(0).cast("byte")
    lines = parsed.select("h", "phrases", own.alias("clean")).unionByName(clean_rows.select("h", "phrases", F.lit(1).cast("byte").alias("clean")))
    # One row per phrase and distinct body; a phrase travels as a hash until the few that count are known.
    each = lines.select("h", "clean", F.explode("phrases").alias("phrase")).groupBy(F.xxhash64("phrase").alias("p"), "h", "clean").agg(F.first("phrase").alias("phrase"))
    counts = scratch.put(each.groupBy("p").agg(F.first("phrase").alias("phrase"), F.count_if(F.col("clean") == 0).alias("n"), F.count_if(F.col("clean") == 1).alias("n_clean")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # At most 1 / SHARE phrases of at most PHRASE_CHARS characters.
    furniture = frozenset(r[0] for r in counts.filter((F.col("n") >= 3 + SHARE * total) & (F.col("n_clean") * CLEAN <= F.col("n"))).select("phrase").collect())
    cols = ["nos", "texts", "linked", "tags", "blocks", "main", "title"]

    def sample(rows: DataFrame) -> list[Page]:
        """At most LABELLED pages, one for each hash; the greatest of those hashes is null, and nothing passes, if there are none."""
        last = rows.select("h").distinct().orderBy("h").limit(LABELLED).agg(F.max("h")).first()[0]
        found = rows.filter(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first(F.struct(*cols)).alias("s")).orderBy("h").select("s.*")
        return [Page(**r) for r in found.toArrow().to_pylist()]

    short = parsed.filter("usable")
    marked = F.exists("main", lambda x: x)
    labelled = sample(short.filter(marked))
    with_tags = fit(labelled, furniture, True)
    others = [replace(p, main=within(p, with_tags, furniture, True)[0]) for p in (sample(short.filter(~marked)) if labelled else [])]
    held = scratch.spark.sparkContext.broadcast((with_tags, fit(labelled + others, furniture, False), furniture))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagged, plain, furniture = held.value
        for b in batches:
            c = b.to_pydict()
            keys, nos = [], []
            for i, (k, m) in enumerate(zip(c["key"], c["markup"])):
                got = main_lines(Page(c["nos"][i], c["texts"][i], c["linked"][i], c["tags"][i], c["blocks"][i], [], c["title"][i]), tagged if m else plain, furniture, m)
                keys += [k] * len(got)
                nos += got
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, b.schema.field("key").type), "line_no": pa.array(nos, pa.int64())})

    return parsed.select("key", "markup", "nos", "texts", "linked", "tags", "blocks", "title").mapInArrow(scan, f"key {kind}, line_no long").distinct()
