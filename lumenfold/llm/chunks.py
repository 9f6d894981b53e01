"""Splitting oversized texts at natural boundaries by packing their structure tree.

A text is parsed into a tree: sections nested by heading level, then paragraphs, sentences, lines, words and at last
single characters.  Packing goes bottom-up: a node that fits is one unit, and of sibling units the two neighbours that
are smallest together are merged first, until no two fit; only a node that is too large is opened.  Inside a section
each piece begins with the last ``overlap`` characters of the piece before, white space between them included, so every
piece, overlap included, stays within the limit.  One pass per text in Arrow batches; only the spans are shuffled.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 120
BLANK = " \t\r\n"

#: A title-like line is at most so long, of so many words, of which this share begins with a capital.
TITLE_CHARS, TITLE_WORDS, TITLE_CAPITALS = 80, 10, 0.6

_MARK = re.compile(r"(#{1,6})[ \t]+(\S.*?)[ \t#]*\Z")
_NUMBER = re.compile(r"((?:\d{1,3}\.)*\d{1,3})[.)]?[ \t]+(\S.*)\Z")
_ROMAN = re.compile(r"[IVXLC]{1,6}\.[ \t]+(\S.*)\Z")
_RULE = re.compile(r"(=+|-+)[ \t]*\Z")
_SENTENCE = re.compile(r"""(?:[.!?…]+["'”’»)\]]*(?=\s)|[。！？]+[」』）]*)\s*""")


TEXT = 99


@dataclass
class Node:
    start: int
    end: int
    level: int = 0  # of a section's heading; 0 for the root, TEXT for text
    path: str = ""
    kids: list[Node] = field(default_factory=list)


def heading(line: str, alone: bool) -> tuple[int, str] | None:
    """Level and title if the line is a heading; title-like lines only count if they stand ``alone``."""
    s = line.strip(BLANK)
    if m := _MARK.match(s):
        return len(m[1]), m[2]
    if not s or len(s) > TITLE_CHARS or not alone or s[-1] in ".!?:;,。！？…":
        return None
    if (m := _NUMBER.match(s)) and m[2][0].isupper():
        return m[1].count(".") + 1, s
    if (m := _ROMAN.match(s)) and m[1][0].isupper():
        return 1, s
    words = s.split()
    if len(words) <= TITLE_WORDS and s[0].isalnum() and (len(words) < 4 and s[0].isupper() or sum(w[0].isupper() for w in words) >= TITLE_CAPITALS * len(words)):
        return 2, s
    return None


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Half-open spans of the maximal runs of lines that hold something besides space, tab and CR."""
    out, at, first, last = [], 0, -1, -1
    for line in text.split("\n"):
        inner = line.strip(BLANK)
        if inner:
            lead = at + len(line) - len(line.lstrip(BLANK))
            if first < 0:
                first = lead
            last = lead + len(inner)
        elif first >= 0:
            out.append((first, last))
            first = -1
        at += len(line) + 1
    if first >= 0:
        out.append((first, last))
    return out


def _blocks(text: str) -> Iterator[tuple[int, int, tuple[int, str] | None]]:
    """Headings and text blocks in order; a heading inside a paragraph divides it."""
    for a, b in paragraphs(text):
        lines, at = text[a:b].split("\n"), a
        lone, begun = len(lines) == 1, -1
        skip = False
        for i, line in enumerate(lines):
            end = at + len(line)
            under = i + 1 < len(lines) and i == 0 and _RULE.match(lines[1].strip(BLANK)) is not None and len(line.strip(BLANK)) <= TITLE_CHARS
            head = None if skip else (1 if lines[1].lstrip(BLANK)[:1] == "=" else 2, line.strip(BLANK)) if under else heading(line, lone)
            if head:
                if begun >= 0:
                    yield begun, at - 1, None
                    begun = -1
                yield at, end + 1 + len(lines[1]) if under else end, head
                skip = bool(under)
            elif skip:
                skip = False
            elif begun < 0:
                begun = at
            at = end + 1
        if begun >= 0:
            yield begun, b, None


def parse(text: str) -> Node:
    root = Node(0, len(text))
    stack = [root]
    for a, b, head in _blocks(text):
        if head:
            while stack[-1].level >= head[0]:
                stack.pop()
            up = stack[-1]
            node = Node(a, b, head[0], f"{up.path} > {head[1]}" if up.path else head[1], [Node(a, b, TEXT)])
            up.kids.append(node)
            stack.append(node)
        else:
            kids = stack[-1].kids
            if len(kids) == 1 and kids[0].level == TEXT and stack[-1] is not root:
                kids[0].end = b  # the heading stays with the first text under it
            else:
                kids.append(Node(a, b, TEXT))
        for n in stack:
            n.end = max(n.end, b) if n is not root else n.end
    if root.kids:
        root.start, root.end = root.kids[0].start, root.kids[-1].end
    return root


_LINE, _SPACE = re.compile(r"\n+"), re.compile(r"\s+")


def _cut(text: str, a: int, b: int, pattern: re.Pattern[str]) -> list[tuple[int, int]]:
    """Spans between the boundaries, without the white space at their ends."""
    out, at = [], a
    for m in pattern.finditer(text, a, b):
        if m.end() > at:
            out.append((at, at + len(text[at : m.end()].rstrip())))
            at = m.end()
    if at < b:
        out.append((at, b))
    return [x for x in out if x[1] > x[0]]


def _open(text: str, start: int, end: int, room: int, more: int) -> list[tuple[int, int]]:
    """Children of an oversized text node at its next natural boundary; a word is cut at the limit, ``more`` characters
    later where nothing is repeated before it."""
    for pattern in (_SENTENCE, _LINE, _SPACE):
        kids = _cut(text, start, end, pattern)
        if len(kids) > 1:
            return kids
    first = min(start + room + more, end)
    return [(start, first), *((i, min(i + room, end)) for i in range(first, end, room))]


@dataclass
class Unit:
    start: int
    end: int
    path: str
    whole: bool = True  # a subtree as it stands, which may be merged with its siblings


def _merge(units: list[Unit], path: str, room: int, more: int, text: bool) -> list[Unit]:
    """Merges neighbours, the two smallest together first, as long as they fit.

    A unit's size reaches from the end of the unit before.  The first unit of a text may be ``more`` characters longer.
    """
    n = len(units)
    if n < 2:
        return units
    left, right, alive = [i - 1 for i in range(n)], [i + 1 for i in range(n)], [True] * n

    def offer(i: int) -> None:
        j = right[i]
        if i >= 0 and j < n and units[i].whole and units[j].whole:
            lead = units[left[i]].end if left[i] >= 0 and text else units[i].start
            size = units[j].end - lead
            if size <= room + (more if left[i] < 0 else 0):
                heapq.heappush(heap, (size, i, j, units[i].end, units[j].end))

    heap: list[tuple[int, int, int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, a, b = heapq.heappop(heap)
        if not (alive[i] and alive[j] and right[i] == j and units[i].end == a and units[j].end == b):
            continue
        units[i] = Unit(units[i].start, units[j].end, path)
        alive[j] = False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [u for u, x in zip(units, alive) if x]


def _texts(text: str, start: int, end: int, path: str, lead: int, room: int, more: int) -> list[Unit]:
    """Units of one text node; ``lead`` is where the unit before ends.  Opened level by level, without recursion."""
    out: list[Unit] = []
    todo = [(start, end)]
    at = lead
    while todo:
        a, b = todo.pop()
        extra = more if at == start and not out else 0
        if b - at <= room + extra:
            out.append(Unit(a, b, path))
            at = b
        elif a - at >= room:  # the white space before it alone is too long: it is cut too
            out.append(Unit(at, at + room, path))
            at += room
            todo.append((a, b))
        else:
            kids = _open(text, a, b, room - (a - at), extra)
            todo += reversed(kids)
    return out


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces ``(start, end, section path)`` in order; together they cover all but white space."""
    room = limit - overlap

    def runs(node: Node) -> Iterator[list[Node]]:
        """Neighbouring children of one kind: texts of the section itself, or sections below it."""
        run: list[Node] = []
        for kid in node.kids:
            if run and (run[-1].level == TEXT) != (kid.level == TEXT):
                yield run
                run = []
            run.append(kid)
        if run:
            yield run

    def fold(node: Node, inner: dict[int, list[Unit]]) -> list[Unit]:
        if node.kids and node.end - node.start <= limit:
            return [Unit(node.start, node.end, node.path)]
        out: list[Unit] = []
        for run in runs(node):
            if run[0].level == TEXT:
                own: list[Unit] = []
                again = bool(out) and out[-1].path == node.path
                for t in run:
                    lead = own[-1].end if own else out[-1].end if again else t.start
                    own += _texts(text, t.start, t.end, node.path, lead, room, 0 if own or again else overlap)
                out += _merge(own, node.path, room, 0 if again else overlap, True)
            else:
                units = [u for kid in run for u in inner.pop(id(kid))]
                out += _merge(units, node.path, room, 0, False)
        if len(out) == 1:
            return out
        for u in out:
            u.whole = False
        return out

    # Post-order without recursion, as headings may nest deeply.
    done: dict[int, list[Unit]] = {}
    root = parse(text)
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if ready:
            done[id(node)] = fold(node, done)
        else:
            todo.append((node, True))
            todo += [(kid, False) for kid in node.kids if kid.level != TEXT]
    out: list[tuple[int, int, str]] = []
    for u in done[id(root)] if root.kids else []:
        start = max(out[-1][0], out[-1][1] - overlap) if out and out[-1][2] == u.path else u.start
        if start < u.start and u.end - start > limit:
            # Sections merged under their parent's path with a long gap before them: the gap is cut like text.
            for v in _texts(text, u.start, u.end, u.path, out[-1][1], room, 0):
                out.append((max(out[-1][0], out[-1][1] - overlap), v.end, v.path))
        else:
            out.append((start, u.end, u.path))
    return out


def divided(text: str, pieces: list[tuple[int, int, str]], limit: int = LIMIT) -> list[tuple[int, int]]:
    """The paragraphs above the limit, which the packing had to open: those with an end of a piece inside them."""
    ends = [e for _, e, _ in pieces]
    return [(a, b) for a, b in paragraphs(text) if b - a > limit and (i := bisect_right(ends, a)) < len(ends) and ends[i] < b]


def chunk(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(key, kind, ordinal, start_char, end_char, section_path)`` of the ``piece`` rows and ``paragraph`` rows of each text.

    Pieces have at most ``limit`` characters; paragraph rows are the paragraphs above the limit, found as those which the
    packing opened.  Null, empty and blank texts have no rows; of rows repeated under one key one stays; a null key is
    ignored; an empty table gives an empty result.  Repeats are dropped among the spans, which are a few per cent of
    the text, so no text is shuffled.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["key"], b["text"]):
                pieces = split(t, limit, overlap)
                out += [(k, "paragraph", i, s, e, None) for i, (s, e) in enumerate(divided(t, pieces, limit))]
                out += [(k, "piece", i, s, e, p) for i, (s, e, p) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["key", "kind", "ordinal", "start_char", "end_char", "section_path"])

    return rows.mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, kind string, ordinal int, start_char long, end_char long, section_path string").distinct()
