"""Texts that were read with the wrong character encoding: detection and repair.

Stage 1 maps characters back to the bytes of a legacy encoding and runs the byte structure of UTF-8 over them: a regular
expression (the automaton) finds maximal spans of well-formed multibyte sequences, and only those spans are decoded.
A span of two sequences or more, or of four bytes, that does not read as a word does not happen by chance and needs no
knowledge of any language.  A
lone sequence may be ordinary text (a letter and a quotation mark): it counts if its character is found in many more
texts of the corpus than the sequence is, or if the rest of its text was misread the same way, and never if a word would
mix scripts.  This is repeated until nothing changes, so damage of any number of layers is undone.

Stage 2 covers text of one single-byte encoding read as another, which has no byte structure: words are mapped the other
way, and a word is damaged if its mapped form is attested in many more texts than the word itself.  Where damage is
frequent that cannot hold; there a text is damaged if one way maps at least two thirds of its words (and three) to
attested forms that are more frequent, or whose letters go together where those of the words as they stand do not.
Counts cover the whole corpus; a word passes by its texts or by its distinct texts (told apart by hash), so copies of a
damaged text do not hide it.

Replacement characters and control characters of the C1 range are damage that cannot be undone here; such texts are
found and marked as not recovered.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import Scratch

#: Encodings whose misreading of UTF-8 is undone.  ``west`` is Windows-1252 with ISO-8859-1 for what it leaves out.
READ_AS = ("west", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859_2", "koi8_r", "cp1254")
#: (read as, written in) for single-byte texts.
SINGLE = (
    ("west", "cp1251"), ("west", "koi8_r"), ("west", "cp866"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "mac_cyrillic"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("mac_cyrillic", "cp1251"),
    ("mac_roman", "west"), ("west", "mac_roman"), ("west", "cp1250"), ("west", "iso8859_2"), ("cp1250", "west"), ("iso8859_2", "west"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"),
    ("cp437", "west"), ("cp850", "west"), ("west", "cp437"), ("west", "cp850"), ("cp1251", "west"), ("cp1250", "cp852"), ("west", "cp852"), ("cp437", "cp1250"),
)
#: A mapped word must be in at least so many texts, and in so many times more than the word as it stands.
ATTESTED, RATIO = 3, 5
#: A text is judged as a whole from so many mapped words on.
WHOLE = 3
_LONE = re.compile(r"(?<![^\s(«“])Ã (?=[^\W\d_])")
_LOST = re.compile("[�\u0080-\u0084\u0086-\u009f]")


def to_bytes(codec: str) -> dict[str, int]:
    """Byte of every character above ASCII that the encoding can produce."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode("cp1252" if codec == "west" else codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0x100):  # decoders let unassigned bytes through as control characters
        if codec == "west" or (b < 0xA0 and b not in out.values()):
            out.setdefault(chr(b), b)
    return out


def _char(codec: str, b: int) -> str:
    try:
        return bytes([b]).decode("cp1252" if codec == "west" else codec)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(maxsize=None)
def _automaton(codec: str) -> tuple[re.Pattern[str], dict[int, int]]:
    by = to_bytes(codec)

    def of(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in by.items() if lo <= b <= hi) + "]"

    tail = of(0x80, 0xBF)
    two = of(0xC2, 0xDF) + tail
    three = f"(?:{of(0xE0, 0xE0)}{of(0xA0, 0xBF)}|{of(0xE1, 0xEC)}{tail}|{of(0xED, 0xED)}{of(0x80, 0x9F)}|{of(0xEE, 0xEF)}{tail}){tail}"
    four = f"(?:{of(0xF0, 0xF0)}{of(0x90, 0xBF)}|{of(0xF1, 0xF3)}{tail}|{of(0xF4, 0xF4)}{of(0x80, 0x8F)}){tail}{tail}"
    return re.compile(f"(?:{two}|{three}|{four})+"), {ord(c): b for c, b in by.items()}


@lru_cache(maxsize=100_000)
def _script(c: str) -> str:
    """Script of a letter or mark, as the first word of its name; empty for anything else and for what all scripts share."""
    name = unicodedata.name(c, "").split(" ")[0] if unicodedata.category(c)[0] in "LM" else ""
    return "" if name in ("COMBINING", "VARIATION", "MODIFIER", "FEMININE", "MASCULINE", "MICRO", "FULLWIDTH", "HALFWIDTH") else name


#: Scripts written beside others without a space.
_EAST = frozenset(["CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "THAI"])


def _mixed(word: str) -> bool:
    """Whether letters of two alphabets touch."""
    kinds = [_script(c) for c in word]
    return any(a and b and a != b and a not in _EAST and b not in _EAST for a, b in zip(kinds, kinds[1:]))


def _wordlike(raw: str) -> bool:
    """Whether characters could be a piece of a word: letters of one script, without a capital after a small one."""
    return raw.isalpha() and len({_script(c) for c in raw}) == 1 and not any(a.islower() and b.isupper() for a, b in zip(raw, raw[1:]))


def _kind(c: str) -> str:
    """Script of a character; empty for what all scripts share."""
    if c < "\u0300" or "\u2000" <= c <= "\u218f" or "\uff00" <= c <= "\uffef":
        return _script(c)
    name = unicodedata.name(c, "").split(" ")[0]
    return "CJK" if "\u3000" <= c <= "\u303f" or (name in _EAST and name != "HANGUL") else "" if name == "COMBINING" else name


def _one_kind(word: str) -> bool:
    """Whether the characters of a short span are of one script; long spans do not happen by chance."""
    return len(word) > 3 or len({k for k in map(_kind, word) if k}) < 2


#: Signs that stand inside words: apostrophes, hyphens and dashes.
_JOINS = frozenset(["Pd", "Pf", "Pi"])


@lru_cache(maxsize=None)
def _double_bytes(written_in: str) -> re.Pattern[str]:
    by = to_bytes("west") | {chr(b): b for b in range(0x40, 0x7F)}
    of = lambda *r: "[" + "".join(re.escape(c) for c, b in by.items() if any(lo <= b <= hi for lo, hi in r)) + "]"
    if written_in == "euc_jp":
        return re.compile(f"(?:{of((0xA1, 0xF4))}{of((0xA1, 0xFE))}){{3,}}")
    return re.compile(f"(?:{of((0x81, 0x9F), (0xE0, 0xFC))}{of((0x40, 0x7E), (0x80, 0xFC))}){{3,}}")


def _japanese(text: str) -> tuple[str, int, str]:
    """Decodes spans of well-formed Shift-JIS or EUC-JP pairs of which at least half are kana or their marks."""
    table = _automaton("west")[1]
    for codec in ("shift_jis", "euc_jp"):
        n = 0

        def put(m: re.Match[str]) -> str:
            nonlocal n
            try:
                new = bytes(table.get(ord(c), ord(c)) for c in m.group()).decode(codec)
            except (UnicodeDecodeError, ValueError):
                return m.group()
            if 2 * sum("\u3000" <= c <= "\u30ff" for c in new) < len(new):
                return m.group()
            n += 1
            return new

        out = _double_bytes(codec).sub(put, text)
        if n:
            return out, n, codec
    return text, 0, ""


@dataclass(frozen=True)
class Stats:
    """Number of distinct texts that hold a character, and a lone sequence."""

    chars: dict[str, int] = field(default_factory=dict)
    raw: dict[str, int] = field(default_factory=dict)


@lru_cache(maxsize=50_000)
def _spans(run: str) -> tuple[tuple[str, tuple[tuple[int, int, str, bool], ...]], ...]:
    """Per encoding the well-formed spans of a run of characters above ASCII: start, end, decoded text, whether certain."""
    out = []
    for codec in READ_AS:
        found, table = _automaton(codec)
        spans = []
        for m in found.finditer(run):
            new = bytes(table[ord(c)] for c in m.group()).decode("utf-8")
            around = run[max(0, m.start() - 1) : m.start()] + new + run[m.end() : m.end() + 1]
            if not any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in new):
                spans.append((m.start(), m.end(), new, (len(new) > 1 or new > "\uffff") and not _wordlike(m.group()) and not _mixed(around) and _one_kind(new)))
        if spans:
            out.append((codec, tuple(spans)))
    return tuple(out)


_HIGH = re.compile(r"[^\x00-\x7f]{2,}")


def _found(text: str) -> dict[str, list[tuple[int, int, str, bool]]]:
    out: dict[str, list[tuple[int, int, str, bool]]] = {}
    for m in _HIGH.finditer(text):
        at = m.start()
        for codec, spans in _spans(m.group()):
            out.setdefault(codec, []).extend((at + a, at + b, new, sure) for a, b, new, sure in spans)
    return out


def _fits(text: str, a: int, b: int, new: str) -> bool:
    """Whether the one decoded character may stand where its sequence does."""
    raw, before, after = text[a:b], text[a - 1 : a], text[b : b + 1]
    script = _script(new)
    if not script:
        inside = bool(before and after and _script(before) and _script(after))
        touched = bool(_script(raw[0])) and _script(raw[0]) in (_script(c) for c in (before, after) if c)
        goes_on = len(raw) == 2 and before.isalpha() and not (before.islower() and raw[0].isupper())
        word = touched and (goes_on or raw.isalpha() and _wordlike(before * before.isalpha() + raw + after * after.isalpha()))
        return not word and unicodedata.category(new) != "Cc" and not (inside and unicodedata.category(new) not in _JOINS and new != "'")
    if any(x and x != script for x in (_script(c) for c in (before, after) if c)):
        return False
    # Capitals stay among capitals.
    return not (new.islower() and raw[0].isupper() and a > 1 and text[a - 2 : a].isupper() and text[a - 2 : a].isalpha())


def _lone(text: str, spans: list[tuple[int, int, str, bool]], stats: Stats, evident: bool) -> list[tuple[int, int, str]]:
    """The lone sequences of one encoding that are damage."""
    fits = [(a, b, new) for a, b, new, sure in spans if not sure and len(new) == 1 and _fits(text, a, b, new)]
    count = lambda x: (stats.chars.get(x[2], 0), stats.raw.get(text[x[0] : x[1]], 0))
    odd = {text[a:b] for a, b, new in fits if stats.chars.get(new, 0) >= ATTESTED and not text[a:b].isalpha()}
    long = {text[a:b] for a, b, new in fits if b - a > 2 and _script(new) and not text[a:b].isalpha()}
    evident = evident or len(long) > 1
    out = []
    for x in fits:
        n, r = count(x)
        raw = text[x[0] : x[1]]
        if (n >= ATTESTED and n >= RATIO * r) or (evident and not (r >= ATTESTED and r > n)) or (len(odd) > 1 and raw in odd):
            out.append(x)
    return out


def repair(text: str, stats: Stats = Stats()) -> tuple[str, int, str]:
    """Text with its spans decoded, their number, and the encodings they had been read as (outermost first)."""
    n, used = 0, []
    if any(_double_bytes(c).search(text) for c in ("shift_jis", "euc_jp")):
        text, n, kana = _japanese(text)
        used = [kana] if kana else []
    while True:  # each turn shortens the text
        best: tuple[tuple[bool, int], str, list[tuple[int, int, str]]] | None = None
        for codec, spans in _found(text).items():
            sure = [(a, b, new) for a, b, new, x in spans if x]
            take = sure + _lone(text, spans, stats, bool(sure) or codec in used)
            rank = (bool(sure), sum(b - a for a, b, _ in sure or take))
            if take and (best is None or rank > best[0]):
                best = (rank, codec, sorted(take))
        if best is None:
            break
        parts, at = [], 0
        for a, b, new in best[2]:
            parts += [text[at:a], new]
            at = b
        text = "".join([*parts, text[at:]])
        n += len(best[2])
        used.append(best[1])
    # A no-break space that was turned into a space after the lead byte of an accented a.
    lone = _LONE.subn("à ", text)
    return lone[0], n + lone[1], ",".join(used)


def _seen(text: str) -> list[str]:
    """Characters above ASCII and lone sequences of a text, each once; sequences have two characters or more."""
    out = {c for c in text if c > "\x7f"}
    for spans in _found(text).values():
        out.update(text[a:b] for a, b, new, sure in spans if not sure and len(new) == 1)
    return sorted(out)


def _remap(word: str, read_as: str, written_in: str) -> str | None:
    table = _automaton(read_as)[1]
    out = []
    for c in word:
        if c < "\x80":
            out.append(c)
        elif ord(c) in table:
            out.append(_char(written_in, table[ord(c)]))
        else:
            return None
    return "".join(out)


_RUN = re.compile("[ß-öø-ÿ\u0101-\u024fÀ-ÖØ-Þ]{3}")


def _implausible(word: str) -> bool:
    """Whether a word mixes scripts, has a capital after a small letter, a sign between letters, or a row of accented letters."""
    core = word.strip("0123456789")
    while core and not core[0].isalnum():
        core = core[1:]
    while core and not core[-1].isalnum():
        core = core[:-1]
    kinds = {_script(c) for c in core if c.isalpha()} - _EAST
    inner = any(a.islower() and b.isupper() and not (a.isascii() and b.isascii()) for a, b in zip(core, core[1:]))
    return len(kinds) > 1 or inner or any(not c.isalnum() for c in core) or bool(_RUN.search(core))


#: Words that hold a character above ASCII; no-break spaces may stand for letters.  Those of three characters or more are judged.
_WORD = r"((?<![0-9A-Za-z\u0080-\uffff])[0-9A-Za-z]*+[\u0080-\uffff][0-9A-Za-z\u0080-\uffff]*+)"


def recover(df: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """``(key, text, n_spans, codecs, lost, found)`` of every row with a character above ASCII.

    ``found`` is true for every text with wrongly decoded characters, ``lost`` where some of them cannot be recovered,
    ``text`` is the text as far as it was restored.  Null, empty and ASCII texts hold no such character and have no
    row; repeated keys are treated row by row; an empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"h": b.column("h"), "what": pa.array([_seen(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))})

    once = rows.select(F.xxhash64("text").alias("h"), "text").mapInArrow(seen, "h long, what array<string>").groupBy("h").agg(F.first("what").alias("what"))
    # Bounded by Unicode, not by the corpus: one row per character and per well-formed sequence of two to four bytes.
    known_what = once.select(F.explode("what").alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("n")).collect()
    held = scratch.spark.sparkContext.broadcast(Stats({r[0]: r[1] for r in known_what if len(r[0]) == 1}, {r[0]: r[1] for r in known_what if len(r[0]) > 1}))

    def stage1(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats = held.value
        for b in batches:
            got = [repair(t, stats) for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "text": [g[0] for g in got], "n_spans": [g[1] for g in got], "codecs": [g[2] for g in got], "lost": [bool(_LOST.search(g[0])) for g in got]})

    kind = df.schema[key].dataType.simpleString()
    fixed = scratch.put(rows.mapInPandas(stage1, f"key {kind}, text string, n_spans int, codecs string, lost boolean"))
    words = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(_WORD)), lambda w: F.length(w) > 2))
    pairs = fixed.select("key", F.xxhash64("text").alias("h"), words.alias("words")).select("key", "h", F.size("words").alias("odd"), F.explode("words").alias("word"))
    each = pairs.groupBy("word", "h").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.put(each.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")))

    def stage2(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, n, d in zip(b["word"], b["n"], b["d"]):
                for i, (a, z) in enumerate(SINGLE):
                    new = _remap(w, a, z)
                    if new and new != w:
                        inner = max(re.findall(r"[^\W\d_]{3,}", new.lower()), key=len, default="")
                        if not inner.isascii() and inner not in w.lower():
                            now, then = _implausible(w), _implausible(new)
                            if now or not then:  # else the word is good and its mapped form is damage, however often it occurs
                                out.append((w, n, d, i, inner, now and not then))
            yield pd.DataFrame(out, columns=["word", "n", "d", "pair", "form", "better"])

    forms = counts.mapInPandas(stage2, "word string, n long, d long, pair int, form string, better boolean")
    inner = counts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("word"), F.lit(r"(\p{L}{3,})")))).alias("form"), "n", "d")
    known = inner.groupBy("form").agg(F.sum("n").alias("n2"), F.sum("d").alias("d2")).filter(F.col("n2") >= ATTESTED)
    known_apart = F.col("d2") >= ATTESTED
    sure = (F.col("n2") >= RATIO * F.col("n")) | (known_apart & (F.col("d2") >= RATIO * F.col("d")))
    ways = forms.join(known, "form").filter(sure | (known_apart & (F.col("d2") > F.col("d"))) | F.col("better"))
    rare = F.max(F.when(sure, F.struct("n2", (-F.col("pair")).alias("p"))))
    best = ways.groupBy("word").agg(F.collect_list(F.struct("pair", "n2")).alias("ways"), (-rare["p"]).alias("sure"))
    mapped = pairs.join(scratch.put(best), "word").select("key", "odd", "word", "sure", F.explode("ways").alias("w")).withColumn("sure", F.coalesce(F.col("sure") == F.col("w.pair"), F.lit(False)))
    by_way = mapped.groupBy("key", F.col("w.pair").alias("pair")).agg(
        F.collect_set("word").alias("words"), F.collect_set(F.when(F.col("sure"), F.col("word"))).alias("sure"), F.count_if("sure").alias("n_sure"), F.sum("w.n2").alias("n2"), F.max("odd").alias("odd")
    )
    size = F.size("words")
    whole = F.max(F.when((size >= WHOLE) & (3 * size >= 2 * F.col("odd")), F.struct(size.alias("size"), "n2", (-F.col("pair")).alias("p"), "words")))
    places = F.max(F.when(F.col("n_sure") > 0, F.struct("n_sure", (-F.col("pair")).alias("p"))))
    judged = by_way.groupBy("key").agg(whole.alias("whole"), places.alias("places"), F.array_distinct(F.flatten(F.collect_list("sure"))).alias("sure"))
    hits = judged.filter("whole is not null or places is not null").select("key", (-F.coalesce("whole.p", "places.p")).alias("pair"), F.coalesce("whole.words", "sure").alias("words"))
    joined = fixed.join(hits, "key", "left")

    def stage3(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, codecs = [], []
            for t, c, p, ws in zip(b["text"], b["codecs"], b["pair"], b["words"]):
                if ws is not None and p == p and p is not None:
                    a, z = SINGLE[int(p)]
                    bad = set(ws)
                    odd = [w for w in re.findall(r"[0-9A-Za-z\u0080-￿]+", t) if not w.isascii()]
                    every = 3 * sum(w in bad for w in odd) >= len(odd)  # the whole text was misread, not places in it
                    t = re.sub(r"[0-9A-Za-z\u0080-￿]+", lambda m: (_remap(m.group(), a, z) or m.group()) if every or m.group() in bad else m.group(), t)
                    c = ",".join(x for x in (c, f"{a}>{z}") if x)
                texts.append(t)
                codecs.append(c)
            yield pd.DataFrame({"key": b["key"], "text": texts, "n_spans": b["n_spans"], "codecs": codecs, "lost": [bool(_LOST.search(t)) for t in texts], "found": (b["n_spans"] > 0) | b["lost"] | b["pair"].notna()})

    return joined.select("key", "text", "n_spans", "codecs", "lost", "pair", "words").mapInPandas(stage3, f"key {kind}, text string, n_spans int, codecs string, lost boolean, found boolean")
