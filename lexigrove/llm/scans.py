"""Repair of text from scanned pages.

Running headers and page numbers are taken out line by line: headers of known forms, and lines whose skeleton (digits and
words of the title abstracted) is seen to cut sentences apart in several sources of the corpus. What remains is one stream of
words, whose line breaks are decoded jointly with its characters: a lattice over the words around each suspicious place allows
a word to stand as it is, to be a confusion of another, to be joined over a line end with the mark dropped or kept, to be two
words run together or one that was split; the cheapest path by word frequencies wins. Words come from the corpus itself: counts
over all records. A word gives way to a reading by one rule, the ratio of their counts (`margin`), whatever the size of the
corpus: each worker holds the counts of the most frequent CORE_WORDS, and a text with other words is decoded once the counts of
these and of their readings have been joined to it, so that all texts are decoded in one way and by the counts of all records.
Paragraph boundaries are then chosen by dynamic programming over the lines.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.shared import join_heavy, join_large, materialize, table

#: Words that each worker holds, the most frequent ones; the counts of rarer ones are joined to the texts that have them.
CORE_WORDS = 100_000
#: A reading must be so many times as frequent as the word that stands: at least, and if the word ends in a digit (names do).
LEAST_MARGIN, DIGIT_MARGIN = 2, 15
#: Part of all occurrences from which on a word counts as common, so that it may be half of a compound or of words run together.
COMMON = 3e-5
#: A token with more confusable digits and signs than this is data (a hash, an address), no misread word.
MOST_ODD = 8
#: A line is a header if its skeleton cuts sentences apart in so many sources, in such a part of its occurrences.
HEADER_SOURCES, HEADER_PART = 3, 0.15
#: A header leaves so much of the text's width free, and its skeleton has at most so many parts.
HEADER_WIDTH, HEADER_PARTS = 0.85, 8

# Marks that break a word at a line end.
BREAK_MARKS = "-‐‑¬\xad"
# What characters of a word come out as, and what they were; first what doesn't occur inside words, then what does.
ODD = {"5": "s", "0": "o", "!": "i", "1": "li", "|": "l", "(": "c", "9": "g", "8": "b", "6": "b", "r·": "r", "$": "s", "@": "a", "€": "e", "3": "e", "4": "a"}
ALIKE = {"c": "e", "f": "t", "á": "a", "b": "h", "v": "y", "m": ("in", "rn"), "w": "vi", "rm": "nn", "rn": "m", "cl": "d", "d": "cl", "ii": "u", "vv": "w", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
_ODD_SIGNS = frozenset("".join(ODD)) - {"r"}
# Words that introduce a page number.
_PAGE = r"(?:page|pg\.?|p\.|seite|s\.|página|pág\.?|page)"

PAGE_NUMBER = re.compile(rf"(?:{_PAGE}\s*\d{{1,4}}(?:\s*(?:of|/|von|sur|de)\s*\d{{1,4}})?|\d{{1,4}}\s*(?:/|of)\s*\d{{1,4}}|[-–—·•]\s*\d{{1,4}}\s*[-–—·•]|\[\d{{1,4}}\]|\d{{1,4}}|(?=[ivxl])(?:x[lc]|l?x{{0,3}})(?:ix|iv|v?i{{0,3}}))", re.IGNORECASE)
_WITH_NUMBER = re.compile(r"(\d{1,4})\s{2,}(\S.*)|(.*\S)\s+[|·•]\s+(\d{1,4})")
_JOURNAL = re.compile(r"[A-ZÀ-Þ][\w-]*(?: [A-Z][\w-]*)? (?:Papers|Journal|Proceedings|Transactions|Letters|Reports|Bulletin), Vol\. \d+")
_EDGE = "\"“”„«»‘’'.,;:?)]}*_`#>~…[{¿¡"
_ENDED = re.compile(r"[.!?:…][\"”’»)\]]*$")
_FORMAT = re.compile(r"\s*(?:#{1,6}\s|[-*+•]\s|\d{1,3}[.)]\s|\||>|```|---)")

NOISES = ("hyphen", "misread", "header", "page_number")


def is_header(line: str, title: str | None) -> bool:
    """Whether a line, without outer blanks and page number, is a running header of a text with this title."""
    if _JOURNAL.fullmatch(line):
        return True
    if not title or not line:
        return False
    low, of = line.lower(), title.lower()
    if len(low) >= 8 and (low == of or (len(low) >= 24 and of.startswith(low))):
        return True
    names = re.findall(r"[^\s:,;]+", of)
    return bool(names) and (low == f"{names[0]} et al." or low == f"notes on {names[-1]}")


def line_kinds(lines: list[str], title: str | None, learned: frozenset[int] | set[int] = frozenset()) -> list[tuple[bool, bool]]:
    """(header, page number) of each line; lines inside code fences are neither. learned: headers that the corpus tells of."""
    out, fenced = [], False
    for k, raw in enumerate(lines):
        s = raw.strip()
        if s.startswith("```"):
            fenced = not fenced
        if not s or fenced:
            out.append((False, False))
        elif k in learned:
            out.append((True, bool(_WITH_NUMBER.fullmatch(s))))
        elif PAGE_NUMBER.fullmatch(s):
            out.append((False, True))
        elif (m := _WITH_NUMBER.fullmatch(s)) and is_header((m[2] or m[3]).strip(), title):
            out.append((True, True))
        else:
            out.append((is_header(s, title), False))
    return out


_PART = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def skeleton(line: str, of_title: set[str]) -> str:
    """The parts of a line in lower case, numbers as # and words of the title as T, runs of either as one."""
    out: list[str] = []
    for part in _PART.findall(line.lower()):
        x = "#" if part.isdigit() else "T" if part in of_title else part
        if not out or x != out[-1] or x not in "#T":
            out.append(x)
    return " ".join(out)


def header_candidates(lines: list[str], title: str | None) -> list[tuple[int, str, bool]]:
    """Short lines that may be running headers: (line, skeleton, whether it cuts a sentence apart here).

    It does if the line before it is full and ends no sentence, the line after it begins in lower case, and that line's first
    word would have had room behind it. A second skeleton leaves the first word open, if two words remain.
    """
    width = max(map(len, lines), default=0)
    of_title = {x for x in _PART.findall((title or "").lower()) if len(x) > 3 and x.isalpha()}
    out, fenced = [], False
    for k, line in enumerate(lines):
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
        if not s or fenced or len(s) > HEADER_WIDTH * width or _FORMAT.match(line) or PAGE_NUMBER.fullmatch(s):
            continue
        m = _WITH_NUMBER.fullmatch(s)
        form = skeleton((m[2] or m[3]) if m else s, of_title)
        parts = form.split(" ")
        if len(parts) > HEADER_PARTS or not any(x == "T" or x.isalpha() for x in parts):
            continue
        before, after = lines[k - 1].rstrip() if k else "", lines[k + 1] if k + 1 < len(lines) else ""
        first = (after.split() or [""])[0]
        cuts = first[:1].islower() and len(before) >= 0.6 * width and not _ENDED.search(before) and len(s) + 1 + len(first) <= HEADER_WIDTH * width
        out.append((k, form, cuts))
        at = next((i for i, x in enumerate(parts) if x != "T" and x.isalpha()), None)
        if at is not None and sum(x != "T" and x.isalpha() for x in parts) > 2:
            out.append((k, " ".join([*parts[:at], "*", *parts[at + 1 :]]), cuts))
    return out


def margin(word: str, extra: float) -> float:
    """How many times as frequent as this word a reading must be to win, by the cost of the reading's confusions."""
    return max(DIGIT_MARGIN if word[-1:].isdigit() else LEAST_MARGIN, math.exp(extra - 1))


class Words:
    """Costs of words by their counts: the negative logarithm of their frequency, and what operations cost on top."""

    UNKNOWN, LETTER, CHARACTER, JOIN, MERGE = 2.0, 4.0, 1.5, 1.0, 5.0

    def __init__(self, counts: dict[str, int], occurrences: int | None = None):
        self.counts, self.added = counts, []  # a word that isn't among the counts doesn't occur
        occurrences = sum(counts.values()) if occurrences is None else occurrences  # of all words, also where only some are held
        self.total = math.log(max(2, occurrences))
        self.common = least_common(occurrences)
        self.seen: dict[str, bool] = {}
        self.fixes: dict[str, tuple[float, str] | None] = {}

    def add(self, more: dict[str, int]) -> None:
        """Counts that a text needs besides; those of earlier texts go when they are many."""
        if len(self.added) > 200_000:
            for word in self.added:
                self.counts.pop(word, None)
            self.added.clear()
        self.added += [word for word in more if word not in self.counts]
        self.counts.update(more)

    def cost(self, word: str) -> float | None:
        n = self.counts.get(word)
        return None if n is None else self.total - math.log(n)

    def sound(self, word: str) -> float | None:
        """The cost of a known word that isn't itself a frequent confusion of another."""
        return None if word in self.counts and self.fix(word) else self.cost(word)

    def plain(self, raw: str) -> bool:
        """Whether a token needs no look: a known word without a far more frequent reading, or nothing with letters."""
        hit = self.seen.get(raw)
        if hit is None:
            w = core(raw)
            hit = self.fix(raw) is None if w in self.counts else not any(c.isalpha() for c in w)
            name = w.rstrip("0123456789-")
            if not hit and name in self.counts and w[len(name) : len(name) + 1] == "-":
                hit = True  # a name with a number; digits right after it may be a confused letter, so that readings are tried
            if len(self.seen) < 400_000:
                self.seen[raw] = hit
        return hit

    def fix(self, raw: str) -> tuple[float, str] | None:
        """The cheapest reading that a token gives way to, with its cost; None if it had better stand.

        The reading must be `margin` times as frequent as the word that stands, so that the size of the corpus doesn't matter.
        """
        if raw not in self.fixes:
            if len(self.fixes) > 400_000:
                self.fixes.clear()
            w = core(raw)
            best, own = None, self.counts.get(w, 1)
            for word, extra in readings_of(raw):
                n = self.counts.get(word, 0)
                if n > own * margin(w, extra):
                    best = max(best or (-math.inf, ""), (math.log(n) - extra, word))
            self.fixes[raw] = best and (self.total - best[0], best[1])
        return self.fixes[raw]


def least_common(occurrences: int) -> float:
    """The count over which a word is common."""
    return max(1, COMMON * occurrences)


def core(raw: str) -> str:
    """The word in a token: without outer punctuation, in lower case."""
    return raw.strip(_EDGE + "()!|-–—/").lower()


def forms(raw: str) -> list[str]:
    """The words that a token may hold, also with an outer character that may be a confused letter."""
    w = core(raw)
    if not w:
        return []
    out = [w]
    low = raw.lower()
    at = low.find(w)
    before, after = low[:at][-1:], low[at + len(w) :][:1]
    if before in ("(", "!", "|") and before:
        out.append(before + w)
    if after in ("!", "|", "(") and after:
        out.append(w + after)
    return out


def key_of(raw: str) -> str:
    """The word in a token with the outer characters that may be confused letters; it has the same forms as the token."""
    found = forms(raw)
    w = found[0] if found else ""
    return next((x for x in found if x != w and x.endswith(w)), w) + next((x[-1] for x in found if x != w and x.startswith(w)), "")


def readings_of(raw: str) -> list[tuple[str, float]]:
    """Readings of all forms of a token."""
    return [x for form in forms(raw) for x in readings(form)]


def readings(word: str) -> list[tuple[str, float]]:
    """Words that this one may have come from, with the cost of the confusions: up to three odd characters and one letter."""
    out: dict[str, float] = {}
    if sum(c in _ODD_SIGNS for c in word) > MOST_ODD:
        return []

    def odd(w: str, cost: float, depth: int) -> None:
        for bad, goods in ODD.items():
            at = w.find(bad)
            while at >= 0:
                for good in goods:
                    x = w[:at] + good + w[at + len(bad) :]
                    if cost + Words.CHARACTER < out.get(x, 99):
                        out[x] = cost + Words.CHARACTER
                        if depth:
                            odd(x, cost + Words.CHARACTER, depth - 1)
                at = w.find(bad, at + 1)

    def alike(w: str, cost: float) -> None:
        for bad, goods in ALIKE.items():
            at = w.find(bad)
            while at >= 0:
                for good in (goods,) if isinstance(goods, str) else goods:
                    x = w[:at] + good + w[at + len(bad) :]
                    if cost + Words.LETTER < out.get(x, 99):
                        out[x] = cost + Words.LETTER
                at = w.find(bad, at + 1)

    odd(word, 0.0, 2)
    alike(word, 0.0)
    for x, c in list(out.items()):
        if c == Words.CHARACTER:  # one odd character and one letter
            alike(x, c)
    out.pop(word, None)
    return list(out.items())


def _dressed(raw: str, word: str) -> str:
    """The token with its word replaced, in the letter case of the old one."""
    w = core(raw)
    low = raw.lower()
    at = low.find(w)
    lead, tail = raw[:at], raw[at + len(w) :]
    if len(word) >= len(w) and lead[-1:] in ("(", "!", "|") and lead and word not in (w,) and any(word.endswith(x) or x in word for x in (w,)) and not word.startswith(w[:1]):
        lead = lead[:-1]
    old = raw[at : at + len(w)]
    if old[:1].isupper() or (old[:1] in ODD and word[:1].isalpha() and old[1:2].isupper()):
        word = word.upper() if len(old) > 2 and old.upper() == old else word[:1].upper() + word[1:]
    return lead + word + tail


class Stream:
    """The tokens of de-lined text, and what broke the word at a line end (with the blanks after it) by the token's place."""

    __slots__ = ("marks", "raws")

    def __init__(self, raws: list[str], marks: dict[int, str]):
        self.raws, self.marks = raws, marks


def stream(lines: list[str]) -> Stream:
    """The tokens of de-lined text; the last of a line that ends in a mark keeps the mark apart."""
    raws: list[str] = []
    marks: dict[int, str] = {}
    filled = [x for x in lines if x.strip()]
    for k, line in enumerate(filled):
        raws += line.split()
        last = raws[-1]
        if last[-1] in BREAK_MARKS and last[-2:-1].isalpha() and k + 1 < len(filled):
            marks[len(raws) - 1] = last[-1] + line[len(line.rstrip()) :]
            raws[-1] = last[:-1]
    return Stream(raws, marks)


class Path:
    """A decoded stretch: tokens to give out, and noises met."""

    def __init__(self):
        self.out: list[str] = []
        self.at: list[int] = []  # of each word given out, the first token that it comes from
        self.noises: set[str] = set()


def asked(tokens: Stream, counts: dict[str, int], sure: dict[str, str]) -> set[str]:
    """Keys (key_of) of the words whose counts, and whose readings', decode needs and `counts` doesn't have. sure: what was found before, by token.

    A word that is held gives way only to more frequent ones, which are held too; so are all common words, of which it takes a
    compound, or words run together or split, to consist.
    """
    raws, found = tokens.raws, set()
    broken = [x for i in tokens.marks if i + 1 < len(raws) for x in (raws[i] + raws[i + 1], raws[i] + "-" + raws[i + 1])]
    for raw in (*raws, *broken):
        key = sure.get(raw)
        if key is None:
            w = core(raw)
            key = "" if w in counts or not any(map(str.isalpha, w)) else key_of(raw)
            if len(sure) < 400_000:
                sure[raw] = key
        if key:
            found.add(key)
    return found


def decode(tokens: Stream, words: Words) -> Path:
    """The cheapest reading of the tokens."""
    raws, marks, seen, plain = tokens.raws, tokens.marks, words.seen, words.plain
    path, n, done = Path(), len(raws), 0
    known = seen.get
    for i, raw in enumerate(raws):
        if i < done or ((known(raw) or plain(raw)) and i not in marks):
            continue
        j = i + 1
        while j < n and (j in marks or not (known(raws[j]) or plain(raws[j])) or j - 1 in marks):
            j += 1
        j = min(n, j + 1)  # the next word, with which the last may have been one
        path.out += raws[done:i]
        path.at += range(done, i)
        _lattice(raws[i:j], {k - i: marks[k] for k in range(i, j) if k in marks}, words, path, i)
        done = j
    path.out += raws[done:]
    path.at += range(done, n)
    return path


def _lattice(toks: list[str], marks: dict[int, str], words: Words, path: Path, start: int) -> None:
    n = len(toks)
    best: list[tuple] = [(0.0, None)] + [(math.inf, None)] * n

    def arc(i: int, j: int, cost: float, out: list[str], noises: tuple = ()) -> None:
        if best[i][0] + cost < best[j][0] - 1e-12:
            best[j] = (best[i][0] + cost, (i, out, noises))

    unknown = words.total + Words.UNKNOWN
    for i in range(n):
        raw = toks[i]
        if i in marks and i + 1 < n:
            _joins(raw, marks[i], toks[i + 1], words, lambda c, out, noises, i=i: arc(i, i + 2, c, out, noises))
            continue
        w = core(raw)
        c = words.cost(w)
        if words.plain(raw):
            arc(i, i + 1, c if c is not None else 0.0, [raw])
        else:
            fixed = words.fix(raw)
            if fixed:
                arc(i, i + 1, fixed[0], [_dressed(raw, fixed[1])], ("misread",))
            arc(i, i + 1, unknown, [raw])
            for k in range(3, len(w) - 2):
                a, b = words.counts.get(w[:k], 0), words.counts.get(w[k:], 0)
                if a > words.common and b > words.common and w.isalpha():
                    arc(i, i + 1, words.cost(w[:k]) + words.cost(w[k:]) + Words.MERGE, [raw[: raw.lower().find(w) + k], raw[raw.lower().find(w) + k :]])
        if i + 1 < n and i + 1 not in marks and raw[-1:].isalpha() and toks[i + 1][:1].islower():
            both = core(raw + toks[i + 1])
            if words.counts.get(both, 0) > words.common and not (words.plain(raw) and words.plain(toks[i + 1])):
                arc(i, i + 2, words.cost(both) + Words.MERGE, [raw + toks[i + 1]])
    steps, j = [], n
    while j:
        i, out, noises = best[j][1]
        steps.append((i, out, noises))
        j = i
    for i, out, noises in reversed(steps):
        path.out += out
        path.at += [start + i] * len(out)
        path.noises.update(noises)


def _joins(a: str, marked: str, b: str, words: Words, arc) -> None:
    """Readings of a word that a mark at a line end breaks or belongs to."""
    mark = marked[0]
    joined, kept = a + b, a + "-" + b
    j, h = core(joined), core(kept)
    foreign = 6.0 if mark not in "-‑" or len(marked) > 1 else 0.0
    unknown = words.total + Words.UNKNOWN
    cj, ch = words.sound(j), words.sound(h)
    if cj is not None:
        arc(cj + Words.JOIN, [joined], ("hyphen",))
    elif fixed := words.fix(joined):
        arc(fixed[0] + Words.JOIN, [_dressed(joined, fixed[1])], ("hyphen", "misread"))
    if ch is not None:
        arc(ch + 0.5 + foreign, [kept], ())
    elif cj is None and (fixed := words.fix(kept)):
        arc(fixed[0] + 0.5 + foreign, [_dressed(kept, fixed[1])], ("misread",))
    x, y = core(a), core(b)
    first = re.sub(r"^\W+", "", b)[:1]
    compound = not first.islower() or (words.counts.get(x, 0) > words.common and words.counts.get(y, 0) > words.common)
    if cj is None and ch is None:
        arc(unknown + foreign + (0.0 if compound else 4.0), [kept], ())
        if first.islower():
            arc(unknown + Words.JOIN, [joined], ("hyphen",))


def _read(text: str, title: str | None, words: Words, learned: frozenset[int] | set[int], whole: bool) -> tuple[list[str], set[str]]:
    """Paragraphs (if the whole is wanted) and noises, of one decoding of the text."""
    lines = text.split("\n")
    kinds = line_kinds(lines, title, learned)
    noises = {x for x, k in (("header", 0), ("page_number", 1)) if any(kind[k] for kind in kinds)}
    groups = paragraphs(lines, kinds) if whole else [[x for x, (h, p) in zip(lines, kinds, strict=True) if not h and not p]]
    path = decode(stream([line for group in groups for line in group]), words)
    parts, tokens, done = [], 0, 0
    for group in groups if whole else ():
        tokens += sum(len(line.split()) for line in group)
        until = bisect_left(path.at, tokens)  # a word broken over the edge goes to the first
        if until > done:
            parts.append(re.match(r"\s*", group[0]).group() + " ".join(path.out[done:until]))
        done = until
    return parts, noises | path.noises


def examine(text: str, title: str | None, words: Words, learned: frozenset[int] | set[int] = frozenset()) -> tuple[set[str], list]:
    """Noises of a text, and what is left open: nothing, as `words` has all counts."""
    return _read(text, title, words, learned, False)[1], []


def _asked(text: str, title: str | None, counts: dict[str, int], learned: frozenset[int] | set[int], sure: dict[str, str]) -> set[str]:
    lines = text.split("\n")
    return asked(stream([x for x, (h, p) in zip(lines, line_kinds(lines, title, learned), strict=True) if not h and not p]), counts, sure)


def paragraphs(lines: list[str], kinds: list[tuple[bool, bool]]) -> list[list[str]]:
    """Lines grouped into paragraphs, without headers and page numbers, by dynamic programming over the line breaks.

    A break costs by the evidence against it: a line before it that ends no sentence, a line after it in lower case, no blank
    line. A join costs by the evidence against that: a blank line, a short line before it, a sentence's end. Blank lines
    around a line taken out are weak evidence. A lone line as a paragraph costs extra, unless it has a form of its own.
    """
    kept: list[tuple[str, float]] = []  # line, evidence of blank lines before it
    blank, cut = 0.0, False
    for line, (h, p) in zip(lines, kinds, strict=True):
        if h or p:
            cut = True
        elif not line.strip():
            blank = 1.0
        else:
            kept.append((line.rstrip(), 0.25 if blank and cut else blank))
            blank, cut = 0.0, False
    if not kept:
        return []
    lengths = sorted(len(x) for x, _ in kept)
    width = lengths[int(0.8 * (len(lengths) - 1))]
    form = [bool(_FORMAT.match(x)) for x, _ in kept]
    fence, fenced = False, []
    for x, _ in kept:
        mark = x.strip().startswith("```")
        fenced.append(fence or mark)
        fence ^= mark
    back: list[list[tuple[int, bool]]] = [[(0, True), (0, True)]]
    lone = lambda k: 0.0 if form[k] else 1.5
    cost = [[math.inf, 0.0]]  # of each line: in a paragraph with the one before it, or the first of its own
    for k in range(1, len(kept)):
        (a, _), (b, blank) = kept[k - 1], kept[k]
        ended = bool(_ENDED.search(a))
        join = 6.0 * blank + (2.0 if len(a) < 0.7 * width and ended else 0.0)
        split = (0.0 if blank >= 1 else 2.0 - blank) + (0.0 if ended else 2.5) + (3.0 if b.lstrip()[:1].islower() else 0.0)
        if form[k] or fenced[k] or (form[k - 1] and kept[k - 1][0].lstrip()[:1] in "#|"):
            split, join = 0.0, 20.0
        now, way = [math.inf, math.inf], [(0, False), (0, False)]
        for s, c in enumerate(cost[-1]):
            if c + join < now[0]:
                now[0], way[0] = c + join, (s, False)
            extra = lone(k - 1) if s == 1 else 0.0
            if c + split + extra < now[1]:
                now[1], way[1] = c + split + extra, (s, True)
        cost.append(now)
        back.append(way)
    last = [cost[-1][0], cost[-1][1] + lone(len(kept) - 1)]
    s, starts = int(last[1] < last[0]), []
    for k in range(len(kept) - 1, 0, -1):
        s_before, is_break = back[k][s]
        if is_break:
            starts.append(k)
        s = s_before
    starts = [0, *reversed(starts), len(kept)]
    return [[x for x, _ in kept[a:b]] for a, b in pairwise(starts)]


def repair(text: str, title: str | None, words: Words, learned: frozenset[int] | set[int] = frozenset()) -> tuple[list[str], list[str]]:
    """Paragraphs of the text in continuous form, and the noises taken out."""
    parts, noises = _read(text, title, words, learned, True)
    return parts, sorted(noises)


def first_look(records: DataFrame) -> DataFrame:
    """What one pass over the texts gives: rows of (word, n), and rows of (record, line, form, cuts, source) for short lines.

    Words broken at line ends and what follows them aren't counted.
    """

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()

        def words() -> pd.DataFrame:
            some = [(w, k, None, None, None, None, None) for w, k in n.items() if any(map(str.isalpha, w))]
            n.clear()
            return pd.DataFrame(some, columns=["word", "n", "record", "line", "form", "cuts", "source"])

        for frame in frames:
            raw: Counter[str] = Counter()
            heads = []
            for record, source, title, text in zip(frame["record"], frame["source"], frame["title"], frame["text"], strict=True):
                skip, lines = False, text.split("\n")
                for line in lines:
                    toks = line.split()
                    if not toks:
                        continue
                    first = 1 if skip else 0
                    skip = toks[-1][-1] in BREAK_MARKS
                    raw.update(toks[first : len(toks) - skip])
                heads += [(record, line, form, cuts, source) for line, form, cuts in header_candidates(lines, title if isinstance(title, str) else None)]
            for w, k in raw.items():
                n[core(w)] += k
            if heads:
                yield pd.DataFrame(heads, columns=["record", "line", "form", "cuts", "source"]).assign(word=None, n=None)
            if len(n) > 500_000:
                yield words()
        yield words()

    return records.select("record", "source", "title", "text").mapInPandas(look, "word string, n bigint, record bigint, line int, form string, cuts boolean, source bigint")


def header_lines(looked: DataFrame) -> DataFrame:
    """record and the lines of it whose skeleton is that of running headers."""
    short = looked.where(F.col("form").isNotNull())
    forms_ = (
        short.groupBy("form", "source").agg(F.count("*").alias("n"), F.sum(F.col("cuts").cast("int")).alias("cuts"))
        .groupBy("form").agg(F.sum("n").alias("n"), F.sum("cuts").alias("cuts"), F.sum((F.col("cuts") > 0).cast("int")).alias("sources"))
        .where((F.col("sources") >= HEADER_SOURCES) & (F.col("cuts") >= HEADER_PART * F.col("n")))
    )
    forms_ = materialize(forms_, "headers")
    return join_heavy(short.select("record", "line", "form"), forms_.select("form", "n"), ["form"], "n").groupBy("record").agg(F.collect_set("line").alias("learned"))  # lines of one text


def core_words(counts: DataFrame, most: int = CORE_WORDS, least: int = 1) -> tuple[dict[str, int], int, bool]:
    """The most frequent words, at most `most` that occur `least` times, and all common words (1 / COMMON at most); how often all words occur; whether these are all.

    They are all that occur as often as a count found on the histogram of counts.
    """
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise(1000 + F.floor(64 * F.log2(F.col("n") / 1000)))
    sizes = counts.groupBy(step.cast("int").alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n"), F.sum("n").alias("all")).orderBy(F.col("step").desc()).collect()  # 1,000 steps and 64 for each doubling
    occurrences, total, at = sum(r["all"] for r in sizes), 0, math.inf
    for r in sizes:
        total += r.words
        if total > most or r.n < least:
            break
        at = r.n
    at = min(at, math.floor(least_common(occurrences)) + 1)
    known = {r.word: r.n for r in counts.where(F.col("n") >= at).collect()}
    return known, occurrences, len(known) == sum(r.words for r in sizes)


def identified(records: DataFrame) -> DataFrame:
    """Records with text and their identity; source tells records of one title together, or of none each by itself."""
    record = F.xxhash64("record_table", "record_key", "title", "text")
    return records.select("record_table", "record_key", "title", "text").where(F.length("text") > 0).select("*", record.alias("record"), F.when(F.length("title") > 0, F.xxhash64("title")).otherwise(record).alias("source"))


def candidates_of(key: str) -> set[str]:
    """The words whose counts decide on a key: its own, the name in a name with a number, and all readings."""
    w = core(key)
    return {w, w.rstrip("0123456789-"), *(x for x, _ in readings_of(key))}


TEXTS = "record_table string, record_key string, text string, n_paragraphs int, noises array<string>"


class Scans:
    """Records decoded: `read` has a row for each noise (noise) and, with texts, each text (text, n_paragraphs); `told` the counts joined.

    records: record_table, record_key, title, text. Null and empty texts have no rows; a null title only leaves headers that
    repeat the title unseen. Whole texts of any length are read. Further columns are dropped. core_limit and core_count (the
    least count of a core word) only tell which counts a worker has at once and which are joined; the words that a text is
    decoded by are the same.
    """

    def __init__(self, records: DataFrame, core_limit: int, core_count: int, texts: bool):
        records = identified(records)
        looked = materialize(first_look(records), "looked")
        counts = materialize(looked.where(F.col("word") != "").groupBy("word").agg(F.sum("n").alias("n")), "words")
        known, occurrences, complete = core_words(counts, core_limit, core_count)
        sent = records.sparkSession.sparkContext.broadcast(known)
        records = records.join(materialize(header_lines(looked), "heads"), "record", "left")

        def look(told: bool):
            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                core_, sure = sent.value, {}
                words = Words(dict(core_) if told else core_, occurrences)
                for frame in frames:
                    rows = []
                    for of, at, key, title, text, learned, more in zip(*(frame[x] for x in ("record", "record_table", "record_key", "title", "text", "learned", "more")), strict=True):
                        title, learned = title if isinstance(title, str) else None, frozenset() if learned is None else set(learned)
                        if told:
                            words.add({x["word"]: x["n"] for x in more} if more is not None else {})
                        elif not complete and (keys := _asked(text, title, core_, learned, sure)):
                            rows += [(of, at, key, None, k, None, None) for k in keys]
                            continue
                        parts, noises = _read(text, title, words, learned, texts)
                        rows += [(of, at, key, x, None, None, None) for x in noises]
                        if texts:
                            rows.append((of, at, key, None, None, "\n\n".join(parts), len(parts)))
                    yield pd.DataFrame(rows, columns=["record", "record_table", "record_key", "noise", "asked", "text", "n_paragraphs"])

            return run

        def wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [(k, x) for k in frame["asked"] for x in candidates_of(k) if x and x not in sent.value]
                yield pd.DataFrame(rows, columns=["asked", "word"])

        schema = "record bigint, record_table string, record_key string, noise string, asked string, text string, n_paragraphs int"
        more = "array<struct<word: string, n: bigint>>"
        seen = materialize(records.withColumn("more", F.lit(None).cast(more)).mapInPandas(look(False), schema), "seen")
        left = seen.where(F.col("asked").isNotNull()).select("record", "asked")
        found = join_large(left.select("asked").distinct().mapInPandas(wanted, "asked string, word string"), counts, ["word"])
        self.told = join_large(left, materialize(found, "found"), ["asked"]).groupBy("record").agg(F.collect_set(F.struct("word", "n")).alias("more"))  # of one text
        self.read = seen.where(F.col("asked").isNull())
        if not complete:
            again = join_large(records.dropDuplicates(["record"]), left.select("record").distinct(), ["record"], "left_semi")
            self.read = self.read.unionByName(materialize(join_large(again, self.told, ["record"], "left").mapInPandas(look(True), schema), "read"))


def noisy(records: DataFrame, core_limit: int = CORE_WORDS, core_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """Noises found (record_table, record_key, noise), and the counts that were joined to records.

    A row for each record and noise in its text; rows repeated with their key count once, a key with several texts has the
    noises of all. Records and parameters as in Scans.
    """
    scans = Scans(records, core_limit, core_count, False)
    return scans.read.where(F.col("noise").isNotNull()).select("record_table", "record_key", "noise").distinct(), scans.told


def repaired(records: DataFrame, core_limit: int = CORE_WORDS, core_count: int = 1) -> DataFrame:
    """record_table, record_key, text in continuous paragraphs, n_paragraphs, noises; a row for each distinct record row with text."""
    read = Scans(records, core_limit, core_count, True).read
    return (
        read.where(F.col("text").isNotNull()).select("record", "record_table", "record_key", "text", "n_paragraphs").dropDuplicates(["record"])
        .join(read.where(F.col("noise").isNotNull()).groupBy("record").agg(F.array_sort(F.collect_set("noise")).alias("noises")), "record", "left")
        .select("record_table", "record_key", "text", "n_paragraphs", F.coalesce("noises", F.array().cast("array<string>")).alias("noises"))
    )


def scanned_records(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "text_units").select(F.lit("text_units").alias("record_table"), F.concat("source_id", F.lit(":"), "unit_index").alias("record_key"), "title", "text")
    chunks = table(spark, folder, "light_chunks").select(F.lit("light_chunks").alias("record_table"), F.col("id").alias("record_key"), F.col("metadata")["title"].alias("title"), "text")
    return units.unionByName(chunks)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return noisy(scanned_records(spark, folder))[0]


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(scanned_records(spark, folder))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
ORACLES: dict[str, str] = {}
