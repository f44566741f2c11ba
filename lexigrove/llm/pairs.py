"""Broken prompt and response pairs, by a multi-label linear classifier.

The classifier is trained on the pairs at hand: a bounded sample of them counts as sound, and defective ones are made from
it by emptying, cutting, refusing, echoing and swapping answers between languages. Since some of the sample is defective
itself, pairs that a first fit flags are taken out (refusals flagged with insufficient evidence become examples), and the
fit is repeated. Features are hashed n-grams of the answer, its ends, and what question and answer have in common.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.shared import table

DEFECTS = ("empty", "truncated", "refusal", "echo", "language")
#: Greatest number of distinct pairs taken for training, those with the least hash; they are collected to the driver.
TRAIN_ROWS = 6000
#: Pairs with texts over this length aren't used for training; they are classified like any other.
TRAIN_CHARS = 20_000
BITS = 17

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is are was were that which it for on with as by from at this be not no but or an what how why who does do has have than its they each when if while after before only about into more most".split(),
    "de": "der die das und ist sind war waren dass nicht für auf mit als von bei dem den des ein eine einen einer eines im zu zur zum wie was warum wer welche werden wird wurde wurden keine kein oder aber auch nur nach vor sich es mir ich dazu diese leider".split(),
    "fr": "le la les des du de et est sont était étaient que qui ne pas pour sur avec par dans une un au aux en ce cette ces quel quelle quels quelles comment pourquoi où il elle ils plus ou mais je qu lors après avant sont-ils".split(),
    "es": "el la los las del de y es son era eran que no para en con por una un al se su sus lo este esta estos cómo qué por cuáles quién dónde más o pero como entre tras sobre antes bajo ha puedo hay".split(),
}
# Answers without content.
PLACEHOLDERS = ["", " ", "\n", "\n\n", "\t", "-", "--", "—", "...", "…", ".", "n/a", "N/A", "NA", "null", "NULL", "None", "none", "nil", "(none)", "TBD", "TODO", "(no answer)", "no answer", "[empty]", "(empty)", "empty", "undefined", "NaN", "​", "﻿", "\xa0", "\xa0\xa0", "```\n```", "``` ```", "**", "****", "__", "\"\"", "''", "{}", "[]", "()", "<p></p>", "<br>", "<br/>", "&nbsp;", "Answer:", "A:", "Antwort:", "Réponse :", "Respuesta:", "#", ">", "*", "?", "answer pending", "<answer>", "<div></div>"]
# Refusals, with X for a subject.
REFUSALS = [
    "I cannot answer this question.", "I can't help with that.", "I'm not able to help with that.", "I am unable to answer this from the sources.", "I'm sorry, but I can't answer that.",
    "Sorry, I don't have information on this topic.", "Unfortunately I do not know.", "I don't know.", "As an assistant, I must decline to answer.", "I must decline to answer this question.",
    "Insufficient evidence.", "There is insufficient evidence to answer.", "No evidence was found for X, so no answer can be given.", "No relevant passage was found.", "This cannot be determined from the sources.",
    "The context does not contain enough information about X.", "The retrieved passages do not contain an answer.", "Not answerable with the given sources; please add more pages.", "I'd rather not speculate about X.", "I would rather not guess.",
    "Sorry, but nothing in the vault lets me say anything about X.", "Nothing in the indexed pages answers this question.", "It is not possible to answer the question about X.", "I cannot provide an answer to that.", "The question cannot be answered from the indexed pages.",
    "Ich kann diese Frage nicht beantworten.", "Dazu liegen mir keine Belege vor.", "Leider kann ich dazu nichts sagen.", "Leider enthält der Bestand nichts über X, daher keine Antwort.", "Ich kann diese Frage zu X nicht beantworten.", "Es gibt keine ausreichenden Belege für eine Antwort.", "Tut mir leid, dazu habe ich keine Informationen.",
    "Je ne peux pas répondre à cette question.", "Désolé, aucune preuve suffisante n'a été trouvée.", "Les sources ne contiennent rien sur X ; je préfère m'abstenir.", "Je n'ai pas assez d'informations sur X.", "Impossible de répondre à partir des sources.",
    "No puedo responder a esta pregunta.", "Lo siento, no tengo información sobre X.", "No hay pruebas suficientes sobre X en las fuentes.", "Lo siento, el corpus no permite decir nada sobre X.", "No es posible responder con las fuentes disponibles.",
]
_LEADS = ["", "", "", "I searched 12 pages. ", "Thanks for the question. ", "Thank you. ", "Sorry. ", "Hello! ", "Good question. "]
_TAILS = ["", "", "", " Try a narrower query.", " Try running the update first.", " The closest page is [[X]].", " Please ask again later.", " Consider adding sources."]
_ECHOES = ["{q}", "{q}", "{q}", "Q: {q}", "Question: {q}", "> {q}", '"{q}"', "“{q}”", "{q} {q}", "{q}\n{q}", "You asked: {q}", "The question is: {q}", "Question: {q}\nAnswer:", "Q: {q}\nA:", "Frage: {q}", "Question : {q}", "Pregunta: {q}", "**{q}**", "{u}", "{l}", "{b}", "{b}.", "{b}...", "Re: {q}", "{q} - {q}", "Your question: {q}", "Question: {q}\nAnswer: {q}", "Q: {q}\nA: {q}", "> {q}\n\n{b}", "- {b}"]

#: An answer has one defect at most: what there is nothing of can't break off, so breaking off comes last.
_ORDER = [DEFECTS.index(x) for x in ("empty", "echo", "refusal", "language", "truncated")]

_TOKEN = re.compile(r"\w+|[^\w\s]")
_TRAILER = re.compile(r"(?:\s*(?:\[[^\[\]\n]*(?:\.md|#chunk|#text)[^\[\]\n]*\]|\[\[[^\[\]\n]*\]\]|\n[ \t]*\(?(?:sources?|see also|siehe auch|voir aussi|véase)\b:?[^\n]*|```[^`]*```))+\s*$", re.IGNORECASE)
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|```.*?```|\[[^\]]*\]", re.DOTALL)
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES = {w: [k for k in _SETS if w in _SETS[k]] for v in FUNCTION_WORDS.values() for w in v}


def function_words(text: str) -> dict[str, int]:
    out, of = dict.fromkeys(_SETS, 0), _LANGUAGES.get
    for w in re.findall(r"[^\W\d_]+", _QUOTED.sub(" ", text).lower()):
        for k in of(w, ()):
            out[k] += 1
    return out


def _leading(hits: dict[str, int]) -> str:
    best, second = sorted(hits, key=lambda k: -hits[k])[:2]
    return best if hits[best] > hits[second] else ""


@functools.lru_cache(4096)
def language(text: str) -> str:
    """The language with most function words, '' if none leads."""
    return _leading(function_words(text))


def _bin(n: int) -> int:
    return n if n < 6 else 6 if n < 9 else 7 if n < 14 else 8 if n < 25 else 9


# Features are hashed into four ranges: the languages of the pair, its common words, the answer's ends, and its n-grams. What an
# answer has in common with its question alone decides on echoes, the languages alone on languages (swapped answers speak of
# other things too, which real ones don't), and its ends alone on whether it breaks off.
_RANGES = {"language": (0, 1 << 14), "pair": (1 << 14, 1 << 15), "end": (1 << 15, 1 << 16), "text": (1 << 16, 1 << BITS)}
_USES = {"empty": ("pair", "text"), "truncated": ("end",), "refusal": ("pair", "end", "text"), "echo": ("pair",), "language": ("language",)}


def features(question: str, answer: str | None, known: frozenset[str] | None = None) -> np.ndarray:
    """Distinct hashed features of a pair; known: the words of the training sample."""
    out: dict[str, list[str]] = {part: [] for part in _RANGES}
    tongue, pair, stop, add = (out[part].append for part in _RANGES)
    if answer is None:
        pair("null")
        answer = ""
    raw = re.sub(r"[​‌‍﻿\xa0]", " ", answer).strip()
    body = _TRAILER.sub("", raw).strip() or raw
    toks = _TOKEN.findall(re.sub(r"\d+(?:[.,]\d+)*", "0", raw.lower()))
    ws = [t for t in toks if t[0].isalnum()]
    pair(f"n{_bin(len(ws))}")
    stop(f"n{_bin(len(ws))}")
    for t in toks:
        add("1" + t)
    for a, b in zip(toks, toks[1:], strict=False):
        add(f"2{a} {b}")
    for a, b, c in zip(ws, ws[1:], ws[2:], strict=False):
        add(f"3{a} {b} {c}")
    add("whole " + " ".join(toks) if len(toks) <= 8 else "longer")
    for end, name in ((raw, "r"), (body, "b")):
        last = end.split()[-3:]
        low = [re.sub(r"\d+(?:[.,]\d+)*", "0", x.lower()) for x in last]
        ch = "…" if end.endswith(("...", "…")) else end[-1:]
        kind = "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        line = end.rsplit("\n", 1)[-1]
        lead = line[:1] if line[:1] in "-*|>#`" else "1" if re.match(r"\d+[.)] ", line) else ""
        stop(f"{name}e{kind}")
        stop(f"{name}e{kind}n{min(6, len(ws))}")
        stop(f"{name}l{lead}{kind}")
        for k in (1, 2, 3):
            stop(f"{name}{k}{' '.join(low[-k:])}")
        stop(f"{name}f{low[-1] if low else ''}{bool(lead)}")
        if last and known is not None:
            w = re.sub(r"^\W+|\W+$", "", last[-1])
            seen = w.lower() in known or not w or not w[0].isalpha()
            stop(f"{name}k{seen}{kind}{w[:1].isupper()}{len(ws) > 5}{bool(lead)}")
    stop(f"fence{raw.count('```') % 2}")
    for o, c in ("()", "[]", "“”", "«»"):
        stop(f"open{o}{raw.count(o) > raw.count(c)}")
    qs = re.findall(r"\w+", question.lower())
    aw = re.findall(r"\w+", raw.lower())
    of = set(qs)
    new = [w for w in aw if w not in of]
    cover = int(5 * len(of & set(aw)) / max(1, len(of)))
    pair(f"new{_bin(len(new))}")
    pair(f"new{_bin(len(new))}of{_bin(len(aw))}")
    pair(f"cover{cover}")
    pair(f"cover{cover}new{_bin(len(new))}")
    hits = function_words(raw)
    ql, al = language(question), _leading(hits)
    tongue(f"lang{ql}>{al}")
    tongue("same" if ql and ql == al else "none" if not ql or not al else "other")
    if ql:
        best = max(v for k, v in hits.items() if k != ql)
        tongue(f"own{_bin(hits[ql])}other{_bin(best)}")
        tongue(f"lead{max(-9, min(9, best - hits[ql]))}")
    return np.unique(np.array([lo + zlib.crc32(x.encode()) % (hi - lo) for part, (lo, hi) in _RANGES.items() for x in out[part]], np.int32))


class Model:
    """Weights, thresholds and the words of the training sample."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, thresholds: np.ndarray, known: frozenset[str]):
        self.weights, self.bias, self.thresholds, self.known = weights, bias, thresholds, known

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.empty((0, len(DEFECTS)))
        at = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
        z = np.add.reduceat(self.weights[np.concatenate(rows)], at, axis=0) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def defects(self, questions, answers, insufficient) -> list[str | None]:
        p = self.probabilities([features(q or "", a, self.known) for q, a in zip(questions, answers, strict=True)])
        over = p > self.thresholds
        first = over[:, _ORDER].argmax(axis=1)
        out = []
        for k, any_, i in zip(first, over.any(axis=1), insufficient, strict=True):
            d = DEFECTS[_ORDER[k]] if any_ else None
            out.append(None if d == "refusal" and i else d)
        return out


def _fit(rows: list[np.ndarray], labels: np.ndarray, mask: np.ndarray, rng: np.random.Generator, epochs: int = 6, rate: float = 0.15, decay: float = 1e-6):
    """Logistic regression by AdaGrad over sparse binary features; mask is 0 where a label of a row isn't known."""
    size = 1 << BITS
    uses = np.array([[part in _USES[d] for d in DEFECTS] for part in _RANGES], np.float32)
    starts = np.array([lo for lo, _ in _RANGES.values()])
    w, b = np.zeros((size, labels.shape[1]), np.float32), np.zeros(labels.shape[1], np.float32)
    g, gb = np.full_like(w, 1e-3), np.full_like(b, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), 64):
            some = order[s : s + 64]
            parts = [rows[i] for i in some]
            flat = np.concatenate(parts)
            lens = np.array([len(p) for p in parts])
            at = np.concatenate(([0], np.cumsum(lens)[:-1]))
            scale = 1 / np.sqrt(lens)[:, None].astype(np.float32)
            z = np.add.reduceat(w[flat], at, axis=0) + b
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) * mask[some]).astype(np.float32)
            by = np.argsort(flat, kind="stable")
            ordered = flat[by]
            heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            used = ordered[heads]
            grad = np.add.reduceat(np.repeat(err * scale * 4, lens, axis=0)[by], heads, axis=0)
            grad = (grad + decay * w[used]) * uses[np.searchsorted(starts, used, "right") - 1]
            g[used] += grad**2
            w[used] -= rate * grad / np.sqrt(g[used])
            eb = err.sum(axis=0)
            gb += eb**2
            b -= rate * eb / np.sqrt(gb)
    return w, b


def _cut(answer: str, rng: random.Random) -> str | None:
    """The answer broken off inside a sentence, sometimes inside a word."""
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)|\n", answer)] + [len(answer)]
    n = len(answer)
    if n < 25:
        return None
    for _ in range(8):
        at = rng.randrange(max(8, n // 5), n - 1)
        if rng.random() < 0.5:
            while at < n and answer[at].isalnum():
                at += 1
        cut = answer[:at].rstrip()
        rest = answer[len(cut):].strip(" .!?\n\"”)")
        tail = re.search(r"[^\n.!?]*$", cut).group()
        # Items of a list end without a stop, so that a cut shows there only inside a word or after a function word.
        listed, word = re.search(r"(?:^|\n)[-*] [^\n]*$", cut), re.search(r"\w*$", cut).group().lower()
        shows = not listed or answer[len(cut) : len(cut) + 1].isalnum() or any(word in x for x in _SETS.values())
        if rest and shows and not cut.endswith((".", "!", "?", "”", "`", "]", ")")) and len(tail.split()) >= 2 and min(abs(len(cut) - e) for e in ends) > 3:
            return cut + (rng.choice(["...", "…", ""]) if rng.random() < 0.04 else "")
    return None


def _own(seed: int, q: str, a: str) -> random.Random:
    """The chances of one pair, the same in each round of fitting, so that most of what is made of it stays."""
    return random.Random(zlib.crc32(a.encode("utf-8", "surrogatepass"), zlib.crc32(q.encode("utf-8", "surrogatepass"), seed)))


def _defective(base: list[tuple[str, str]], seed: int) -> list[tuple[str, str | None, int]]:
    """(question, answer, defect or -1 for a sound variant), made from sound pairs."""
    out: list[tuple[str, str | None, int]] = []
    by = {}
    for q, a in base:
        if (x := language(q)) and language(a) == x and len(a) > 40:
            by.setdefault(x, []).append(a)
    for q, a in base:
        rng = _own(seed, q, a)
        body = _TRAILER.sub("", a).strip()
        if rng.random() < 0.08:
            out.append((q, rng.choice(PLACEHOLDERS), 0))
        if cut := _cut(body, rng):
            out.append((q, cut, 1))
        if len(body) > 30 and body.endswith((".", "!")):
            lines = re.split(r"(?<=[.!?])\s+", body)
            if rng.random() < 0.5:  # items of a list end without a stop
                out.append((q, "\n".join(rng.choice(["- ", "* "]) + x.rstrip(".") for x in lines), -1))
            if rng.random() < 0.3:
                out.append((q, "\n".join(f"{i}. {x}" for i, x in enumerate(lines, 1)), -1))
            if rng.random() < 0.15:
                out.append((q, body.rstrip("."), -1))
        if rng.random() < 0.25:
            name = " ".join(re.findall(r"\b[A-ZÉ][\w-]{4,}(?: [A-Z][\w-]+)*", q[1:])[:1]) or "this topic"
            r = rng.choice(REFUSALS).replace("X", name)
            out.append((q, rng.choice(_LEADS) + (r if rng.random() < 0.9 else r.lower().rstrip(".")) + rng.choice(_TAILS).replace("X", name), 2))
        if rng.random() < 0.25:
            form = rng.choice(_ECHOES)
            out.append((q, form.format(q=q.strip(), u=q.strip().upper(), l=q.strip().lower(), b=q.strip(" ?¿")), 3))
            out.append((q, rng.choice(["{q}\n{a}", "{q} {a}", "Q: {q}\nA: {a}"]).format(q=q.strip(), a=a), -1))
        if rng.random() < 0.3 and (x := language(q)):
            others = [k for k in by if k != x]
            if others:
                other = rng.choice(by[rng.choice(sorted(others))])
                out.append((q, other, 4))
                if rng.random() < 0.5:  # a foreign quotation in an answer is none
                    first = re.split(r"(?<=[.!?])\s+", other)[0]
                    out.append((q, f"{body} “{first.rstrip('.')}”.", -1))
    return out


def _short(base: list[tuple[str, str]], seed: int) -> list[tuple[str, str, int]]:
    """Sound answers of a few words: names, numbers, terms and yes or no."""
    terms = [m.group() for _, a in base for m in re.finditer(r"\b(?:the|The) [a-z-]{4,} [a-z-]{4,}\b", a)][:4000] or ["the first part"]
    out = []
    for q, a in base:
        rng = _own(seed + 1, q, a)
        if rng.random() < 0.25:
            name = re.findall(r"\b[A-ZÉ][\w-]{4,}(?: [A-Z][\w-]+| \([a-z-]+\)| v\d)*", q[1:])
            term = rng.choice(terms)
            out.append((q, rng.choice([
                rng.choice(name) if name else "Yes", f"{rng.uniform(0, 100):.{rng.randrange(4)}f}%", f"About {rng.uniform(0, 100):.2f} ms", f"{rng.randrange(1, 999)} {term.split()[-1]}",
                "Yes.", "No.", "Yes", "No", "T" + term[1:], term, str(rng.randrange(1, 2000)), "Sí.", "Oui.", "Non.", "Ja.", "Nein."]), -1))
    return out


def _doubtful(q: str, a: str, recurring: bool, refusing: bool) -> list[int]:
    """Defects that a pair of the sample might have, before any fit: for these it isn't taken as sound."""
    raw = re.sub(r"[​‌‍﻿\xa0]", " ", a).strip()
    ws = re.findall(r"\w+", raw.lower())
    qs = set(re.findall(r"\w+", q.lower()))
    body = _TRAILER.sub("", raw).strip() or raw
    out = []
    if len(ws) < 2 or recurring:
        out.append(0)
    lines = body.split("\n")
    listed = lines[-1][:2] in ("- ", "* ") and not any(x.endswith(".") for x in lines)  # a list whose items have no stops
    if len(ws) > 4 and not body.endswith((".", "!", "?", "”", '"', "`")) and not refusing and not listed:
        out.append(1)
    if refusing or (recurring and len(ws) > 2):
        out += [1, 2]
    if len(set(ws) - qs) < 4:
        out.append(3)
    if (x := language(q)) != (y := language(raw)) and x and y:
        out += [4] if 2 in out else [2, 4]  # it may decline in another language
    return out


def _refusing(sample: list[tuple[str, str, bool]]) -> list[bool]:
    """Whether the word pairs of an answer mostly belong to samples with insufficient evidence."""
    ws = [re.findall(r"[^\W\d_]+", a.lower()) for _, a, _ in sample]
    pairs = [set(zip(w, w[1:], strict=False)) for w in ws]
    n: dict[tuple, list[int]] = {}
    for ps, (_, _, i) in zip(pairs, sample, strict=True):
        for p in ps:
            c = n.setdefault(p, [0, 0])
            c[0] += 1
            c[1] += i
    rate = sum(i for _, _, i in sample) / max(1, len(sample))
    out = []
    for ps in pairs:
        rates = sorted(n[p][1] / n[p][0] for p in ps if n[p][0] > 3)
        out.append(bool(rates) and rates[len(rates) // 2] > min(0.6, max(0.25, 2 * rate)))
    return out


def train(sample: list[tuple[str, str | None, bool | None]], seed: int = 11, rounds: int = 3) -> Model:
    """A model from (question, answer, insufficient_evidence) of pairs most of which are sound; works from a few pairs on, also from none."""
    rng, gen = random.Random(seed), np.random.default_rng(seed)
    sample = [(q or "", a or "", bool(i)) for q, a, i in sample]
    known = frozenset(w for _, a, _ in sample for w in re.findall(r"[^\W\d_]+(?:[-'][^\W\d_]+)*", a[:-40].lower()))
    # Sound answers seldom recur for other questions, but for their names and numbers; refusals and placeholders do.
    shape = lambda q, a: re.sub(r"\d+", "0", " ".join("X" if w in q or w[:1].isupper() else w for w in a.split()))
    asked: dict[str, set[str]] = {}
    for q, a, _ in sample:
        asked.setdefault(shape(q, a), set()).add(q)
    refusing = _refusing(sample)
    doubts = [_doubtful(q, a, len(asked[shape(q, a)]) > 2 or i, x) for (q, a, i), x in zip(sample, refusing, strict=True)]
    cache: dict[tuple[str, str | None], np.ndarray] = {}

    def featured(q: str, a: str | None) -> np.ndarray:
        if (q, a) not in cache:
            cache[q, a] = features(q, a, known)
        return cache[q, a]

    held_features = [featured(*x[:2]) for x in sample]
    full = [k for k, x in enumerate(sample) if x[1].strip()]
    n = len(DEFECTS)
    sound, flagged, model = np.array([[float(j not in d) for j in range(n)] for d in doubts]).reshape(-1, n), [], None
    for r in range(rounds):
        base = [sample[k][:2] for k in full if sound[k].all()]
        made = _defective(base, seed) + _short(base, seed) + [(q, p, 0) for p in PLACEHOLDERS * 3 for q, _ in ([rng.choice(base)] if base else [("What is it?", "")])] + [((rng.choice(base)[0] if base else "What is X?"), rng.choice(_LEADS) + t + rng.choice(_TAILS), 2) for t in REFUSALS * 6]
        every = [(*sample[k][:2], -1) for k in full] + made + flagged
        rows = [held_features[k] for k in full] + [featured(q, a) for q, a, _ in every[len(full) :]]
        y = np.array([[float(k == j) for j in range(n)] for _, _, k in every], np.float32)
        mask = np.ones_like(y)
        mask[[i for i, (_, _, k) in enumerate(every) if k in (0, 2, 3)], 1] = 0  # these may end anyhow
        mask[[i for i, (_, _, k) in enumerate(every) if k in (0, 2)], 4] = 0  # and be in any language
        mask[: len(full)] = sound[full]
        held = gen.random(len(every)) < 0.2
        fit = np.flatnonzero(~held)
        w, b = _fit([rows[i] for i in fit], y[fit], mask[fit], gen)
        model = Model(w, b, np.full(n, 0.5), known)
        if held.any():
            model.thresholds = _thresholds(model.probabilities([rows[i] for i in np.flatnonzero(held)]), y[held], mask[held])
        if r + 1 < rounds and full:
            # A pair stays sound for a label while the fit finds it improbable, by much where there is doubt; the clear cases become examples.
            p = model.probabilities(held_features)
            clear = p > 0.85
            for k, d in enumerate(doubts):
                sound[k] = 0 if clear[k].any() else p[k] < np.where(np.isin(np.arange(n), d), 0.1, 0.5)
            flagged = [(*sample[k][:2], j) for k in full if clear[k].sum() == 1 and ((j := int(p[k].argmax())) != 1 or 2 not in doubts[k])]
    return model


def _thresholds(p: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """For each label the middle of the thresholds with the best F1 on held-out pairs; sound ones weigh more, being far more frequent than in the sample."""
    grid = np.arange(0.2, 0.501, 0.02)
    out = []
    for j in range(p.shape[1]):
        ok = mask[:, j] > 0
        f1 = []
        for t in grid:
            hit, false = (y[ok, j] * (p[ok, j] > t)).sum(), ((1 - y[ok, j]) * (p[ok, j] > t)).sum()
            f1.append(2 * hit / max(1, hit + 4 * false + y[ok, j].sum()))
        best = grid[np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)]
        out.append(float(best.mean()))
    return np.array(out)


def training_sample(pairs: DataFrame, most: int = TRAIN_ROWS) -> list[tuple[str, str, bool]]:
    """At most this many distinct pairs, collected: those whose hash lies under a bound that the number of pairs sets.

    No task gathers more than its part of them, and the bound makes a tenth fewer expected than are allowed.
    """
    cleaned = F.struct(F.coalesce("question", F.lit("")).alias("q"), F.coalesce("answer", F.lit("")).alias("a"), F.coalesce("insufficient_evidence", F.lit(False)).alias("i"))
    short = pairs.where((F.coalesce(F.length("answer"), F.lit(0)) <= TRAIN_CHARS) & (F.coalesce(F.length("question"), F.lit(0)) <= TRAIN_CHARS)).select(cleaned.alias("x")).select("x.*", F.xxhash64("x").alias("h"))
    n = short.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    bound = int(min(1.0, 0.9 * most / max(1, n)) * (1 << 40))
    some = short.where(F.pmod("h", F.lit(1 << 40)) < bound).distinct().collect()
    return sorted((r.q, r.a, r.i) for r in sorted(some, key=lambda r: (r.h % (1 << 40), r.h))[:most])


def defective(samples: DataFrame, train_rows: int = TRAIN_ROWS, model: Model | None = None) -> DataFrame:
    """sample_id and defect of each defective pair.

    samples: sample_id, question, answer, insufficient_evidence. A null or blank answer is empty; a null question is
    treated as ''; null insufficient_evidence counts as false. Repeated rows are judged each by itself. Whole texts are
    read. Without a model one is trained on at most train_rows distinct pairs, those with the least hash.
    """
    pairs = samples.select("sample_id", "question", "answer", "insufficient_evidence")
    if model is None:
        model = train(training_sample(pairs, train_rows))
    sent = pairs.sparkSession.sparkContext.broadcast(model)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            insufficient = [x is not None and x == x and bool(x) for x in f["insufficient_evidence"]]
            out = pd.DataFrame({"sample_id": f["sample_id"], "defect": sent.value.defects([q if isinstance(q, str) else "" for q in f["question"]], [a if isinstance(a, str) else None for a in f["answer"]], insufficient)})
            yield out[out["defect"].notna()]

    # pandas would make numbers inexact beside nulls
    return pairs.withColumn("sample_id", F.col("sample_id").cast("string")).mapInPandas(judge, "sample_id string, defect string").select(F.col("sample_id").cast("bigint").alias("sample_id"), "defect")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return defective(table(spark, folder, "rag_samples"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p5_found(spark, folder).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
ORACLES: dict[str, str] = {}
