from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexigrove.llm.pairs import DEFECTS, REFUSALS, _cut, defective, language, train, training_sample

NOUNS = "encoder ledger index passage corpus router cluster template archive frontier notebook graph".split()
SENTENCES = {
    "en": ["The {a} of the {b} was rebuilt {n} times, and it returned the same {c}.", "We compared the {a} with a {b} and saw the {c} move from {n} to {m}.", "Each {a} carries a hash, so that only {n} of the {b} are computed again by the {c}."],
    "de": ["Die {a} von dem {b} wurden im kleinen Bestand {n} mal berechnet, weil {c} fehlten.", "Es bleibt offen, ob {a} oder eher {b} den Unterschied nach dem Umbau um {n} Punkte erklären."],
    "fr": ["Les {a} de la {b} ont été recalculés {n} fois sous forte charge, car les {c} étaient rares.", "On ne sait pas encore si les {a} ou les {b} déplacent ce résultat de {n} points."],
    "es": ["Los {a} de la {b} se calcularon otra vez con {n} puntos, porque los {c} eran densos.", "Todavía no sabemos si los {a} o los {b} explican este resultado en unos {n} puntos."],
}
QUESTIONS = {"en": "What does the {a} of the {b} do with the {c}?", "de": "Wie behandelt der {a} die {b} nach dem {c}?", "fr": "Comment le {a} traite-t-il les {b} sur la {c} ?", "es": "¿Cómo trata el {a} los {b} en la {c}?"}


def made(seed: int, n: int, defects: bool):
    rng = random.Random(seed)
    say = lambda t: t.format(a=rng.choice(NOUNS), b=rng.choice(NOUNS), c=rng.choice(NOUNS), n=rng.randrange(99), m=rng.randrange(99))
    text = lambda x: " ".join(say(rng.choice(SENTENCES[x])) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        x = rng.choice(["en"] * 5 + ["de", "fr", "es"])
        q, a, defect, insufficient = say(QUESTIONS[x]), text(x), None, False
        if rng.random() < 0.3 and defects:
            defect = rng.choice(DEFECTS)
            if defect == "empty":
                a = rng.choice([None, "", "n/a", "...", "​"])
            elif defect == "truncated":
                a = _cut(a, rng)
            elif defect == "refusal":
                a, insufficient = rng.choice(REFUSALS).replace("X", rng.choice(NOUNS)), rng.random() < 0.5
                defect = None if insufficient else defect
            elif defect == "echo":
                a = rng.choice(["{q}", "Q: {q}", "> {q}"]).format(q=q)
            else:
                a = text(rng.choice([y for y in SENTENCES if y != x]))
        out.append((i, q, a, insufficient, defect))
    return out


def test_held_out_accuracy():
    model = train([r[1:4] for r in made(1, 1500, True)])
    rows = made(2, 1500, True)
    got = model.defects([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
    for d in (*DEFECTS, None):
        hit = sum(g == r[4] == d for g, r in zip(got, rows, strict=True))
        assert hit >= 0.9 * sum(r[4] == d for r in rows), d
        assert hit >= 0.9 * sum(g == d for g in got), d


def test_rows(spark):
    rows = [(i, q, a, x) for i, q, a, x, _ in made(3, 600, True)]
    rows += [(9001, None, None, None), (9002, "What is it?", None, True), (9003, None, "The index was rebuilt 5 times, and it returned the same graph.", None), (9004, "Why is the index here?", "The graph was rebuilt 7 times, and it returned the same index. " * 5000, False), (None, "Q", None, False), (9001, None, None, None), (2**60 + 1, "Q", "", False)]
    df = spark.createDataFrame(rows, "sample_id bigint, question string, answer string, insufficient_evidence boolean").withColumn("defect", F.lit("mine")).withColumn("text", F.lit(1))
    got = defective(df)
    assert got.columns == ["sample_id", "defect"]
    by = {}
    for r in got.collect():
        by.setdefault(r.sample_id, []).append(r.defect)
    assert by[9001] == ["empty", "empty"] and by[9002] == ["empty"] and by[None] == ["empty"] and by[2**60 + 1] == ["empty"] and 9003 not in by and 9004 not in by
    assert defective(df.limit(0)).count() == 0


def test_language():
    assert language("the index of the graph is in it") == "en" and language("die Knoten und der Graph sind nicht da") == "de" and language("xyz 12") == ""


# Written apart from the module's own lists and cuts.
OTHER_REFUSALS = [
    "I cannot give an answer to this question from the pages at hand.", "Sorry, the indexed sources do not contain enough to answer this.", "I do not have enough information to answer that question.",
    "No passage in the sources answers this question, so I must decline.", "Unfortunately the retrieved context says nothing about the {c}.", "Diese Frage kann ich mit den vorhandenen Quellen leider nicht beantworten.",
    "Je ne peux pas répondre, les sources ne contiennent rien à ce sujet.", "Lo siento, no puedo responder con las fuentes que tengo.",
]


def otherwise(seed: int, n: int):
    rng = random.Random(seed)
    out = []
    for i, q, a, _, _ in made(seed + 100, n, False):
        defect, words = None, a.split()
        kind = rng.randrange(8)
        if kind == 0:
            a, defect = rng.choice(OTHER_REFUSALS).replace("{c}", rng.choice(NOUNS)), "refusal"
        elif kind == 1 and len(words) > 8:  # some words into the last sentence, neither at its end
            last = max([0, *(k + 1 for k, w in enumerate(words[:-4]) if w[-1] in ".!?")])
            at = rng.randrange(last + 3, len(words) - 1) if len(words) - 1 > last + 3 else None
            if at:
                a, defect = " ".join(words[:at]).rstrip(",.") + rng.choice(["", " " + words[at][:2] if len(words[at]) > 4 else ""]), "truncated"
        elif kind == 2:
            a, defect = rng.choice([q, q.upper(), f"The question was: {q}", f"*{q}*"]), "echo"
        elif kind == 3:
            a, defect = rng.choice(["", "  ", "—", "[no answer]", "N/A."]), "empty"
        out.append((i, q, a, False, defect))
    return out


def test_defects_of_other_wordings():
    model = train([r[1:4] for r in made(1, 1500, True)])
    rows = otherwise(5, 1500)
    got = model.defects([r[1] for r in rows], [r[2] for r in rows], [False] * len(rows))
    for d in ("empty", "truncated", "refusal", "echo", None):
        hit = sum(g == r[4] == d for g, r in zip(got, rows, strict=True))
        assert hit >= 0.8 * sum(r[4] == d for r in rows), d
        assert hit >= 0.8 * sum(g == d for g in got), d


def test_sample_is_bounded(spark):
    df = spark.range(20_000).selectExpr("concat('q', id) AS question", "concat('a', id % 15000) AS answer", "CAST(NULL AS boolean) AS insufficient_evidence")
    df = df.unionByName(spark.range(20_000).selectExpr("'hot' AS question", "'hot' AS answer", "false AS insufficient_evidence"))
    assert 500 < len(training_sample(df, 1000)) <= 1000 and len(training_sample(df.limit(50), 1000)) <= 50 and training_sample(df.limit(0)) == []
