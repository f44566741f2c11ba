from __future__ import annotations

import random
import textwrap

from pyspark.sql import functions as F

from lexigrove.llm.scans import Words, decode, examine, line_kinds, noisy, paragraphs, repair, repaired, stream

TEXT = (
    "The ledger of the archive was rebuilt after the night run, and the cross-encoder returned the same passages. "
    "Annotators disagreed about several mentions because the template looked balanced to them. "
    "Without filtering, most of the queries lost their passage while the router lowered nothing. "
    "Our pipeline stores many keywords per graph, each with an ambiguous walk and some edges."
)
TITLE = "Rikodefo: Learned ledger for passages"


def lexicon() -> Words:
    counts = {}
    for w in TEXT.split():
        k = w.strip(".,").lower()
        counts[k] = counts.get(k, 0) + 200
    return Words(counts)


def test_decodes_each_kind():
    w = lexicon()
    out = decode(stream(["The 1edger of the archi-", "ve was rcbuilt after the ni­", "ght run and the cross-", "encoder keeps ambigu- ", "ous que", "ries andthe mernti0ns"]), w)
    assert " ".join(out.out).startswith("The ledger of the archive was rebuilt after the night run and the cross-encoder keeps ambiguous queries")
    assert out.noises == {"hyphen", "misread"}
    assert decode(stream(["the cross-", "encoder returned"]), w).noises == set()
    assert decode(stream(["after the", "night run -", "and the same"]), w).noises == set()


def test_lines():
    lines = ["36 / 223", "Page 4", "xiv", "- 5 -", "· 6 ·", "[7]", "8", "Ledger Papers, Vol. 3", "Rikodefo et al.", "Notes on passages | 12", "9   Notes on passages", TITLE.upper(), "## Notes on passages", "The editors", "settles near 9.", "12.5", "1. First", "", "```", "7", "```"]
    kinds = line_kinds(lines, TITLE)
    assert [p for _, p in kinds] == [True] * 7 + [False, False, True, True] + [False] * 10
    assert [h for h, _ in kinds] == [False] * 7 + [True] * 5 + [False] * 9
    assert line_kinds(["Rikodefo et al."], None) == [(False, False)]


def test_paragraphs_across_pages():
    lines = [*textwrap.wrap(TEXT, 60)[:4], "", "12", "", *textwrap.wrap(TEXT, 60)[4:], "", *textwrap.wrap(TEXT, 60), "- one", "- two"]
    got = paragraphs(lines, line_kinds(lines, TITLE))
    assert [" ".join(x) for x in got] == [TEXT, TEXT, "- one", "- two"]


def test_round_trip_of_noise():
    rng, w = random.Random(7), lexicon()
    for _ in range(40):
        words, lines, noises = TEXT.split(), [], set()
        for k, x in enumerate(words):
            if rng.random() < 0.05 and len(x) > 5 and x.isalpha() and x.islower():
                for good, bad in (("e", "c"), ("l", "1"), ("i", "!"), ("o", "0"), ("s", "5")):
                    if good in x[1:]:
                        words[k] = x[0] + x[1:].replace(good, bad, 1)
                        noises.add("misread")
                        break
        line = ""
        for x in words:
            if len(line) + len(x) > 55:
                if x.isalpha() and len(x) > 6 and rng.random() < 0.6:
                    cut = rng.randrange(2, len(x) - 2)
                    line, x = line + x[:cut] + rng.choice(["-", "¬", "­", "- "]), x[cut:]
                    noises.add("hyphen")
                lines.append(line if line.endswith("- ") else line.rstrip())
                line = ""
                if rng.random() < 0.3:
                    lines += rng.choice([["12"], ["", "Page 3", ""], ["Rikodefo et al."], ["Ledger Papers, Vol. 3", "4"]])
            line += x + " "
        lines.append(line.rstrip())
        parts, found = repair("\n".join(lines), TITLE, w)
        assert parts == [TEXT]
        assert noises <= set(found)


def test_rows_and_rare_words(spark):
    clean = [("t", f"c{i}", TITLE, TEXT + " Zupugilevo stands here.") for i in range(8)]
    rows = [*clean, ("t", "m", TITLE, "The archive of Zupugi1evo was rebuilt"), ("t", "h", TITLE, "the bal-\nanced template\nZupugi-\nlevo stands"), ("t", "k", None, "Rikodefo et al.\nthe same"), ("t", "n", None, None), ("t", "e", TITLE, ""), ("t", "p", TITLE, "the archive\n12\nwas rebuilt"), ("t", "p", TITLE, "the archive\n12\nwas rebuilt"), (None, None, TITLE, "8"), ("t", "l", TITLE, (TEXT + "\n") * 2000)]
    df = spark.createDataFrame(rows, "record_table string, record_key string, title string, text string").withColumn("noise", F.lit(0)).withColumn("word", F.lit("w"))
    expected = {("t", "m", "misread"), ("t", "h", "hyphen"), ("t", "p", "page_number"), (None, None, "page_number")}
    for limit in (100_000, 3):  # with few core words, the rest is joined with the counts of all
        got = {tuple(r) for r in noisy(df, core_limit=limit, core_count=5)[0].collect()}
        assert got == expected
    by = {r.record_key: r for r in repaired(df, core_limit=3).collect() if r.record_key}
    assert "Zupugilevo was rebuilt" in by["m"].text and by["p"].text == "the archive was rebuilt" and by["p"].n_paragraphs == 1 and "n" not in by
    assert noisy(df.limit(0))[0].count() == 0 and repaired(df.limit(0)).count() == 0


def test_examine_leaves_clean_text_alone():
    assert examine(TEXT, TITLE, lexicon()) == (set(), [])


def test_frequent_misreads_are_no_words(spark):
    sound = {"agreement": 36_000, "if": 20_000, "it": 60_000, "cf": 13_000, "et": 15_000, "until": 20_000, "corpus": 39_000}
    bad = {"agreemenf": 130, "unt1l": 110, "orpus": 70}
    for grown in (1, 10):  # what counts is how the counts relate
        w = Words({k: n * grown for k, n in (sound | bad).items()})
        path = decode(stream("the agreemenf stands unt1l (orpus".split()), w)
        assert path.out == ["the", "agreement", "stands", "until", "corpus"] and path.noises == {"misread"}
        path = decode(stream("if it cf et".split()), w)
        assert path.out == ["if", "it", "cf", "et"] and path.noises == set()
        assert decode(stream(["the agree-", "menf stands"]), w).noises == {"hyphen", "misread"}
    rows = [("t", f"c{i}", None, "the agreement stands") for i in range(400)] + [("t", f"m{i}", None, "the agreemenf stands") for i in range(6)]
    got = {tuple(r) for r in noisy(spark.createDataFrame(rows, "record_table string, record_key string, title string, text string"))[0].collect()}
    assert got == {("t", f"m{i}", "misread") for i in range(6)}


def test_last_letters_as_digits(spark):
    w = Words({"prompt": 1900, "prompts": 2200, "model": 2000, "version": 30, "versions": 40, "version5": 20})
    path = decode(stream("prompt5 model-5 version5 model7".split()), w)
    assert path.out == ["prompts", "model-5", "version5", "model7"] and path.noises == {"misread"}
    rows = [("t", f"c{i}", None, "prompt prompts model models") for i in range(40)] + [("t", f"n{i}", None, "model5 model 7") for i in range(4)]
    rows += [("t", "m", None, "prompt5 stand"), ("t", "k", None, "model-5 model7")]
    df = spark.createDataFrame(rows, "record_table string, record_key string, title string, text string")
    for limit in (100_000, 1):  # model5 occurs a tenth as often as models
        assert {tuple(r) for r in noisy(df, core_limit=limit)[0].collect()} == {("t", "m", "misread")}


def test_rows_do_not_depend_on_the_size(spark):
    rows = [("t", f"c{i}", None, "the agreement stands here") for i in range(60)] + [("t", "m", None, "the agreemenf stands h3re"), ("t", "n", None, "sfands")]
    schema = "record_table string, record_key string, title string, text string"
    got = []
    for grown in (1, 10):
        df = spark.createDataFrame([(a, f"{k}-{j}", t, x) for a, k, t, x in rows for j in range(grown)], schema)
        for limit in (100_000, 2):
            got.append({(r.record_key.split("-")[0], r.noise) for r in noisy(df, core_limit=limit)[0].collect()})
    assert got == [{("m", "misread"), ("n", "misread")}] * 4


def test_headers_of_any_wording(spark):
    """Headers of a wording that no table of forms knows, put into wrapped prose at random; bylines at other places aren't headers."""
    rng, rows, truth = random.Random(3), [], set()
    for k in range(40):
        words = rng.choices(["archive", "ledger", "passage", "router", "keeps", "moves", "under", "over", "while", "because", "nine", "records"], k=120)
        lines = textwrap.wrap(" ".join(words).capitalize() + ".", 60)
        if k % 2:
            lines.insert(rng.randrange(2, len(lines) - 2), f"Internal draft {k} for review")
            truth.add(("t", f"d{k}", "header"))
        else:
            lines += ["", "Written by the house staff"]
        rows.append(("t", f"d{k}", f"Title {k}", "\n".join(lines)))
    df = spark.createDataFrame(rows, "record_table string, record_key string, title string, text string")
    assert {tuple(r) for r in noisy(df)[0].where("noise = 'header'").collect()} == truth
    assert all("draft" not in r.text for r in repaired(df).collect())


def test_odd_tokens(spark):
    long = "a" * 5000 + " " + "1a0b5c" * 500 + " " + "x-" * 3000
    df = spark.createDataFrame([("t", "a", "Long tokens", long), ("t", "b", "", "\n\n- \n-\n"), ("t", "c", None, " ‐\nnext")], "record_table string, record_key string, title string, text string")
    assert noisy(df)[0].count() == 0 and repaired(df).count() == 3


def test_ligatures_and_letters_run_together():
    w = Words({"first": 4000, "claims": 2500, "learned": 2100, "duster": 40, "cluster": 50, "dim": 300, "leamed": 3})
    path = decode(stream("the ﬁrst daims leamed duster dim".split()), w)
    assert path.out == ["the", "first", "claims", "learned", "duster", "dim"] and path.noises == {"misread"}


def test_rows_do_not_depend_on_the_words_held(spark):
    """Rare words that are kept, joined at a line end or confused, beside common ones of which they could be made."""
    rows = [("t", f"c{i}", None, " ".join(["the news paper stands here"] * 600)) for i in range(60)] + [("t", f"n{i}", None, "the newspaper") for i in range(3)]
    rows += [("t", f"a{i}", None, "a fore-word, a foreword") for i in range(4)] + [("t", "a4", None, "a foreword"), ("t", "b", None, "the fore-\nword stands")]
    rows += [("t", "m", None, "the newspap3r")]
    df = spark.createDataFrame(rows, "record_table string, record_key string, title string, text string")
    every, few = ({(r.record_key, r.text, tuple(r.noises)) for r in repaired(df, core_limit=limit).collect()} for limit in (100_000, 5))
    assert every == few and {("n0", "the newspaper", ()), ("m", "the newspaper", ("misread",)), ("b", "the fore-word stands", ())} <= every
    found, told = noisy(df, core_limit=5)
    assert {tuple(r) for r in found.collect()} == {("t", "m", "misread")} and told.count() == 10
