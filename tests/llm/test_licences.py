"""Licence scans: phrases, spans and chains against brute force."""

import random
import re

import pytest

from attesta.llm import licences
from attesta.llm.licence_texts import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, LABELS_ string, score_ int, `a.b` int"


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def places(words, phrases):
    return [(i, label) for label, p in phrases for q in [split(p)]
            for i in range(len(words) - len(q) + 1) if words[i:i + len(q)] == q]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", i, i) for i, t in enumerate(texts)], DOCS)


def scanned(spark, texts, **options):
    return {r["doc_id"]: r for r in licences.scan(frame(spark, texts), **options).collect()}


ODD = [None, "", " \n", "---", "mit", "MIT  licençe", "MIT-License", "mİt license", "CC-BY cc by CC\nBY",
       "apache license " * 3000, "the GNU General\n * Public License", "日本 mit license日本", "a" * 50_000]


def test_base_columns_equal_brute_force(spark):
    r = random.Random(3)
    bag = "gnu general public license apache cc by mit the of é x MIT License, CC-BY".split()
    texts = ODD + [" ".join(r.choice(bag) for _ in range(r.randint(0, 60))) for _ in range(80)]
    got = scanned(spark, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = split(t)
        found = places(words, PHRASES)
        starts = [s for s, _ in found]
        row = got[i]
        assert row["n_words"] == len(words) and row["n_base"] == len(found)
        assert (row["first_word"], row["last_word"]) == (min(starts, default=None),
                                                         max(starts, default=None))
        base = sorted({label for _, label in found})
        assert row["base_labels"] == ",".join(base)
        assert set(base) <= set(filter(None, row["labels"].split(",")))
        assert 0 <= row["score"] <= 1


def brute_matches(words, templates, need):
    """Per template, all matches of `need` words or more that cannot be made longer, with the
    longest match over all templates that ends at each word as the upper bound of nothing."""
    out = []
    for t in templates:
        w = split(t)
        found = set()
        for i in range(len(words)):
            for j in range(len(w)):
                n = 0
                while i - n >= 0 and j - n >= 0 and words[i - n] == w[j - n]:
                    n += 1
                ends = i + 1 == len(words) or j + 1 == len(w) or words[i + 1] != w[j + 1]
                if n >= need and ends:
                    found.add((i - n + 1, i, j - n + 1, j))
        out.append(found)
    return out


def test_matching_statistics_find_every_maximal_match():
    r = random.Random(5)
    for trial in range(60):
        letters = "abc" if trial % 2 else "abcdefgh"
        templates = [("t", " ".join(r.choice(letters) for _ in range(r.randint(4, 14))))
                     for _ in range(r.randint(1, 5))]
        automaton = licences.Automaton(templates, [("p", "a b")], 3)
        words = [r.choice(letters + "z") for _ in range(40)]
        for _, t in templates:
            at = r.randint(0, 30)
            words[at:at] = t.split()[: r.randint(3, 14)]
        found, matches = automaton.stream([w.encode() for w in words])
        want = brute_matches(words, [t for _, t in templates], 3)
        assert [set(m) for m in matches] == want
        assert sorted(s for s, _ in found) == [s for s, _ in sorted(places(words, [("p", "a b")]))]


@pytest.mark.parametrize("label, notice", TEMPLATES)
def test_every_notice_is_found_whole_and_edited(spark, label, notice):
    words = split(notice)
    automaton = licences.Automaton(TEMPLATES, PHRASES)
    around = "the of and in by " * 20
    text = f"{around}\n# {notice.upper()}\n{around}"
    row = automaton.scan(text, licences.MAX_GAP, licences.MIN_SHARE)
    spans = row[-1]
    assert [s["label"] for s in spans] == [label] and row[6] == 1.0
    assert split(text)[spans[0]["first"]:spans[0]["last"] + 1] == words
    if len(words) >= 60:  # a foreign word in the middle and two words less
        edited = words[:20] + ["sundry"] + words[20:40] + words[42:]
        row = automaton.scan(" ".join(edited), licences.MAX_GAP, licences.MIN_SHARE)
        assert label in row[5].split(",") and row[6] == (len(words) - 2) / len(words)


def test_copies_clean_texts_and_very_long_texts(spark):
    notice = dict(TEMPLATES)["isc"]
    gap = " words of no licence" * 20
    texts = [(notice + gap) * 500, "licensed under the terms that we agree on by word of mouth",
             "Licensed under CC BY 3.0", "licensed under the gnu general public license version 9"]
    got = scanned(spark, texts)
    assert len(got[0]["spans"]) == 500 and got[0]["labels"] == "isc"
    assert [got[i]["labels"] for i in (1, 2, 3)] == ["", "cc-by", "gpl"]
    assert {got[i]["score"] for i in (1, 2, 3)} == {0.0}


def test_empty_table_clashing_columns_and_own_templates(spark):
    assert licences.scan(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        licences.scan(frame(spark, ["a"]).withColumnRenamed("score_", "Score"), keep=("Score",))
    got = licences.scan(frame(spark, ["one two three four five"]), keep=("a.b", "LABELS_"),
                        templates=[("own", "two three four five")], phrases=[("p", "one")]).collect()
    assert got[0]["labels"] == "own,p" and got[0]["a.b"] == 0
