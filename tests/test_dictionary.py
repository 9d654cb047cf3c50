"""Dictionaries of many terms, with frequent words and terms without a letter, against plain search."""
import random
import re

import pytest

from tidewire.functions import language as L


def brute(texts, terms):
    last, shouted = {}, {}
    for term, canonical, kind, place in terms:
        key = term.lower()
        if key not in last or place > last[key][2]:
            last[key] = (canonical, kind, place)
        shouted[key] = shouted.get(key, False) or (2 <= len(term) <= 5 and term == term.upper() and term != term.lower())
    found = set()
    for id_, text in texts:
        for key, (canonical, kind, _) in last.items():
            if text is None or len(key) < 3 and not shouted[key]:
                continue
            if shouted[key]:
                hit = re.search(f"(?<![A-Za-z]){re.escape(key.upper())}(?![A-Za-z])", text)
            else:
                hit = re.search(f"(?<![a-z]){re.escape(key)}(?![a-z])", text.lower())
            if hit:
                found.add((id_, canonical, kind))
    return found


def case(seed):
    draw = random.Random(seed)
    vocabulary = ["the", "the", "the", "bank", "of", "Of", "york", "new", "NATO", "us", "2024", "№ 5", "москва", "日本", "$$$", "a", "b-c", "U.S.", "\\E", "é"]
    texts = [(i if i % 9 else None, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(0, 14))) + draw.choice(["", "!", "2024"])) for i in range(150)] + [(7, None), (7, "the bank"), (8, "")]
    terms = [(" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 4))), f"c{i}", draw.choice("xy"), i) for i in range(120)]
    return texts, terms + [("the", "The", "x", 900), ("nowhere the", "No", "x", 901), ("日本", "Japan", "x", 902), ("2024", "Year", "y", 903)]


@pytest.mark.parametrize("few", [0, 50_000])
def test_terms_by_their_rarest_word_and_without_letters(spark, monkeypatch, few):
    monkeypatch.setattr(L, "FEW_TERMS", few)
    texts, terms = case(few)
    got = L.dictionary_matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term string, canonical string, type string, place int"))
    expected = brute(texts, terms)
    assert {tuple(r) for r in got.collect()} == expected and len(expected) > 200


@pytest.mark.parametrize("few", [0, 50_000])
def test_no_plan_pairs_all_texts_with_all_terms(spark, monkeypatch, few):
    monkeypatch.setattr(L, "FEW_TERMS", few)
    texts, terms = case(1)
    got = L.dictionary_matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term string, canonical string, type string, place int"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_dictionaries_and_texts(spark):
    texts, terms = spark.createDataFrame([(1, "the bank")], "id long, text string"), spark.createDataFrame([("the", "The", "x", 1)], "term string, canonical string, type string, place int")
    assert L.dictionary_matches(texts, terms.limit(0)).count() == 0 and L.dictionary_matches(texts.limit(0), terms).count() == 0
