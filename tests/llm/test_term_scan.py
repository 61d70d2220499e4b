"""Ranked search by automaton against a plain loop over documents and items."""

import math
import re
from collections import Counter

import pytest

from tessella.llm import term_scan

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, item_id string, score int, rank int, block int, term string"
ITEMS = "item_id int, text string, doc_id int, score string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = set()
    for item, wanted in asked.items():
        scored = []
        for doc, c in counted:
            if c:
                m = 50 + (50 * sum(c.values()) * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
                if score > 0:
                    scored.append((-score, doc is None, doc or 0, doc))
        out |= {(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)}
    return out


def awkward():
    long = " ".join(f"word{i % 700}" for i in range(40_000))
    texts = [
        None, "", " ?! \x00\x7f", "The cat, the CAT; the_cat?", "cat", "cat", "Élan élan ÉLAN naïve", "日本語 text cat日本", "concatenate cats category",
        long, "x" * 50_000 + " cat", "cat\x00dog\x1fdog", "dog dog dog cat bird", "a1 b2 3",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (None, "cat dog"), (None, "cat dog"), (3, "The cat, the CAT; the_cat?"), *[(1000 - i, f"hot cat {i % 3}") for i in range(200)]]


ASKED = [(1, "Cat dog"), (2, "élan Élan"), (3, ""), (4, None), (5, "nothing of this"), (None, "bird CAT word3"), (7, "cat"), (7, "bird"), (8, "cat dog bird 日本語 the " * 3)]


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1, 2, 3, "y") for i, t in docs], DOCS),
        spark.createDataFrame([(i, t, 9, "z") for i, t in items], ITEMS),
    )


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("top", [50, 3])
def test_ranks(spark, top):
    docs, items = frames(spark, awkward(), ASKED)
    assert found(term_scan.search(docs.repartition(5), items, top=top)) == sorted(plain(awkward(), ASKED, top), key=str)


def test_small_blocks_and_steps(spark, monkeypatch):
    """Several automata, few documents at a time, candidates dropped often: the same rows."""
    for name, small in (("BLOCK", 150), ("CELLS", 20), ("STEP", 3), ("HELD", 10), ("SALTS", 2)):
        monkeypatch.setattr(term_scan, name, small)
    docs, items = frames(spark, awkward(), ASKED)
    assert term_scan.item_terms(items).select("block").distinct().count() > 1
    assert found(term_scan.search(docs, items, top=4)) == sorted(plain(awkward(), ASKED, 4), key=str)


def test_automaton_finds_whole_terms():
    machine = term_scan.automaton(["cat", "cats", "é"])
    got = term_scan.frequencies(term_scan.guarded("Cat cats catsé É é concat cat"), machine)
    assert dict(zip(*map(list, got))) == {0: 2, 1: 1, 2: 1}
    assert term_scan.count_terms(term_scan.guarded("Cat cats catsé É é concat cat")) == 7


def test_no_rows(spark):
    docs, items = frames(spark, [], [])
    some_docs, some_items = frames(spark, awkward(), ASKED)
    assert found(term_scan.search(docs, some_items)) == found(term_scan.search(some_docs, items)) == found(term_scan.search(docs, items)) == []
    assert found(term_scan.search(some_docs.filter("text is null"), some_items)) == []
