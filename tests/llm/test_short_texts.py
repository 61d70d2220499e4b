"""Decontamination of texts that are shorter than the items, against every window of every text."""

import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import decontamination
from tests.llm.test_operators import rows


def count(words):
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def plain(text, items):
    """Item -> similarity; the whole text stands in for the window of an item that is longer."""
    have, found = re.findall(r"\w+", (text or "").lower()), {}
    for i, item in items:
        for at in range(max(1, len(have) - len(item) + 1)):
            value = decontamination.similarity(count(have[at : at + len(item)]), count(item))
            if value >= 0.8:
                found[i] = max(value, found.get(i, 0))
    return found


def test_texts_shorter_than_the_item(spark):
    rng = np.random.default_rng(6)
    items = [(i, [f"w{x}" for x in rng.integers(0, 10**6, n)]) for i, n in enumerate([8, 9, 10, 14, 25, 40, 40, 120])]
    items.append((20, [*items[5][1], "one", "more"]))  # nearly the item 5
    items.append((21, ["again"] * 30))
    texts = []
    for _, item in items:
        n = len(item)
        texts += [item[:-1], item[1:], item[: n // 2] + item[n // 2 + 1 :], item[:-2], item[: int(n * 0.85)], item[: int(n * 0.8)], item[: n // 2], item]
    texts += [items[4][1][:-1] + ["other"], ["before", *items[4][1][:-1]], []]
    texts = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    wanted = {i: plain(t, items) for i, t in texts}
    assert sum(bool(w) for i, w in wanted.items() if i % 8 != 7) > 25
    for block in (20_000, 2):
        for r in decontamination.contaminated(rows(spark, texts), bench, block=block).collect():
            assert r.item_ids == sorted(wanted[r.doc_id])
            assert r.similarity == pytest.approx(max(wanted[r.doc_id].values(), default=0.0))
