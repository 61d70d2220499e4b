"""The filter audit against plain loops over all rows and orders."""

import re
from itertools import permutations

import pytest

from tessella.llm import filter_audit

DOCS = "doc_id bigint, text string, source string, print string, mask int, id string, n int, cell int"
LABELS = "doc_id bigint, quality int, toxic int, id string"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y", 2, 3) for i, t, s in rows], DOCS)


def plain(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        good = any(q == 1 for k, q, _ in labels if k is not None and k == i)
        toxic = any(x == 1 for k, _, x in labels if k is not None and k == i)
        facts.append((s or "", failed, good, toxic))
    out = {}
    for part in {f[0] for f in facts}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [f for f in facts if f[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [f for f in left if f[1][letter]]
                kept = [f for f in left if not f[1][letter]]
                alone = sum(1 for f in facts if f[0] == part and f[1][letter] and sum(f[1].values()) == 1)
                row = (len(kept), len(removed), sum(f[1][letter] for f in gone), alone, sum(f[2] for f in removed), sum(f[3] for f in removed))
                out[part, "".join(order), step] = row
                shapley[letter] += len(removed)
                gone, left = gone + removed, kept
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                out[part, "".join(order), step] += (shapley[letter],)
    return out


def measured(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) + (r.shapley,) for r in df.collect()}


def awkward():
    varied = " ".join(f"w{i}" for i in range(250))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t\x0b ", None), (4, varied, "a"), (5, varied, "b"), (5, varied, "b"), (4, varied, ""),
        (None, varied, "a"), (None, "only without id", "b"), (7, "only without id", "b"), (8, "same " * 300, "b"), (9, "UPPER case", "a"), (10, "a|b", "a"),
        (11, varied + " #", None), (12, "é" * 60_000 + " " + "Z" * 10, "a"), *[(100 + i, "hot text " * 3, "hot") for i in range(300)], (50, "hot text " * 3, "b"),
    ]


LABELLED = [(4, 1, 0), (4, 0, 0), (5, 1, 1), (8, 0, 1), (9, None, 1), (None, 1, 1), (120, 1, 1), (999, 1, 1)]


@pytest.mark.parametrize("bits", [None, 3])
def test_counts_of_all_orders(spark, bits):
    """Also with a sketch so small that it clears nothing."""
    labels = spark.createDataFrame([(*x, "z") for x in LABELLED], LABELS)
    got = filter_audit.audit(frame(spark, awkward()).repartition(7), labels, bits=bits)
    assert measured(got) == plain(awkward(), LABELLED)
    assert got.columns == ["part", "filter_order", "step", *COUNTS, "shapley"]


def test_sketch_clears_unique_texts_only(spark):
    texts = [(i, f"text {i % 900}", "a") for i in range(1_000)]
    prints = filter_audit._facts(frame(spark, texts), "source", "doc_id", "text")
    bits = filter_audit.sketch_bits(1_000)
    possible = {r.id for r in filter_audit.possible_repeats(prints, filter_audit.repeated_cells(prints.select("print"), bits), bits).collect()}
    repeated = {i for i in range(1_000) if i < 100 or i >= 900}
    assert repeated <= possible and len(possible - repeated) < 100


def test_sketch_size_is_bounded():
    assert filter_audit.sketch_bits(0) == filter_audit.sketch_bits(1) == 15
    assert filter_audit.sketch_bits(1 << 20) == 23 and filter_audit.sketch_bits(1 << 60) == filter_audit.MAX_BITS


def test_no_rows(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(frame(spark, []), labels).collect() == []
    one = measured(filter_audit.audit(frame(spark, [(None, None, None)]), labels))
    assert len(one) == 600 and one["", "BACDE", 2] == (0, 1, 0, 1, 0, 0, 120)
