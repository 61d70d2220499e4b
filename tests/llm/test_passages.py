"""Repeated passages of short lines, to the line."""

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import line_chunks
from tests.llm.test_operators import awkward, empty, rows

RNG = np.random.default_rng(12)


def lines(n, low, high):
    """``n`` different lines of ``low`` to ``high`` words."""
    return [" ".join(f"w{x}" for x in RNG.integers(0, 10**9, RNG.integers(low, high + 1))) for _ in range(n)]


def passage(low, high):
    """50 to 100 words in lines of 3 to 7 words."""
    made = []
    while sum(len(x.split()) for x in made) < RNG.integers(50, 94):
        made += lines(1, low, high)
    return made


def test_passages_of_short_lines_go_whole(spark):
    texts, wanted = [], {}
    for k in range(40):
        shared = passage(3, 7) if k % 4 else [*passage(3, 4), "", *lines(1, 9, 12), "", *lines(2, 3, 3)]
        for copy in range(3):
            before, after = lines(5, 1, 7), lines(5, 1, 7)
            i = 10 * k + copy
            texts.append((i, "\n".join([*before, *shared, *after])))
            wanted[i] = "\n".join([*before, *(shared if copy == 0 else []), *after])
    got = {r.doc_id: r for r in line_chunks.dedup_passages(rows(spark, texts)).collect()}
    assert {i: r.text for i, r in got.items()} == wanted
    assert all((r.n_removed > 0) == (i % 10 > 0) for i, r in got.items())
    stage = corpus_pipeline.repeated_lines(spark, rows(spark, texts).withColumn("n_chars", line_chunks.F.length("text").cast("bigint")), "")
    assert {r.doc_id: (r.text, r.n_chars) for r in stage.collect()} == {i: (t, len(t)) for i, t in wanted.items()}
    # The chunks alone, as the stage had them before.
    chunks = {r.doc_id: r.text for r in line_chunks.dedup_lines(rows(spark, texts)).collect()}
    left = sum(len(chunks[i].split()) - len(t.split()) for i, t in wanted.items())
    all_words = sum(len(t.split()) - len(wanted[i].split()) for i, t in texts)
    print(f"words of {all_words} that the chunks leave: {left}")
    assert left > 0


@pytest.mark.parametrize("size", [1, 2, 5])
def test_short_repeats_and_first_copies_stay(spark, size):
    title, verse = "a common title", [f"verse {i} of it" for i in range(12)]
    texts = [(i, "\n".join([*lines(3, 1, 7), title, *lines(size, 1, 7)])) for i in range(6)]
    texts.append((20, "\n".join(["same words here again"] * 30)))  # repeats inside one text
    texts += [(30 + i, "\n".join(verse)) for i in range(2)]
    got = {r.doc_id: r.text for r in line_chunks.dedup_passages(rows(spark, texts)).collect()}
    assert all(got[i] == t for i, t in texts if i < 20)
    assert set(got[20].split("\n")) == {"same words here again"}
    assert got[30] == texts[-2][1] and got[31] == ""


def test_awkward_rows(spark):
    frame = awkward(spark)
    got = line_chunks.dedup_passages(frame)
    assert got.columns == [*frame.columns, "n_removed"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[3] == [" \n\t "]
    assert by[4][0] and by[5] == ["", ""]
    assert by[None] and by[9] == [""]
    assert line_chunks.dedup_passages(empty(spark)).count() == 0
