"""The pipeline's near copies against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import near_copies
from tests.llm.test_operators import awkward, empty, rows


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"new{rng.integers(10**9)}"
    return out


def corpus():
    """Texts of 100 words and copies with 1 to 5 words changed, on both sides of similarity 0.8, and a chain."""
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = []
    for _ in range(30):
        base = words(100)
        texts += [base, edited(rng, base, int(rng.integers(1, 6))), edited(rng, base, int(rng.integers(1, 6)))]
    hub = words(100)
    texts += [edited(rng, hub, int(rng.integers(0, 4))) for _ in range(60)]
    for _ in range(20):
        hub = edited(rng, hub, 1)
        texts.append(hub)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("small", "tile"), [(64, 512), (3, 512), (3, 10)])
def test_every_pair_of_similarity(spark, small, tile):
    texts = corpus()
    sets = {i: shingles(t) for i, t in texts}
    left, wanted = set(sets), {}
    while left:
        group, front = set(), [left.pop()]
        while front:
            x = front.pop()
            group.add(x)
            near = {y for y in left if similar(sets[x], sets[y])}
            left -= near
            front += near
        wanted |= {x: min(group) for x in group}
    got = {r.doc_id: r.component for r in near_copies.near_copies(rows(spark, texts), small=small, tile=tile).collect()}
    assert got == wanted and 40 < len(set(wanted.values())) < 140


def test_stage_takes_copies_that_four_bits_miss(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
    texts = [(1, " ".join(base)), *((2 + i, " ".join(edited(rng, base, 2))) for i in range(10)), (50, " ".join(edited(rng, base, 12)))]
    assert not similar(shingles(texts[0][1]), shingles(texts[-1][1]))
    kept = corpus_pipeline.near_duplicates(spark, rows(spark, texts), "")
    assert {r.doc_id for r in kept.collect()} == {1, 50}


def groups_of(edges, members):
    root = {m: m for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {m: find(m) for m in members}


def test_stage_goes_by_fingerprints(spark, monkeypatch):
    """The stage's candidates connect all nodes within four fingerprint bits."""
    seen, plain = [], near_copies.fingerprint_pairs
    monkeypatch.setattr(near_copies, "fingerprint_pairs", lambda prints: seen.append((prints, plain(prints))) or seen[0][1])
    corpus_pipeline.near_duplicates(spark, rows(spark, corpus()), "").collect()
    ((prints, pairs),) = seen
    fps = {r.node: r.fp for r in prints.collect()}
    close = [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 4]
    found = [(r.a, r.b) for r in pairs.collect()]
    assert len(close) > 20 and set(map(tuple, map(sorted, found))) <= set(close)
    assert groups_of(found, fps) == groups_of(close, fps)


def test_awkward_rows(spark):
    got = near_copies.near_copies(awkward(spark)).collect()
    assert len(got) == 10
    assert {r.doc_id: r.component for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, None: 9, 8: 8, 9: 9}
    assert near_copies.near_copies(empty(spark)).count() == 0
