"""The training-data operators against plain versions, on small rows that hold the awkward cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import byte_pairs, chat, decontamination, languages, line_chunks, quality, sharding, simhash, token_counts, toxicity
from tessella.llm.components import components

DOCS = "doc_id bigint, text string, lang string, chunk string, doc string, n int"
PROSE = "the old house of the river was not in the town and it is for them that we came with a boat by the sea on that day"


def rows(spark, texts, lang="en"):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "x", "y", 1) for i, t in texts], DOCS)


def awkward(spark):
    long = " ".join(f"word{i} of" for i in range(9_000))
    return rows(spark, [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (5, long), (None, PROSE), (None, PROSE), (8, "é" * 5_000), (9, PROSE)])


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Line dedup


def test_line_chunks_remove_later_copies(spark):
    shared = "\n".join(f"{PROSE} number {i}\nshort {i}" for i in range(3))
    texts = [(1, f"own start one\n{shared}\nend"), (2, f"another\nline\n{shared}"), (3, shared), (4, f"x\n\n{PROSE} number 9\nkeep")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_chunks.dedup_lines(rows(spark, texts)).collect()}
    assert got[1] == (texts[0][1], 0)
    assert got[3] == ("", 6) and "number" not in got[2][0] and got[2][0].startswith("another")
    assert got[4] == (texts[3][1], 0)


def test_line_chunks_do_not_move_with_insertions(spark):
    run = [f"item {i} of list" for i in range(200)]
    frame = spark.createDataFrame([(1, "\n".join(run)), (2, "\n".join(["new", *run]))], "doc_id int, text string")
    chunks = [{c.text for c in r.c} for r in line_chunks.with_chunks(frame, "text", "c").orderBy("doc_id").collect()]
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 2
    assert max(map(len, chunks[0])) > len(run[0])


def test_line_chunks_awkward_rows(spark):
    frame = awkward(spark)
    got = line_chunks.dedup_lines(frame)
    assert got.columns == [*frame.columns, "n_removed"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[3] == [" \n\t "]
    assert by[4][0] and by[5] == ["", ""]
    assert by[None] == [PROSE, PROSE] and by[9] == [""]  # null ids come first; equal rows are one document
    assert line_chunks.dedup_lines(empty(spark)).count() == 0


# SimHash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    left, out = set(prints), {}
    while left:
        group, front = set(), [left.pop()]
        while front:
            x = front.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            front += near
        out |= {x: frozenset(group) for x in group}
    return out


@pytest.mark.parametrize(("small", "tile"), [(64, 4_096), (3, 4_096), (3, 25), (10**6, 10)])
def test_simhash_links_are_complete(spark, small, tile):
    rng = np.random.default_rng(5)
    prints = set()
    for base in rng.integers(0, 1 << 62, 3):
        bits = rng.choice(64, 14, replace=False)
        prints |= {int(base) ^ sum(1 << int(b) for b in bits if rng.random() < 0.2) for _ in range(120)}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 4, small, tile)
    root = {r.node: r.root for r in components(edges).collect()}
    wanted = plain_components(prints, 4)
    groups = {}
    for p, s in zip(prints, signed):
        groups.setdefault(root.get(s, s), set()).add(p)
    assert {frozenset(g) for g in groups.values()} == set(wanted.values())


def test_simhash_awkward_rows(spark):
    texts = [(1, None), (2, ""), (3, " \t"), (7, PROSE), (4, PROSE.upper()), (None, PROSE), (6, "two words"), (5, PROSE)]
    got = simhash.near_duplicates(rows(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        text = dict(texts)[r.doc_id]
        assert r.simhash & (1 << 64) - 1 == plain_print(text)
        assert r.component == (1 if not (text or "").strip() else 6 if r.doc_id == 6 else 4)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# Quality rules


def test_quality_counts(spark):
    texts = [(1, None), (2, " \n "), (3, "a b c a b c d"), (4, "x\nx\n\nx\ny #&"), (5, "a a a a a"), (6, PROSE), (7, "a b c\x1cq a b c")]
    got = {r.doc_id: r for r in quality.judge(rows(spark, texts)).collect()}
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {p for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or "")) and r.base_failed and not r.kept


def test_quality_distance_and_verdict(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    frame = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a)
    assert frame.select(quality.distance(F.col("p"), F.col("q")).alias("d")).first().d == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))
    clean = [" ".join(np.random.default_rng(i).permutation((PROSE + " " + " ".join(f"x{chr(97 + j)}{chr(97 + i)}ond" for j in range(26))).split() * 3)) for i in range(20)]
    junk = " ".join(f"{w}***$$$" for w in clean[0].split())
    got = {r.doc_id: r.kept for r in quality.judge(rows(spark, [*enumerate(clean), (99, junk)])).collect()}
    assert not got.pop(99) and all(got.values())
    assert quality.judge(empty(spark)).count() == 0
    assert quality.judge(awkward(spark)).count() == 10


# Chat


def test_chat_tree_ranks_paths(spark):
    messages = spark.createDataFrame(
        [
            ("t", 1, None, "user", "hi <|im_end|>\\", 0.0, "extra"),
            ("t", 2, 1, "assistant", "low", 0.1, ""),
            ("t", 3, 1, "assistant", "high", 0.9, ""),
            ("t", 4, 3, "us\ner", None, 0.9, ""),
            ("t", 5, 4, "assistant", "<|im_start|>x", 0.9, ""),
            ("u", 1, 99, "user", "orphan", None, ""),
            ("c", 1, 2, "user", "cycle", 1.0, ""),
            ("c", 2, 1, "user", "cycle", 1.0, ""),
            (None, 1, None, None, "no name", 1.0, ""),
        ],
        "conv string, id int, parent int, role string, text string, score double, path string",
    )
    every = chat.format_trees(messages, best=None).withColumns({"turns": chat.parse_turns(F.col("formatted")), "learned": chat.loss_text(F.col("formatted"), F.col("loss"))}).collect()
    got = {(r.conv, r.path): r for r in every}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1), (None, 1)}
    best = got["t", 1]
    assert [(t.role, t.text) for t in best.turns] == [("user", "hi <|im_end|>\\"), ("assistant", "high"), ("us\ner", ""), ("assistant", "<|im_start|>x")]
    assert best.learned == "high<|im_start|>x" and best.leaf == 5 and best.n_turns == 4
    assert got["t", 2].score == pytest.approx(0.05) and got["t", 2].learned == "low"
    one = chat.format_trees(messages).collect()
    assert {(r.conv, r.leaf) for r in one} == {("t", 5), ("u", 1), (None, 1)}


def test_chat_long_conversation(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"text {i}" if i % 5 else None) for i in range(300)]
    frame = spark.createDataFrame(turns + [(2, 0, None, ""), (2, 0, None, "")], "conv_id int, turn int, role string, text string")
    done = chat.format_trees(chat.by_turn(frame)).withColumns({"turns": chat.parse_turns(F.col("formatted")), "learned": chat.loss_text(F.col("formatted"), F.col("loss"))})
    got = {r.conv: r for r in done.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for _, _, r, t in turns]
    assert got[1].learned == "".join(t or "" for _, _, r, t in turns if r == "assistant")
    assert len(got[2].turns) == 2
    assert chat.format_trees(chat.by_turn(frame.limit(0))).count() == 0


# Tokens

TRICKY = [
    "don't we'll  see\n\nthe 3rd",
    "a<|endoftext|>b <|startoftext|>",
    "É É ΣΑΣ İı \x1c\x1d\x85\xa0 x",
    "  lead and trail  \t\n ",
    "日本語 🙂🙂 ​",
    "a" * 700 + " " + "é" * 300,
    "x \xa0 \n y" * 9,
    "'s 't '",
]


@pytest.mark.parametrize("chunk", [7, 50, 65_536])
def test_token_counts_like_the_library(spark, chunk):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*enumerate(TRICKY), (90, None), (91, ""), (91, "")]
    got = token_counts.count_tokens(rows(spark, texts), path, "text", "doc", chunk)
    assert got.columns == [*[c for c in rows(spark, texts).columns if c != "doc"], "doc"]
    found = sorted((r.doc_id, r.text or "", r.doc) for r in got.collect())
    assert found == sorted((i, t or "", len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


@pytest.mark.parametrize(("block", "leaf"), [(10, 4), (64, 16), (65_536, 2_048)])
def test_byte_pairs_like_the_library(spark, block, leaf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*enumerate(TRICKY), (90, None), (91, ""), (91, "")]
    got = byte_pairs.round_trip(rows(spark, texts), path, block=block, leaf=leaf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(dict(texts)[r.doc_id] or "", add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_pairs.round_trip(empty(spark), path).count() == 0


def test_byte_pairs_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = rows(spark, list(enumerate(TRICKY)))
    back = byte_pairs.decode_ids(byte_pairs.with_ids(frame, path), path)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(TRICKY))


# Decontamination


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    items = [words(n) for n in (12, 30, 60, 60)]
    edited = items[2][:30] + ["changed"] + items[2][31:]
    worse = [w if i % 8 else "no" for i, w in enumerate(items[3])]
    texts = [
        (1, " ".join(words(50) + items[0] + words(50))),
        (2, ("X, " + ", ".join(items[1])).upper()),
        (3, " ".join(words(9) + edited + words(9))),
        (4, " ".join(worse)),
        (5, " ".join(words(300))),
        (6, None),
        (7, ""),
        (8, " ".join(items[0][:6])),
        (9, " ".join(words(3) + items[1] + words(3) + items[0])),
        (9, " ".join(words(3) + items[1] + words(3) + items[0])),
    ]
    bench = spark.createDataFrame([(10 + i, " ".join(w)) for i, w in enumerate(items)] + [(5, " ".join(items[0])), (6, "the of"), (7, None), (None, "a b c d e f")], "item_id bigint, text string")

    def plain(text):
        found = {}
        for i, item in zip((5, 11, 12, 13), items):
            have = re.findall(r"\w+", (text or "").lower())
            for at in range(len(have) - len(item) + 1):
                count = lambda x: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
                value = decontamination.similarity(count(have[at : at + len(item)]), count(item))
                if value >= 0.8:
                    found[i] = max(value, found.get(i, 0))
        return found

    for block in (20_000, 2):
        for r in decontamination.contaminated(rows(spark, texts), bench, block=block).collect():
            wanted = plain(r.text)
            assert r.item_ids == sorted(wanted) and r.similarity == pytest.approx(max(wanted.values(), default=0.0))
    assert plain(texts[2][1]) and not plain(texts[3][1])
    assert decontamination.contaminated(empty(spark), bench).count() == 0
    assert {tuple(r.item_ids) for r in decontamination.contaminated(rows(spark, texts), bench.limit(0)).collect()} == {()}


# Sharding


def test_sharding(spark):
    frame = spark.range(3_000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("size"), sharding.virtual_slot(F.col("id"), slots=64).alias("virtual_slot"))
    sizes = sharding.slot_sizes(frame, 64).cache()
    first = sharding.first_map(sizes, 4).cache()
    assert first.count() == 64
    loads = [r.b for r in first.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert len(loads) == 4 and max(loads) < 1.05 * min(loads)
    grown = sharding.rebalance(first, sizes, 5).cache()
    moved = grown.withColumnRenamed("shard", "new").join(first, "virtual_slot").filter("new <> shard").collect()
    assert grown.count() == 64 and moved and sum(r.new == 4 for r in moved) >= len(moved) - 4
    placed = sharding.place(frame, first.withColumn("version", F.lit(1)), sizes, ["doc_id"]).toPandas()
    for _, group in placed.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))


def test_slot_map_versions(spark, tmp_path):
    one = spark.createDataFrame([(0, 0), (1, 1)], "virtual_slot int, shard int")
    sharding.save_map(one, f"file://{tmp_path}/map", 1)
    sharding.save_map(one.withColumn("shard", F.lit(2)), f"file://{tmp_path}/map", 2)
    read = lambda *v: {(r.shard, r.version) for r in sharding.load_map(spark, f"file://{tmp_path}/map", *v).collect()}
    assert read() == {(2, 2)} and read(1) == {(0, 1), (1, 1)}
    assert sharding.first_map(sharding.slot_sizes(spark.createDataFrame([], "virtual_slot int, size bigint"), 8), 3).count() == 8


# Toxicity and language


def chain_marginals(field, scores):
    """All label sequences, weighed one by one."""
    total, ones = 0.0, np.zeros(len(scores))
    for code in range(1 << len(scores)):
        y = [code >> i & 1 for i in range(len(scores))]
        weight = np.exp(sum(s * v for s, v in zip(scores, y)) + field.start * y[0] + field.moves[0, y[0]] * 0 + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        total, ones = total + weight, ones + weight * np.array(y)
    return ones / total


def test_field_marginals_are_exact():
    field = toxicity.Field()
    field.moves, field.start = np.array([[0.3, -1.0], [0.2, 0.7]]), -0.4
    lists = [np.random.default_rng(i).normal(size=n) for i, n in enumerate((1, 2, 9, 5))] + [np.zeros(0)]
    for scores, got in zip(lists, field.marginals(lists)):
        if len(scores):
            np.testing.assert_allclose(got, chain_marginals(field, scores), rtol=1e-5)


@pytest.mark.parametrize("stay", [0.0, 4.0, 12.0])
def test_long_texts_have_the_marginals_of_the_whole_chain(stay):
    """Labels that stick for thousands of tokens, lengths around the limits of pieces, several texts at once."""
    field = toxicity.Field()
    field.moves, field.start = np.array([[stay, -stay], [-stay, stay]]) / 2, 0.3
    lists = [np.random.default_rng(n).normal(size=n) * 0.2 for n in (5_000, 255, 256, 257, 0, 512, 513, 1, 769)]
    lists[0][2_000:] = 0.0
    lists[0][0], lists[0][-1] = 5.0, -20.0
    for scores, got in zip(lists, field.marginals(lists)):
        if len(scores):
            left, right = field.messages(scores[None], np.ones((1, len(scores)), bool))
            np.testing.assert_allclose(got, (left * right / (1 + left * right))[0], rtol=1e-4, atol=1e-7)
    extreme = np.tile([500.0, -500.0], 600)
    assert np.isfinite(field.marginals([extreme])[0]).all()


def test_toxicity_learns_and_scores(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}on" for i in range(300)]
    texts, labels = [], []
    for i in range(300):
        words = list(rng.choice(vocabulary, 60))
        if toxic := i % 4 == 0:
            for at in rng.integers(0, 60, 4):
                words[at] = "Vilething"
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    texts += [(900, None), (901, ""), (901, ""), (None, "Vilething " * 5)]
    frame, marks = rows(spark, texts), spark.createDataFrame(labels + [(None, 1), (0, None)], "doc_id bigint, toxic int")
    field = toxicity.learn(frame, marks, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in toxicity.score(frame, field).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    span = got[0].spans[0]
    assert dict(texts)[0][span.start : span.end].startswith("Vilething")
    assert got[900].score == got[901].score < 0.5 and got[None].predicted == 1
    assert toxicity.learn(frame, marks.limit(0), F.lit(True)) is None
    assert {r.score for r in toxicity.score(frame, None).collect()} == {0.0}
    assert toxicity.score(empty(spark), field).count() == 0


def test_languages(spark):
    texts = [(i, f"{PROSE} {i}") for i in range(20)]
    german = [(50 + i, f"der alte Mann und das Haus von dem Fluss nicht für die Stadt {i}") for i in range(20)]
    frame = rows(spark, texts).unionByName(rows(spark, german, "de")).unionByName(rows(spark, [(99, "unlabelled")], None))
    trees = languages.learn(frame, "lang")
    asked = rows(spark, [(1, "we came by the river"), (2, "die Stadt und der Mann"), (3, None), (4, "12 34 !"), (5, ""), (6, "the house " * 300_000), (6, "é")])
    got = [(r.doc_id, r.lang_pred, r.score) for r in languages.identify(asked, trees).collect()]
    assert sorted((i, p) for i, p, _ in got)[:5] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert all(0 <= s <= 1 for *_, s in got) and ("en" in [p for i, p, _ in got if i == 6])
    assert {r.lang_pred for r in languages.identify(asked, languages.learn(frame.limit(0), "lang")).collect()} == {"und"}
    assert languages.identify(empty(spark), trees).count() == 0


@pytest.mark.parametrize("cells", [None, 900, 60])
def test_no_entry_is_left_out(spark, cells):
    """A rare language beside a hot one is kept; blocks and parts of languages give the same result."""
    hot = [(i, f"{PROSE} {i}") for i in range(300)]
    frame = rows(spark, hot).unionByName(rows(spark, [(1_000, "seltsam über die Maßen")], "de")).unionByName(rows(spark, [(1_001, "ciónñ ñezco llue")], "es"))
    learned = languages.learn(frame, "lang", cells=cells)
    assert learned.labels == ["de", "en", "es"] and (len(learned.passes) > 3) == (cells == 60)
    whole = languages.learn(frame, "lang", cells=1 << 40)
    asked = rows(spark, [(1, "über die Maßen seltsam"), (2, "by the river"), (3, "ñezco ciónñ"), (4, None), (5, "?"), (6, PROSE * 50), (6, PROSE * 50)])
    got, wanted = ({(r.doc_id, r.lang_pred, round(r.score, 6)) for r in languages.identify(asked, x).collect()} for x in (learned, whole))
    assert got == wanted and {(i, p) for i, p, _ in got} == {(1, "de"), (2, "en"), (3, "es"), (4, "und"), (5, "und"), (6, "en")}


def test_new_columns_refuse_taken_names(spark):
    docs = rows(spark, [(1, "a")]).withColumn("SCORE", F.lit("mine"))
    for apply in (lambda **k: languages.identify(docs, None, **k), lambda **k: toxicity.score(docs, None, **k)):
        with pytest.raises(ValueError, match="score"):
            apply()
    assert languages.identify(docs, None, into=("l", "s")).first().SCORE == "mine"
    assert toxicity.score(docs, None, into=("x", "y", "z")).first().SCORE == "mine"


def test_code_lengths_are_exact():
    """Against a walk down one tree, byte by byte."""
    data = b"abracadabra abracad"
    padded = bytes(languages.ORDER) + data
    codes = [int.from_bytes(padded[i : i + 4]) for i in range(len(data))]
    counts = Counter(codes)
    trees = languages.ContextTrees(["x"], np.zeros(len(counts), np.int64), np.array(list(counts)), np.array(list(counts.values()), float))

    def cost(context, byte):
        seen = Counter(c & 255 for c in codes if context == b"" or (c >> 8).to_bytes(3).endswith(context))
        total, distinct = sum(seen.values()), len(seen)
        if seen[byte]:
            return -np.log2(seen[byte] / (total + distinct))
        escape = -np.log2(distinct / (total + distinct)) if total else 0.0
        return escape + (cost(context[1:], byte) if context else 8.0)

    text = "abra xcad"
    raw = bytes(3) + text.encode()
    wanted = sum(cost(raw[i : i + 3], raw[i + 3]) for i in range(len(text)))
    assert trees.code_lengths([text])[0, 0] == pytest.approx(wanted, rel=1e-5)
    assert zlib.crc32(b"1") % 3 in (0, 1, 2)
