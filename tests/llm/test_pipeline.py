"""The pipeline on a small corpus, stage by stage, against plain versions of its operators."""

import glob
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import decontamination, toxicity
from tests.llm.test_operators import PROSE, plain_components, plain_print

# Besides the columns of documents, names that the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, n_chars bigint, score int, predicted int, spans int, n_removed int, item_ids int, row int, root int, first_key int, found int"


def corpus():
    """(id, text) rows, toxic labels, benchmark items."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'aeiou'[i % 5]}n" for i in range(900)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    texts, labels = [], []
    for i in range(120):
        words = prose(n := int(rng.integers(20, 500)))
        if toxic := i % 4 == 0:
            for at in rng.integers(0, n, 5):
                words[at] = "Vilething"
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    passage = "\n".join(" ".join(prose(9)) for _ in range(6))
    items = [" ".join(prose(n)) for n in (14, 40)]
    copied = " ".join(prose(80))
    near = " ".join([*copied.split()[:40], "other", *copied.split()[41:]])
    texts += [(200 + i, f"{' '.join(prose(60))}\n{passage}\n{' '.join(prose(12))}") for i in range(3)]
    texts += [(300, copied), (301, copied), (301, copied), (302, near)]
    texts += [(400, f"{' '.join(prose(20))} {items[0]} {' '.join(prose(20))}"), (401, items[1].upper())]
    texts += [(500, None), (501, ""), (502, " \n "), (503, PROSE + " <|endoftext|> é "), (504, " ".join(prose(9_000)))]
    texts += [(None, " ".join(prose(50))), (None, " ".join(prose(50)))]
    texts += [(None, "Vilething " * 9), (506, "word")]
    return texts, [*labels, (None, 1), (0, None)], [*enumerate(items), (7, None), (None, items[0]), (8, "too short")]


def save(spark, folder, texts, labels, items):
    rows = [(i, t, "en", None if t is None else len(t), *range(9)) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def plain_chunks(text):
    """(words, text) of each chunk."""
    lines = [] if text is None else text.split("\n")
    counts = [len(re.findall(r"[^\x20\x09-\x0D]+", line)) for line in lines]
    marks = [int(hashlib.md5(line.encode()).hexdigest()[:8], 16) if n < 8 else None for line, n in zip(lines, counts)]
    chunks = []
    for i, line in enumerate(lines):
        begins = i == 0 or marks[i] is None or marks[i - 1] is None
        begins = begins or (((marks[i - 2] or 0) if i > 1 else 0) * 31 + marks[i - 1]) % 4 == 0
        if begins:
            chunks.append([])
        chunks[-1].append((counts[i], line))
    return [(sum(n for n, _ in c), "\n".join(line for _, line in c)) for c in chunks]


def plain_line_dedup(rows):
    order = lambda i: (i is not None, i or 0)
    places = [(order(i), t, at, words, chunk) for i, t in rows for at, (words, chunk) in enumerate(plain_chunks(t))]
    often = Counter(p[4] for p in places)
    first = {}
    for doc, t, at, _, chunk in places:
        first[chunk] = min(first.get(chunk, (doc, t, at)), (doc, t, at))
    out = []
    for i, t in rows:
        chunks = plain_chunks(t)
        later = [often[c] > 1 and first[c] != (order(i), t, at) for at, (_, c) in enumerate(chunks)]
        gone, at = set(), 0
        while at < len(chunks):
            end = at
            while end < len(chunks) and later[end]:
                end += 1
            if sum(words for words, _ in chunks[at:end]) >= 20:
                gone |= set(range(at, end))
            at = max(end, at + 1)
        out.append((i, t if not gone else "\n".join(c for at, (_, c) in enumerate(chunks) if at not in gone)))
    return out


def plain_first_of_each(rows):
    prints = {row: plain_print(row[1]) for row in set(rows)}
    groups = plain_components(prints.values(), 4)
    best = {}
    for row, value in prints.items():
        kept = best.setdefault(groups[value], row)
        if row[0] is not None and (kept[0] is None or row[0] < kept[0]):
            best[groups[value]] = row
    return list(best.values())


def plain_leaks(text, items):
    have = re.findall(r"[^\W_]+", (text or "").lower())
    count = lambda x: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
    wanted = [i.split() for _, i in items if i and len(i.split()) >= 5]
    return any(decontamination.similarity(count(have[at : at + len(w)]), count(w)) >= 0.8 for w in wanted for at in range(len(have) - len(w) + 1))


def plain_toxic(field, text):
    scores = np.array([field.emission(w) for w in toxicity.TOKEN.findall(text or "")])
    if not len(scores):
        return field.score(np.zeros(0)) >= 0.7
    left, right = field.messages(scores[None], np.ones((1, len(scores)), bool))
    return field.score((left * right / (1 + left * right))[0]) >= 0.7


def test_every_stage_is_the_plain_one(spark, tmp_path):
    texts, labels, items = corpus()
    save(spark, tmp_path, texts, labels, items)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/pipeline-*"))
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    (folder,) = set(glob.glob(f"{shared}/pipeline-*")) - before
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = {}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        frame = spark.read.parquet(f"{folder}/{name}")
        assert frame.dtypes == documents.dtypes
        found = frame.collect()
        assert all(tuple(r)[4:] == tuple(range(9)) for r in found)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
        stages[name] = [(r.doc_id, r.text) for r in found]
    same = lambda name, wanted: Counter(stages[name]) == Counter(wanted)

    field = toxicity.learn(documents, spark.read.parquet(f"{tmp_path}/labels.parquet"), ~corpus_pipeline.held_out(F.col("doc_id")))
    clean = [(i, t) for i, t in texts if not plain_toxic(field, t)]
    assert same("toxicity", clean)
    # Planted: toxic documents go, all others stay.
    assert {i for i, _ in clean} == {i for i, _ in texts if i is None or i >= 120 or i % 4} and len(clean) == len(texts) - 31
    cut = plain_line_dedup(clean)
    assert same("line_dedup", cut) and sum(a != b for a, b in zip(cut, clean)) >= 2
    first = plain_first_of_each(cut)
    assert same("simhash", first)
    ids = Counter(i for i, _ in first)
    # Line dedup emptied the copies in 301, so these head the group of empty texts.
    assert ids[300] == ids[301] == 1 and ids[None] == 2 and not any(ids[i] for i in (302, 500, 501, 502))
    left = [(i, t) for i, t in first if not plain_leaks(t, items)]
    assert same("decontamination", left) and {i for i, _ in first} - {i for i, _ in left} == {400, 401}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in left]
    plain = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in encoded]
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last) == Counter(plain)


def test_empty_tables(spark, tmp_path):
    save(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
