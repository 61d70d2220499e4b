"""Many small text files in few bundles, and token blocks that read their texts twice."""

import glob
import gzip
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.operators import blocks as B
from tessella.operators import paragraphs as P
from tessella.plans import queries as Q
from tessella.plans import views as V
from tessella.plans.oracles import SQL
from tessella.sources import corpus, lines

SMALL = "/root/testdata/sf0.001"
NAMES = ["a", "a b", "a%20b", "a+b", "tab\there", "line\nbreak", "é日", "x/y=z", "", *[f"n{i}" for i in range(60)]]
VALUES = ["1. first", "\t", "", "  ", "cut\rhere", "a\tb", "2. second", "é日本" * 9, "end"]


def made_lines(spark):
    rows = [(name, i % 3, i, VALUES[(i * 7 + n) % len(VALUES)]) for n, name in enumerate(NAMES) for i in range(30)]
    return rows, spark.createDataFrame(rows, "file string, chunk bigint, pos bigint, value string")


@pytest.mark.parametrize("block", ["128m", "300b"])
def test_bundles_give_back_files_and_lines(spark, tmp_path, block):
    rows, table = made_lines(spark)
    lines.write_bundles(table, str(tmp_path / "b"))
    if block != "128m":  # unpacked, they are cut into blocks
        for i, name in enumerate(sorted(glob.glob(str(tmp_path / "b" / "*.txt.gz")))):
            (tmp_path / "u").mkdir(exist_ok=True)
            (tmp_path / "u" / f"{i}.txt").write_bytes(gzip.open(name).read())
    assert len(glob.glob(str(tmp_path / "b" / "*.txt.gz"))) <= 8
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    folder = str(tmp_path / ("b" if block == "128m" else "u"))
    try:
        scanned = lines.scan_bundles(spark, folder)
        want = {name: [v for f, _, _, v in sorted(rows, key=lambda r: r[1:3]) if f == name] for name in NAMES}
        for numbered in (lines.number_scanned(scanned), lines.number_lines(scanned)):
            got = {}
            for r in sorted(numbered.collect(), key=lambda r: (r.file, r.line_no)):
                got.setdefault(r.file, []).append((r.line_no, r.value))
            assert got == {name: list(enumerate(values, 1)) for name, values in want.items()}
        keys = corpus.read_plain_text(spark, folder, bundled=True).orderBy("key").collect()
        assert [r.text for r in keys] == [v for name in sorted(NAMES, key=str.encode) for v in want[name]]
        assert [r.key for r in keys] == list(range(len(rows)))
        plain = {tuple(r) for r in P.text_paragraphs(table).collect()}
        assert {tuple(r) for r in corpus.read_corpus_text(spark, folder, bundled=True).collect()} == plain
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bundles_with_bad_bytes_and_without_names(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"f\tgood\n\nf\tlast\n")
    with pytest.raises(Exception, match="line without the name of its file"):
        lines.scan_bundles(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "ok.txt").write_bytes(b"f\tgo\xffod \xe6\x97\nf\t\xc3\nf\t\n")
    got = corpus.read_plain_text(spark, str(tmp_path / "ok.txt"), bundled=True).orderBy("key").collect()
    assert [r.text for r in got] == ["good ", "", ""]


def test_the_files_of_the_queries_are_few(spark):
    """There was one file, in a folder of its own, for every source and 512 documents."""
    many = V.corpus_lines(spark, SMALL).select("file", "chunk").distinct().count()
    folder = Q._text_files(spark, SMALL)
    assert sum(len(names) for _, _, names in os.walk(folder)) < many
    assert lines.scan_bundles(spark, folder).select("file").distinct().count() == many


def test_files_of_odd_documents_equal_their_sql(spark, tmp_path):
    """Carriage returns are no line ends, and the names of sources may hold any character."""
    rows = [(i, ["web", "a b", "a%b", "é:1"][i % 4], f"word{i}\rnext {i}\n\n line\t{i}  \nlast") for i in range(1_100)]
    made = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("lang", F.lit("en"))
    made.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("corpus_files", "token_blocks_files"):
        got = sorted(tuple(r) for r in Q.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(db.sql(SQL[name]).fetchall()), name
        assert got


def test_token_blocks_read_their_texts_twice(spark):
    """Once for their sizes and once for their words; every level of totals read them again."""
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    texts = spark.range(500).select(F.col("id").alias("key"), F.udf(count, "string")(F.concat(F.lit("a b c d "), "id")).alias("text"))
    made = B.token_blocks(texts, 100).orderBy("block_id").collect()
    assert [len(r.tokens) for r in made] == [100] * 25
    assert made[0].tokens[:10] == ["a", "b", "c", "d", "0", "a", "b", "c", "d", "1"]
    assert seen.value == 1000
