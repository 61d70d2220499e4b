"""Input shapes for the queries, derived by Spark from the given tables.

Each function has an SQL counterpart of the same name in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import compute_once
from tessella.functions.text import words
from tessella.operators.ordering import input_bytes, spread
from tessella.operators.exams import eval_requests, exam_prompts
from tessella.operators.paragraphs import explode_sentences, segment

GREEK_TAIL = " λόγος τοῦ θεοῦ et ἀρχή."
CHUNK_DOCUMENTS = 512
SHARE_BYTES = 1 << 22  # of stored documents; bodies are some forty times as many
SWEEP_ROOT = "results"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def _lines(docs: DataFrame, extension: str, values: Column) -> DataFrame:
    """A line table with one file per source; 512 neighbouring documents make a chunk."""
    split = compute_once(docs, "_values", values).select(
        F.concat("source", F.lit(extension)).alias("file"),
        F.floor(F.col("doc_id") / CHUNK_DOCUMENTS).cast("long").alias("chunk"),
        "doc_id",
        F.posexplode("_values").alias("piece", "value"),
    )
    return split.select("file", "chunk", F.struct("doc_id", "piece").alias("pos"), "value")


def corpus_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of numbered text files, one file per source. Every seventh document has no label, so
    it continues the paragraph before it, or is dropped if there is none."""
    labelled = F.when(F.col("doc_id") % 7 == 3, F.col("text")).otherwise(
        F.concat((F.col("doc_id") % 40 + 1).cast("string"), F.lit(". "), F.col("text"))
    )
    return _lines(documents(spark, folder), ".txt", F.split(labelled, "\n"))


BLANK_FILES = "_blank.TXT"


def blank_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files without labels: two blank lines after every document. Their texts may have lines
    that look like labels, such as those that begin with an address (see ``has_labels``)."""
    text = F.concat(F.col("text"), F.lit("\n \n"))
    return _lines(documents(spark, folder), BLANK_FILES, F.split(text, "\n"))


def has_labels() -> Column:
    """False for the files of ``blank_lines``; of all others the lines decide."""
    return F.when(F.col("file").endswith(BLANK_FILES), F.lit(False))


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines in five shapes by document number; a blank line follows every fifth."""
    kind = F.col("doc_id") % 5
    body = (
        F.when(kind == 0, F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), "text")))
        .when(kind == 1, F.to_json(F.struct("text")))
        .when(kind == 2, F.to_json(F.struct(F.col("doc_id").alias("n"), F.col("text").alias("z"), F.col("lang").alias("a"))))
        .when(kind == 3, F.to_json(F.struct(F.lit(5).alias("text"), F.col("text").alias("b"))))
        .otherwise(F.to_json(F.struct("text", F.lit("x").alias("a"))))
    )
    rows = F.when(kind == 4, F.array(body, F.lit("  "))).otherwise(F.array(body))
    return _lines(documents(spark, folder), ".jsonl", rows)


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a paragraph, every third with a Greek tail."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(GREEK_TAIL))).otherwise(F.col("text"))
    return documents(spark, folder).select(
        F.format_string("rec%04d", F.col("doc_id") + 1).alias("id"),
        (F.col("doc_id") + 1).alias("paragraph_index"),
        text.alias("text"),
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return segment(paragraphs(spark, folder))


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return explode_sentences(segments(spark, folder))


def _json(value: Column) -> Column:
    """One value as JSON text."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(*entries: tuple[str, Column]) -> Column:
    """A JSON object of the fields whose JSON text is not null."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in entries]), F.lit("}"))


def _damaged(number: Column, body: Column, cut: str) -> Column:
    """Every 17th body is cut off, every 19th call has none, some have text behind them or single quotes."""
    return (
        F.when(number % 17 == 0, F.lit(cut))
        .when(number % 19 == 1, F.lit(None).cast("string"))
        .when(number % 97 == 5, F.concat(body, F.lit(" done")))
        .when(number % 97 == 7, F.replace(body, F.lit('"'), F.lit("'")))
        .otherwise(body)
    )


def segment_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Segmentations as response bodies, every second without foreign spans. Every 23rd lacks its policy;
    others have values of a wrong type, a null list, or a field too many, besides ``_damaged``."""
    p = F.col("paragraph_index")
    spans = F.when(p % 97 == 9, F.lit("null")).when(p % 2 == 0, _json(F.col("foreign_spans")))
    body = _object(
        ("orthography_policy", F.when(p % 23 != 2, F.when(p % 97 == 3, F.lit("5")).otherwise(_json(F.col("orthography_policy"))))),
        ("normalized_paragraph", F.when(p % 97 == 13, F.lit('{"x":1}')).otherwise(_json(F.col("normalized_paragraph")))),
        ("sentences", F.when(p % 97 == 11, F.lit('["one",true]')).otherwise(F.to_json("sentences"))),
        ("foreign_spans", spans),
        ("note", F.when(p % 97 == 15, F.lit('[{"by":null}]'))),
    )
    return segments(spark, folder).select("paragraph_index", _damaged(p, body, '{"orthography_policy":').alias("body"))


def damage() -> Column:
    return F.col("paragraph_index") * 31 + F.col("sentence_index")


def with_teacher_bodies(sents: DataFrame) -> DataFrame:
    """A teacher response for every sentence, derived from all its words. Every 23rd lacks its main clause;
    others have values of a wrong type, nulls, or a field too many, besides ``_damaged``."""
    s, text = F.col("sentence_index"), F.col("sentence")

    def token(w: Column, i: Column) -> Column:
        return F.struct(
            w.alias("form"),
            F.lower(w).alias("lemma"),
            F.when(F.length(w) > 5, "NOUN").otherwise("X").alias("upos"),
            F.when(i % 2 == 0, "").otherwise("Case=Nom").alias("feats"),
            F.when(i == 0, 0).otherwise(1).alias("head"),
            F.when(i == 0, "root").otherwise("dep").alias("deprel"),
        )

    def rewrite(i: Column) -> Column:
        return F.struct(
            F.concat(F.lit("Swap"), i.cast("string")).alias("type"),
            text.alias("source_latin"),
            F.concat(F.lit(" "), i.cast("string"), F.lit(": "), text, F.lit(" ")).alias("target_latin"),
        )

    prepared = compute_once(sents, "w", words(text))
    d = damage()
    tokens = F.to_json(F.transform("w", token))
    flag = F.when(s % 2 == 0, "true").otherwise("false")
    translation = F.to_json(
        F.struct(F.concat(F.lit("LIT: "), text).alias("literal_en"), F.concat(F.lit(" EN: "), text, F.lit(" ")).alias("idiomatic_en"))
    )
    rewrites = F.to_json(F.transform(F.sequence(F.lit(1).cast("long"), 1 + s % 4), rewrite))
    body = _object(
        ("translation", F.when(d % 97 == 3, F.lit('{"literal_en":7,"idiomatic_en":null}')).otherwise(translation)),
        (
            "morphosyntax",
            F.when(d % 97 == 11, F.replace(tokens, F.lit('"head":0'), F.lit('"head":"0"')))
            .when(d % 97 == 12, F.replace(tokens, F.lit('"head":0'), F.lit('"head":0.5')))
            .when(d % 97 == 17, F.replace(tokens, F.lit('"feats":"Case=Nom"'), F.lit('"feats":null')))
            .otherwise(tokens),
        ),
        ("transforms", F.when(d % 97 == 13, F.regexp_replace(rewrites, r"\]$", ",null]")).otherwise(rewrites)),
        ("main_clause", F.when(d % 23 != 2, _object(("clause", _json(F.concat(F.lit(" "), text, F.lit(" "))))))),
        (
            "complement_info",
            _object(
                ("has_complements", F.when(d % 97 == 19, F.lit('"yes"')).otherwise(flag)),
                ("complements", F.when(d % 97 == 9, F.lit("null")).when(s % 3 == 0, F.lit("[]")).otherwise(F.to_json(F.slice("w", 2, 2)))),
            ),
        ),
        ("model", F.when(d % 97 == 15, F.lit('"teacher"'))),
    )
    body = _damaged(d, body, '{"translation":')
    return prepared.select(*sents.columns, body.alias("body"))


def _dealt_sentences(spark: SparkSession, folder: str, shares: int) -> DataFrame:
    return sentences(spark, folder).drop("id").repartition(shares, "paragraph_index", "sentence_index")


def response_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Responses with their sentences as streams get them, in even shares: a stream reads each file in one task."""
    return with_teacher_bodies(_dealt_sentences(spark, folder, 2 * spark.sparkContext.defaultParallelism))


def teacher_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences are dealt out by key before bodies, many times their size, are made of them: a long document is
    many tasks' work, and a join by the same keys need not move what is made of the bodies. Shares grow in number
    with the documents, so that what a task sorts for the join fits its memory."""
    fewest = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    shares = max(fewest, input_bytes(table(spark, folder, "documents")) // SHARE_BYTES)
    return with_teacher_bodies(_dealt_sentences(spark, folder, shares)).select("paragraph_index", "sentence_index", "body")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "conversations"), "conv_id", "turn")


def tool_turns(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations; in every fourth, turns 2 and 3 are tool answers and early assistant turns
    call tools, some without content of their own."""
    turns = conversations(spark, folder)
    with_tools = F.col("conv_id") % 4 == 0
    early = with_tools & (F.col("turn") < 2) & (F.col("role") == "assistant")
    first = F.struct(F.lit("lookup").alias("name"), F.concat(F.lit('{"turn": '), "turn", F.lit("}")).alias("arguments"))
    second = F.struct(F.lit("count").alias("name"), F.lit("{}").alias("arguments"))
    calls = F.when(early & (F.col("conv_id") % 8 == 0), F.array(first, second)).when(early, F.array(first))
    return turns.select(
        "conv_id",
        "turn",
        F.when(with_tools & F.col("turn").isin(2, 3), "tool").otherwise(F.col("role")).alias("role"),
        F.when(early & (F.col("conv_id") % 16 == 0), "").otherwise(F.col("text")).alias("text"),
        calls.alias("tool_calls"),
    )


def tool_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The same turns with their calls as JSON texts in four forms: arguments as an object or as a text, plain
    or below ``function``. Arguments of objects hold the whole text of the turn and nested lists."""
    said = conversations(spark, folder).select("conv_id", "turn", F.substring(F.to_json(F.array("text")), 2, 2**31 - 1).alias("_said"))
    turns = tool_turns(spark, folder).join(said.hint("merge"), ["conv_id", "turn"])
    inside = F.concat(
        F.lit('{"turn":  '), "turn", F.lit(' , "said":'), F.substring("_said", F.lit(1), F.length("_said") - 1), F.lit(',"path": ["a, b",{"k: x":[ ]}]\n}')
    )
    text = F.to_json(F.struct(F.get("tool_calls", 0)["name"].alias("name"), F.get("tool_calls", 0)["arguments"].alias("arguments")))
    form = F.floor(F.col("conv_id") / 4) % 4
    first = (
        F.when(form == 0, F.concat(F.lit('{"type":"function","function": {"name":"lookup", "arguments":'), inside, F.lit("} }")))
        .when(form == 1, F.concat(F.lit('{"arguments": '), inside, F.lit(',"name":"lookup"}')))
        .when(form == 2, F.concat(F.lit('{"function":'), text, F.lit("}")))
        .otherwise(F.concat(F.lit('{"function": {},'), F.substring(text, F.lit(2), F.length(text))))
    )
    second = F.lit('{"name": "count", "arguments": { }}')
    calls = F.when(F.size("tool_calls") == 2, F.array(first, second)).when(F.size("tool_calls") == 1, F.array(first))
    return turns.withColumn("tool_calls", calls).drop("_said")


def item_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn as a prompt, with the assistant turn right after it as target; null if there
    is none. The join key is unique on both sides, so a long conversation is no hot key."""
    turns = conversations(spark, folder)
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")
    )
    names = F.array(*[F.lit(n) for n in TASK_CYCLE])
    n = F.col("conv_id") * 100 + F.col("turn")
    return asked.join(answered.hint("merge"), ["conv_id", "turn"], "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        "conv_id",
        "turn",
        n.alias("n"),
        F.get(names, (n % len(TASK_CYCLE)).cast("int")).alias("task"),
        "prompt",
        "target",
    )


def chat_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All prompts with their answers; a prompt without one has an empty answer."""
    return item_pairs(spark, folder).select("id", "prompt", F.coalesce("target", F.lit("")).alias("target"))


TASK_CYCLE = ("translate_idiomatic", "morphosyntax", "transform", "contrast_judge", "translate", "main_clause")


def item_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Items as JSON lines, damaged in five ways by number; unanswered prompts lack a target."""
    kind = F.col("n") % 23
    whole = F.struct(F.concat(F.lit("i"), "id").alias("id"), "task", "prompt", "target")
    value = (
        F.when(kind == 0, "   ")
        .when(kind == 1, F.to_json(F.struct("id", "task", "prompt")))
        .when(kind == 2, F.concat(F.lit('{"task": "'), "task", F.lit('", "prompt": null, "target": "t"}')))
        .when(kind == 3, F.to_json(F.struct("task", F.col("n").alias("prompt"), "target")))
        .when(kind == 4, F.to_json(F.struct("id", "task", "prompt", F.lit("   ").alias("target"))))
        .when(kind == 5, F.concat(F.lit('{"id": 1, "prompt": "'), "task"))
        .otherwise(F.to_json(whole))
    )
    return item_pairs(spark, folder).select(
        F.lit("items.jsonl").alias("file"),
        F.floor(F.col("conv_id") / CHUNK_DOCUMENTS).cast("long").alias("chunk"),
        F.struct("conv_id", "turn").alias("pos"),
        value.alias("value"),
    )


def split_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "lang")
    return docs.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))


def exam(spark: SparkSession, folder: str) -> DataFrame:
    """Two exams: every document and every benchmark passage as a question on the whole text. Its first
    words are the options, four unless the text is shorter."""
    docs = documents(spark, folder).select(
        F.lit("corpus").alias("exam_name"), F.concat(F.lit("d"), "doc_id").alias("id"), F.col("doc_id").alias("n"), "text"
    )
    items = table(spark, folder, "benchmark").select(
        F.lit("items").alias("exam_name"), F.concat(F.lit("b"), "item_id").alias("id"), F.col("item_id").alias("n"), "text"
    )
    texts = docs.unionByName(items).withColumn("text", F.coalesce("text", F.lit("")))
    both = compute_once(texts, "w", F.slice(words(F.col("text")), 1, 4))
    options = F.map_from_arrays(F.slice(F.array(*[F.lit(x) for x in "abcd"]), F.lit(1), F.size("w")), F.col("w"))
    return both.select(
        "exam_name",
        "id",
        F.col("text").alias("question"),
        options.alias("options"),
        F.substring(F.lit("abcd"), (F.col("n") % 4 + 1).cast("int"), F.lit(1)).alias("correct_answer"),
    )


def exam_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of ``exam`` dealt out to exams of at most ``CHUNK_DOCUMENTS`` questions."""
    part = F.floor(F.substring("id", 2, 20).cast("long") / CHUNK_DOCUMENTS)
    return exam(spark, folder).withColumn("part", part).withColumn("exam_name", F.concat("exam_name", F.lit("-"), F.col("part").cast("string")))


def exam_bodies(parts: DataFrame) -> DataFrame:
    """Each exam as the text of a JSON array file: (exam, value)."""
    asked = F.to_json(F.struct("id", "question", "options", "correct_answer"))
    listed = parts.groupBy(F.col("exam_name").alias("exam")).agg(F.sort_array(F.collect_list(F.struct("id", asked.alias("q")))).alias("l"))
    return listed.select("exam", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["q"]), ",\n"), F.lit("]")).alias("value"))


def config_bodies(parts: DataFrame) -> DataFrame:
    """Configurations of 64 exams each as file texts. Every seventh exam names a preprompt that is not there, and
    every configuration an exam that is not."""
    kind = F.substring_index("exam_name", "-", 1)
    entry = F.struct(
        F.concat(F.lit("exams/"), "exam_name", F.lit(".json")).alias("exam_path"),
        F.concat(F.lit("texts/"), F.when(F.col("part") % 7 == 1, "absent").otherwise(kind), F.lit(".v1.txt")).alias("preprompt_file"),
        F.when(kind == "corpus", 20).otherwise(50).alias("max_new_tokens"),
        F.when(kind == "corpus", 0.0).otherwise(0.2).alias("temperature"),
    )
    listed = parts.select("exam_name", "part").distinct().groupBy(kind.alias("kind"), F.floor(F.col("part") / 64).alias("n")).agg(F.collect_list(entry).alias("e"))
    gone = F.struct(
        F.concat(F.lit("exams/gone-"), "kind", F.lit("-"), F.col("n").cast("string"), F.lit(".json")).alias("exam_path"),
        F.lit("texts/corpus.v1.txt").alias("preprompt_file"), F.lit(20).alias("max_new_tokens"), F.lit(0.0).alias("temperature"),
    )
    return listed.select(F.to_json(F.struct(F.concat("e", F.array(gone)).alias("benchmarks"))).alias("value"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One model run per document source; some have no parameters in their name, some crashed."""
    found = documents(spark, folder).select("source").distinct()
    k = F.substring("source", 4, 20).cast("long")
    name = F.concat(
        F.lit("grid_sweep_lr"),
        F.when(k % 2 == 0, "1e-05").otherwise("5e-06"),
        F.lit("_bs"),
        (F.floor(k / 2) % 2 + 1).cast("string"),
        F.lit("_ep"),
        (F.floor(k / 4) % 2 + 1).cast("string"),
        F.lit("_"),
        "source",
    )
    return found.select(
        F.when(k % 5 == 4, F.concat(F.lit("old_sweep_"), "source")).otherwise(name).alias("run"),
        (k % 10 == 3).alias("crashed"),
    )


def eval_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run is set up for both exams, each with its own preprompt and limits."""
    both = F.array(
        F.struct(F.lit("corpus").alias("exam_name"), F.lit(" Answer with one letter. ").alias("preprompt"),
                 F.lit(20).cast("long").alias("max_new_tokens"), F.lit(0.0).alias("temperature")),
        F.struct(F.lit("items").alias("exam_name"), F.lit("Choose. ").alias("preprompt"),
                 F.lit(50).cast("long").alias("max_new_tokens"), F.lit(0.2).alias("temperature")),
    )
    return runs(spark, folder).select("run", "crashed", F.explode(both).alias("c")).select(
        "run", "crashed", "c.*"
    )


def _letter(seed: Column, choices: list[str | None]) -> Column:
    """One of ``choices`` by the first two hex digits of an md5."""
    code = F.conv(F.substring(F.md5(seed), 1, 2), 16, 10).cast("int") % len(choices)
    return F.get(F.array(*[F.lit(c) for c in choices]), code)


ANSWERS: list[str | None] = ["a", "b", "c", "d", "A", "?", " "]
VERDICTS: list[str | None] = [" B ", "e", "a", "?", None, "c", "D\n"]


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of all runs to all questions; crashed runs gave none."""
    asked = eval_requests(
        exam_prompts(exam(spark, folder)), eval_configs(spark, folder).filter(~F.col("crashed"))
    ).select("run", "exam_name", "id")
    raw = F.concat(_letter(F.concat_ws("|", "run", "id"), ANSWERS), F.lit(" rest "))
    return asked.withColumn("raw", raw)


def partial_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The same, but every fifth run left some questions of its exams unanswered, and one exam whole."""
    weak = F.regexp_extract("run", r"src(\d+)$", 1).cast("long") % 5 == 1
    lost = (F.col("exam_name") == "items") | F.col("id").endswith("7")
    return predictions(spark, folder).filter(~(weak & lost))


def crashes(spark: SparkSession, folder: str) -> DataFrame:
    """Error texts of the crashed runs, and one of a run that failed in a single exam."""
    k = F.regexp_extract("run", r"src(\d+)$", 1).cast("long")
    failed = runs(spark, folder).filter(F.col("crashed") | (k == 1))
    return failed.select(
        "run",
        F.when(~F.col("crashed"), "items").alias("exam_name"),
        F.when(F.col("crashed"), "load").otherwise("answer").alias("stage"),
        F.concat(F.when(F.col("crashed"), F.lit("out of memory: ")).otherwise(F.lit("timed out: ")), "run").alias("error"),
    )


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Judge answers for the predictions; some calls failed."""
    seed = F.concat_ws("|", F.lit("judge"), "run", "id")
    return predictions(spark, folder).withColumn("raw", _letter(seed, VERDICTS))


def artifact_paths(spark: SparkSession, folder: str) -> DataFrame:
    k = F.substring("source", 4, 20).cast("long")
    run = F.when(k % 10 >= 7, F.concat(F.lit("plain_"), "source")).otherwise(
        F.concat(F.lit("grid_sweep_lr1e-05_bs1_ep1_"), "source")
    )
    final = (k % 3 == 0) & (F.col("doc_id") % 25 == k % 25)
    name = F.when(final, "final_model").otherwise(F.concat(F.lit("checkpoint-"), (F.col("doc_id") * 40).cast("string")))
    return documents(spark, folder).select(
        F.concat(F.lit(f"{SWEEP_ROOT}/"), run, F.lit("/"), name, F.lit("/model.safetensors")).alias("path")
    )


def training_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as training logs: one run per user, in time order."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("run"),
        "ts",
        "event_id",
        (F.col("event_id") * 20).alias("step"),
        F.when(kind.isin("view", "click", "purchase"), F.col("value")).alias("loss"),
        F.when(kind.isin("signup", "purchase"), F.col("value")).alias("eval_loss"),
    )


LOG_RUNS = 40
LOG_RECORDS = 65_536


def training_log_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the texts of log files, of at most ``LOG_RECORDS`` records each. The keys of records vary: some have no step, some
    losses are whole numbers, some evaluations have a set of their own, and there are texts and nested objects."""
    kind, i = F.col("event_type"), F.col("event_id")
    train, held = kind.isin("view", "click", "purchase"), (kind == "signup") & (i % 5 == 0)
    record = F.to_json(
        F.struct(
            F.when(i % 13 != 0, i * 20).alias("step"),
            F.when(train & (i % 7 != 0), F.col("value")).alias("loss"),
            F.when(kind.isin("signup", "purchase") & ~held, F.col("value")).alias("eval_loss"),
            F.when(held, F.col("value")).alias("eval_held_loss"),
            (i / 1000).alias("epoch"),
            kind.alias("note"),
            F.struct(F.col("value").alias("norm")).alias("grad"),
        )
    )
    whole = F.concat(F.lit('{"loss": '), F.floor("value").cast("string"), F.lit(", "), F.substring(record, F.lit(2), F.length(record)))
    log = F.concat(F.lit("u"), (F.col("user_id") % LOG_RUNS).cast("string"), F.lit("-"), F.floor(i / LOG_RECORDS).cast("string"))
    records = table(spark, folder, "events").select(log.alias("log"), "ts", "event_id", F.when(train & (i % 7 == 0), whole).otherwise(record).alias("record"))
    listed = records.groupBy("log").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "record"))).alias("r"))
    history = F.array_join(F.transform("r", lambda r: r["record"]), ",\n")
    return listed.select("log", F.concat(F.lit('{"epoch": 1.0, "log_history": ['), history, F.lit("]}")).alias("value"))
