"""Request tables for the outside teacher, validated responses, and the items made from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import wording
from tessella.functions.columns import compute_once
from tessella.functions.text import fill, strip
from tessella.functions.validate import FLAG, TEXT, WHOLE, Field, ListOf, Record, bare_fault, judged_body

SEGMENTATION = Record((
    Field("orthography_policy", TEXT),
    Field("normalized_paragraph", TEXT),
    Field("sentences", ListOf(TEXT)),
    Field("foreign_spans", ListOf(Record((Field("lang", TEXT), Field("text", TEXT)))), absent=True),
))
TOKEN = Record((
    Field("form", TEXT),
    Field("lemma", TEXT),
    Field("upos", TEXT),
    Field("feats", TEXT, absent=True, null=True),
    Field("head", WHOLE),
    Field("deprel", TEXT),
))
PACK = Record((
    Field("translation", Record((Field("literal_en", TEXT), Field("idiomatic_en", TEXT)))),
    Field("morphosyntax", ListOf(TOKEN)),
    Field("transforms", ListOf(Record((Field("type", TEXT), Field("source_latin", TEXT), Field("target_latin", TEXT))))),
    Field("main_clause", Record((Field("clause", TEXT),))),
    Field("complement_info", Record((Field("has_complements", FLAG), Field("complements", ListOf(TEXT), absent=True)))),
))

# Task names of the items.
TASKS = ("translate", "morphosyntax", "transform", "main_clause", "complement_identification")


def segment_requests(paragraphs: DataFrame, model: str = wording.TEACHER_MODEL) -> DataFrame:
    return paragraphs.select(
        "paragraph_index",
        F.lit(model).alias("model"),
        F.lit(wording.SEGMENT_SYSTEM).alias("system"),
        fill(wording.SEGMENT_USER, "paragraph", F.col("text")).alias("user"),
    )


def teacher_requests(sentences: DataFrame, model: str = wording.TEACHER_MODEL) -> DataFrame:
    return sentences.select(
        "paragraph_index",
        "sentence_index",
        F.lit(model).alias("model"),
        F.lit(wording.TEACH_SYSTEM).alias("system"),
        fill(wording.TEACH_USER, "sentence", F.col("sentence")).alias("user"),
    )


Wanted = Callable[[Column], Sequence[Column]]


def judge_bodies(df: DataFrame, kind: Record, wanted: Wanted | None = None) -> DataFrame:
    """Adds ``pack``, the body as its description has it, and ``fault`` (path, reason), null if there is none.
    A faulty body has no pack. ``wanted`` makes a struct of columns from a pack, which stands in its place."""
    make = (lambda pack: F.struct(*wanted(pack))) if wanted else lambda pack: pack

    def both(fault: Column, typed: Column) -> Column:
        return F.struct(F.when(fault.isNull(), make(typed)).alias("pack"), fault.alias("fault"))

    return judged_body(df, "body", kind, both, "_judged").select(*[c for c in df.columns if c != "body"], "_judged.*")


def _judged(
    requests: DataFrame, responses: DataFrame, keys: Sequence[str], kind: Record, wanted: Wanted | None = None
) -> tuple[DataFrame, DataFrame]:
    # Bodies are judged where they are read, as they are many times the size of the requests. Only what a
    # caller uses of the sound ones, or the faults, meets the requests.
    # Both sides grow with the corpus. Without the hint a small-looking estimate for the response
    # side (it is unnested text) could make the optimizer broadcast all packs.
    judged = judge_bodies(responses, kind, wanted)
    sound = judged.filter(F.col("fault").isNull()).select(*keys, "pack" if wanted is None else "pack.*")
    good = requests.join(sound.hint("merge"), list(keys))
    found = judged_body(responses, "body", kind, lambda fault, _: fault, "fault")
    faults = found.select(*keys, F.lit(True).alias("_answered"), "fault")
    met = requests.select(*keys).join(faults.hint("merge"), list(keys), "left")
    fault = F.when(F.col("_answered").isNull(), bare_fault("no response")).otherwise(F.col("fault"))
    rejects = met.select(*keys, fault.alias("fault")).filter(F.col("fault").isNotNull())
    return good, rejects.select(*keys, "fault.path", "fault.reason")


def parse_segmentations(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid segments and rejects. ``requests`` needs id, paragraph_index; ``responses`` a body.

    A rejected paragraph is left out; its index stays used. ``foreign_spans`` may be missing, but not null.
    Rejects have the path of the first fault (null if there is no JSON value) and the reason.
    """
    good, rejects = _judged(requests, responses, ["paragraph_index"], SEGMENTATION)
    spans = F.coalesce("pack.foreign_spans", F.array().cast("array<struct<lang:string,text:string>>"))
    segments = good.select(
        "id",
        "paragraph_index",
        "pack.orthography_policy",
        "pack.normalized_paragraph",
        "pack.sentences",
        spans.alias("foreign_spans"),
    )
    return segments, rejects


def parse_teacher_packs(requests: DataFrame, responses: DataFrame, wanted: Wanted | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid packs and rejects, one row per sentence; a bad response costs only its sentence.

    ``wanted`` makes columns from the column ``pack``. They stand in its place and are made before the requests
    are joined: a pack is many times the size of its sentence, what is made of it often is not.
    """
    return _judged(requests, responses, ["paragraph_index", "sentence_index"], PACK, wanted)


def morph_table(tokens: Column) -> Column:
    """One line per token, tab-separated; missing features are written as an underscore."""

    def line(t: Column) -> Column:
        feats = F.when(F.coalesce(t["feats"], F.lit("")) == "", "_").otherwise(t["feats"])
        return F.concat_ws("\t", t["form"], t["lemma"], t["upos"], feats, t["head"].cast("string"), t["deprel"])

    return F.array_join(F.transform(tokens, line), "\n")


# Prompts that hold the sentence; those of the rewrites come with the pack.
SENTENCE_PROMPTS = {
    "translate": wording.TRANSLATE_PROMPT,
    "morphosyntax": wording.MORPH_PROMPT,
    "main_clause": wording.CLAUSE_PROMPT,
    "complement_identification": wording.COMPLEMENT_PROMPT,
}


def _item(suffix: Column, task: str, target: Column, prompt: Column | None = None, transform: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        suffix.alias("suffix"),
        F.lit(task).alias("task"),
        (none if prompt is None else prompt).alias("prompt"),
        target.alias("target"),
        (none if transform is None else transform).alias("transform"),
    )


def _padded(number: Column, width: int) -> Column:
    """A whole number with zeros in front; the formatter is slow, so only odd ones go to it."""
    digits = number.cast("string")
    plain = F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    return F.when(number >= 0, plain).otherwise(F.format_string(f"%0{width}d", number))


def item_parts(pack: Column, max_transforms: int = 3, tasks: Sequence[str] = TASKS) -> Column:
    """The items of a pack in a fixed order, as a list, without the prompts that hold the sentence."""
    info = pack["complement_info"]
    complements = F.when(
        info["has_complements"],
        F.concat(F.lit(wording.COMPLEMENTS_FOUND), F.coalesce(F.array_join(info["complements"], ", "), F.lit(""))),
    ).otherwise(F.lit(wording.COMPLEMENTS_NONE))

    def transform_item(t: Column, i: Column) -> Column:
        head, tail = wording.TRANSFORM_PROMPT.split("{type}")
        middle, end = tail.split("{source}")
        prompt = F.concat(F.lit(head), t["type"], F.lit(middle), t["source_latin"], F.lit(end))
        return _item(F.concat(F.lit("x."), _padded(i + 1, 2)), "transform", strip(t["target_latin"]), prompt, t["type"])

    def single(suffix: str, task: str, target: Column) -> Column:
        return F.array(_item(F.lit(suffix), task, target))

    builders = {
        "translate": lambda: single("t.translate", "translate", strip(pack["translation"]["idiomatic_en"])),
        "morphosyntax": lambda: single("a.morphosyntax", "morphosyntax", morph_table(pack["morphosyntax"])),
        "transform": lambda: F.transform(F.slice(pack["transforms"], 1, max_transforms), transform_item),
        "main_clause": lambda: single("c.main_clause", "main_clause", strip(pack["main_clause"]["clause"])),
        "complement_identification": lambda: single("c.complements", "complement_identification", complements),
    }
    return F.concat(*[builders[t]() for t in TASKS if t in tasks])


def _explode_parts(parts: DataFrame) -> DataFrame:
    paragraph, sentence = F.col("paragraph_index").cast("long"), F.col("sentence_index").cast("long")
    stem = F.concat(F.lit("p"), _padded(paragraph, 4), F.lit(".s"), _padded(sentence, 2), F.lit("."))
    exploded = parts.select("paragraph_index", "sentence_index", "sentence", stem.alias("_stem"), F.explode("_items").alias("item"))
    prompt = F.when(F.col("item.task") == "transform", F.col("item.prompt"))
    for task, template in SENTENCE_PROMPTS.items():
        prompt = prompt.when(F.col("item.task") == task, fill(template, "sentence", F.col("sentence")))
    return exploded.select(
        F.concat("_stem", F.col("item.suffix")).alias("id"),
        "item.task",
        prompt.alias("prompt"),
        "item.target",
        F.struct(F.struct("paragraph_index", "sentence_index").alias("source"), F.col("item.transform")).alias("meta"),
    )


def fan_out_items(packs: DataFrame, max_transforms: int = 3, tasks: Sequence[str] = TASKS) -> DataFrame:
    """Four to ``4 + max_transforms`` items per pack, in a fixed order. Narrow: one explode."""
    return _explode_parts(compute_once(packs, "_items", item_parts(F.col("pack"), max_transforms, tasks)))


def _parts_of(max_transforms: int, tasks: Sequence[str]) -> Wanted:
    return lambda pack: [item_parts(pack, max_transforms, tasks).alias("_items")]


def judge_items(responses: DataFrame, max_transforms: int = 3, tasks: Sequence[str] = TASKS) -> DataFrame:
    """Responses that hold their sentences, judged: the parts of their items, or their ``fault``."""
    return judge_bodies(responses, PACK, _parts_of(max_transforms, tasks))


def items_of_judged(judged: DataFrame) -> DataFrame:
    """The items of ``judge_items``, those of ``fan_out_items``."""
    sound = judged.filter(F.col("fault").isNull())
    return _explode_parts(sound.select("paragraph_index", "sentence_index", "sentence", "pack._items"))


def teacher_items(requests: DataFrame, responses: DataFrame, max_transforms: int = 3, tasks: Sequence[str] = TASKS) -> DataFrame:
    """The items of ``fan_out_items`` from requests and responses. Targets meet the sentences, not whole packs."""
    return _explode_parts(parse_teacher_packs(requests, responses, _parts_of(max_transforms, tasks))[0])


def teacher_summary(paragraphs: DataFrame, sentences: DataFrame, items: DataFrame) -> DataFrame:
    """Paragraphs taken and sentences tried (failures included), and items made, as one row."""
    names = ["paragraphs", "sentences", "items"]
    parts = [
        df.agg(F.count("*").alias("n")).select(*[(F.col("n") if n == mine else F.lit(0)).alias(n) for n in names])
        for mine, df in zip(names, [paragraphs, sentences, items], strict=True)
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.agg(*[F.sum(n).cast("long").alias(n) for n in names])
