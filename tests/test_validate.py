"""Strict response bodies: the walk against a plain validator, and the early acceptance against the walk."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import validate as S
from tessella.operators import teacher as T

SOUND = {
    "translation": {"literal_en": "a", "idiomatic_en": "b"},
    "morphosyntax": [{"form": "x", "lemma": "y", "upos": "X", "feats": None, "head": 0, "deprel": "root"}, {"form": "x", "lemma": "y", "upos": "X", "head": -3, "deprel": ""}],
    "transforms": [],
    "main_clause": {"clause": "c"},
    "complement_info": {"has_complements": True, "complements": ["d"]},
}


def kind_of(x):
    names = {type(None): "null", bool: "a boolean", int: "an integer", float: "a number", str: "text", list: "a list", dict: "an object"}
    return names[type(x)]


def plain(value, kind, at="$"):
    """(path, reason) of the first fault."""
    if isinstance(kind, S.Scalar):
        if kind_of(value) != kind.words:
            return at, f"{kind_of(value)}, not {kind.words}"
        return (at, f"out of the range of {kind.words}") if kind is S.WHOLE and not -(2**31) <= value < 2**31 else None
    if isinstance(kind, S.ListOf):
        if not isinstance(value, list):
            return at, f"{kind_of(value)}, not a list"
        return next((f for i, x in enumerate(value) if (f := plain(x, kind.item, f"{at}[{i}]"))), None)
    if not isinstance(value, dict):
        return at, f"{kind_of(value)}, not an object"
    for field in kind.fields:
        place = f"{at}.{field.name}"
        if field.name not in value:
            if not field.absent:
                return place, "missing"
        elif not (field.null and value[field.name] is None) and (fault := plain(value[field.name], field.kind, place)):
            return fault
    return None


def variants(value, kind):
    """The value with one thing wrong, or odd, at every place."""
    yield from (5, 1.5, True, None, "text", [], {}, [None], {"x": 1}, ["a", 1], 2**40)
    if isinstance(kind, S.ListOf) and isinstance(value, list):
        for i, x in enumerate(value):
            for other in variants(x, kind.item):
                yield [*value[:i], other, *value[i + 1 :]]
        yield [*value, None]
    if isinstance(kind, S.Record) and isinstance(value, dict):
        yield {**value, "unknown": [1, {"y": None}], "aaa": 1}
        for field in kind.fields:
            yield {k: v for k, v in value.items() if k != field.name}
            if field.name in value:
                for other in variants(value[field.name], field.kind):
                    yield {**value, field.name: other}


def judged(spark, bodies, kind):
    frame = spark.createDataFrame(list(enumerate(bodies)), "n int, body string").repartition(8)
    return {r.n: r for r in T.judge_bodies(frame, kind).collect()}


@pytest.mark.parametrize("kind", ["pack", "segment"])
def test_every_fault_has_its_path(spark, kind):
    record = {"pack": T.PACK, "segment": T.SEGMENTATION}[kind]
    sound = SOUND if kind == "pack" else {"orthography_policy": "p", "normalized_paragraph": "", "sentences": ["s", "t"], "foreign_spans": [{"lang": "grc", "text": "λ"}]}
    values = [sound, *variants(sound, record)]
    got = judged(spark, [json.dumps(v, ensure_ascii=False) for v in values], record)
    assert {n: tuple(r.fault) if r.fault else None for n, r in got.items()} == {n: plain(v, record) for n, v in enumerate(values)}
    assert got[0].fault is None and sum(r.fault is None for r in got.values()) < len(values) / 2
    # What is accepted is there in full.
    back = got[0].pack.asDict(recursive=True)
    assert back == {**sound, "morphosyntax": [{**{"feats": None}, **t} for t in SOUND["morphosyntax"]]} if kind == "pack" else back == sound


def test_bodies_that_are_not_one_json_value(spark):
    whole = json.dumps(SOUND)
    bad = [
        "", " ", "{", whole + " x", whole + whole, whole + "]", whole + "],[" + whole, whole + f',"{S.END}"]', f'{whole},"{S.END}"] junk', whole.replace('"', "'"),
        whole[:-1], whole[:-1] + ",}", whole.replace('"a"', "NaN"), whole.replace('"a"', "01"), whole.replace('"a"', '"\t"'), whole[:-1] + ',"transforms":[]}', "// c\n" + whole,
    ]
    got = judged(spark, [*bad, None, f"\n {whole}\t", "null", "[]", '"x"'], T.PACK)
    assert [tuple(got[i].fault) for i in range(len(bad))] == [(None, "not one JSON value")] * len(bad)
    rest = [tuple(got[len(bad) + i].fault) if got[len(bad) + i].fault else None for i in range(5)]
    assert rest == [(None, "no response"), None, ("$", "null, not an object"), ("$", "a list, not an object"), ("$", "text, not an object")]


def test_early_acceptance_takes_nearly_all(spark):
    """The generated pattern knows sound bodies; else every body would be walked."""
    bodies = [json.dumps(SOUND), json.dumps({**SOUND, "complement_info": {"has_complements": False}})]
    schemas = spark.createDataFrame([(b,) for b in bodies], "body string")
    schemas = S.with_body(schemas, "body", "v").select(F.schema_of_variant("v").alias("s"))
    assert schemas.filter(F.col("s").rlike(f"^{T.PACK.pattern()}$")).count() == 2


def test_a_long_body(spark):
    """Fifty thousand sentences, one of them wrong."""
    body = {"orthography_policy": "p", "normalized_paragraph": "x" * 1_000_000, "sentences": ["s"] * 50_000}
    wrong = {**body, "sentences": [*body["sentences"][:40_000], None, 7]}
    got = judged(spark, [json.dumps(body), json.dumps(wrong)], T.SEGMENTATION)
    assert got[0].fault is None and len(got[0].pack.sentences) == 50_000
    assert tuple(got[1].fault) == ("$.sentences[40000]", "null, not text")
