"""The same results as DuckDB SQL, written on its own terms: per token, global ranks, string_agg."""

from __future__ import annotations

from tessella.functions import render, wording
from tessella.functions.text import TOKEN_PATTERN, WHITESPACE, WHITESPACE_CLASS
from tessella.operators.splits import SPLIT_PRESETS
from tessella.plans.queries import AS_OF, BLOCK_LENGTH, MODEL_LIMIT, PACK_LENGTH, TOOLS
from tessella.plans.views import ANSWERS, CHUNK_DOCUMENTS, GREEK_TAIL, LOG_RECORDS, LOG_RUNS, SWEEP_ROOT, TASK_CYCLE, VERDICTS
from tessella.sources.items import ITEM_PRESETS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(WHITESPACE)})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WHITESPACE_CLASS}]+', ' ', 'g'), ' ')"


def toks(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(TOKEN_PATTERN)}))"


def template(text: str, placeholder: str, x: str) -> str:
    return f" || {x} || ".join(q(part) for part in text.split("{" + placeholder + "}"))


def pick(seed: str, choices: list[str | None]) -> str:
    digit = "(strpos('0123456789abcdef', substr(md5({s}), {i}, 1)) - 1)"
    code = f"{digit.format(s=seed, i=1)} * 16 + {digit.format(s=seed, i=2)}"
    listed = ", ".join("NULL" if c is None else q(c) for c in choices)
    return f"([{listed}])[(({code}) % {len(choices)}) + 1]"


SQL: dict[str, str] = {}

# --- corpus lines --------------------------------------------------------------------------

LINES = """
lines AS (
  SELECT source || '.txt' AS file, doc_id, unnest(l) AS value, generate_subscripts(l, 1) AS piece FROM (
    SELECT source, doc_id, string_split(
      CASE WHEN doc_id % 7 = 3 THEN text ELSE CAST(doc_id % 40 + 1 AS VARCHAR) || '. ' || text END, chr(10)) AS l
    FROM documents))
"""
BLANK = """
blank_lines AS (
  SELECT source || '_blank.TXT' AS file, doc_id, unnest(l) AS value, generate_subscripts(l, 1) AS piece FROM (
    SELECT source, doc_id, string_split(text || chr(10) || ' ' || chr(10), chr(10)) AS l FROM documents))
"""
JSONL = """
records AS (
  SELECT source || '.jsonl' AS file, doc_id, doc_id % 5 AS kind, text,
    count(*) OVER w + coalesce(count(CASE WHEN doc_id % 5 = 4 THEN 1 END) OVER before, 0) AS line_no
  FROM documents
  WINDOW w AS (PARTITION BY source ORDER BY doc_id),
    before AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
json_records AS (
  SELECT file, line_no AS ordinal,
    CASE WHEN kind = 0 THEN 'd' || doc_id ELSE printf('rec%04d', line_no) END AS id, text
  FROM records)
"""


def numbered(lines: str, name: str, files: str = "file") -> str:
    """Numbered paragraphs by a running count of labels in file order."""
    pattern = rf"'^[{WHITESPACE_CLASS}]*(\d+)\.[{WHITESPACE_CLASS}]*(.*)$'"
    return f"""
{name}_open AS (
  SELECT {files} AS file, doc_id, piece, value, regexp_matches(value, {pattern}) AS opened FROM {lines}),
{name}_grouped AS (
  SELECT *, sum(opened::INT) OVER (PARTITION BY file ORDER BY doc_id, piece) AS g FROM {name}_open),
{name} AS (
  SELECT * FROM (
    SELECT file, g, max(CASE WHEN opened THEN CAST(regexp_extract(value, {pattern}, 1) AS BIGINT) END) AS label,
      {strip(f"string_agg(CASE WHEN opened THEN regexp_extract(value, {pattern}, 2) ELSE value END, chr(10) ORDER BY doc_id, piece)")} AS text
    FROM {name}_grouped WHERE g > 0 GROUP BY file, g) WHERE text <> '')
"""


def blanks(lines: str, name: str) -> str:
    """Blank-line paragraphs by gaps and islands."""
    return f"""
{name}_marked AS (
  SELECT file, doc_id, piece, value, {strip("value")} <> '' AS has,
    sum(CASE WHEN {strip("value")} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY doc_id, piece) AS g
  FROM {lines}),
{name} AS (
  SELECT file, row_number() OVER (PARTITION BY file ORDER BY g) AS ordinal,
    {strip("string_agg(value, chr(10) ORDER BY doc_id, piece)")} AS text
  FROM {name}_marked WHERE has GROUP BY file, g)
"""


SQL["corpus_jsonl"] = f"WITH {JSONL} SELECT file, ordinal, id, text FROM json_records"
SQL["paragraphs_numbered"] = f"""WITH {LINES}, {numbered("lines", "num")}
SELECT file, CAST(label AS VARCHAR) AS label, printf('rec%04d', label) AS id, text FROM num"""
SQL["paragraphs_blank"] = f"""WITH {BLANK}, {blanks("blank_lines", "bl")}
SELECT file, ordinal, printf('rec%04d', ordinal) AS id, text FROM bl"""
SQL["corpus_text"] = f"""WITH {LINES}, {BLANK}, {numbered("lines", "num")}, {blanks("blank_lines", "bl")}
SELECT file, printf('rec%04d', label) AS id, text FROM num
UNION ALL SELECT file, printf('rec%04d', ordinal) AS id, text FROM bl"""
SQL["corpus_mixed"] = f"""WITH {LINES}, {BLANK}, {JSONL}, {numbered("lines", "num")}, {blanks("blank_lines", "bl")}
SELECT file, printf('rec%04d', label) AS id, text FROM num
UNION ALL SELECT file, printf('rec%04d', ordinal) AS id, text FROM bl
UNION ALL SELECT file, id, text FROM json_records"""
SQL["corpus_files"] = f"""WITH {LINES}, {numbered("lines", "num", "regexp_replace(file, '.txt$', '') || '-' || (doc_id // 512)")}
SELECT file AS part, printf('rec%04d', label) AS id, text FROM num"""
SQL["line_numbers"] = f"""WITH {LINES}
SELECT file, row_number() OVER (PARTITION BY file ORDER BY doc_id, piece) AS line_no, value FROM lines"""
SQL["text_collapse"] = f"SELECT doc_id, {collapse('text')} AS text FROM documents"

# --- items ---------------------------------------------------------------------------------

PAIRS = f"""
pairs AS (
  SELECT u.conv_id || '-' || u.turn AS id, u.conv_id * 100 + u.turn AS n, u.conv_id, u.turn, u.text AS prompt, a.text AS target,
    ([{", ".join(q(t) for t in TASK_CYCLE)}])[(u.conv_id * 100 + u.turn) % {len(TASK_CYCLE)} + 1] AS task
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
answers AS (SELECT id, prompt, coalesce(target, '') AS answer FROM pairs)
"""
ITEM_LINES = f"""
{PAIRS},
numbered AS (
  SELECT *, n % 23 AS kind, row_number() OVER (ORDER BY conv_id, turn) AS line_no,
    n % 23 = 1 OR n % 23 NOT IN (0, 2, 4, 5) AND target IS NULL AS no_target FROM pairs),
valid AS (
  SELECT line_no, kind, task,
    CASE WHEN kind = 2 THEN 'None' WHEN kind = 3 THEN CAST(n AS VARCHAR) ELSE {strip("prompt")} END AS prompt,
    CASE WHEN kind = 2 THEN 't' WHEN kind = 4 THEN '' ELSE {strip("target")} END AS target,
    CASE WHEN kind IN (2, 3) THEN printf('item%06d', line_no) WHEN kind = 4 THEN id ELSE 'i' || id END AS id
  FROM numbered WHERE kind NOT IN (0, 5) AND NOT no_target)
"""


def tasks(preset: str) -> str:
    return ", ".join(q(t) for t in ITEM_PRESETS[preset][0])


SQL["sft_items_read"] = f"WITH {ITEM_LINES} SELECT prompt, target, id FROM valid WHERE prompt <> '' AND target <> ''"
SQL["sft_items_six_tasks"] = f"""WITH {ITEM_LINES}
SELECT prompt, target FROM valid WHERE prompt <> '' AND target <> '' AND task IN ({tasks("six_tasks")})"""
SQL["sft_items_three_tasks"] = f"""WITH {ITEM_LINES}
SELECT prompt, target, id FROM valid WHERE prompt <> '' AND target <> '' AND task IN ({tasks("three_tasks")})"""
SQL["sft_items_rejects"] = f"""WITH {ITEM_LINES}
SELECT line_no, CASE WHEN kind = 5 THEN 'invalid JSON' ELSE 'missing ''prompt'' or ''target'' field' END AS reason
FROM numbered WHERE kind = 5 OR no_target"""
SQL["prompt_completion"] = f"WITH {PAIRS} SELECT id, 'user=' || prompt AS prompt, 'assistant=' || answer AS completion FROM answers"
SQL["messages"] = f"WITH {PAIRS} SELECT id, 'user=' || prompt || chr(1) || 'assistant=' || answer AS messages FROM answers"
SQL["format_dispatch"] = f"""WITH {PAIRS}
SELECT id, 'messages' AS shape, 'user=' || prompt || chr(1) || 'assistant=' || answer AS content FROM answers
UNION ALL SELECT id, 'pair' AS shape, 'assistant=' || answer AS content FROM answers"""

# --- ordinals, slices and splits -----------------------------------------------------------

SQL["stable_ordinals"] = """
SELECT doc_id, o AS ordinal, printf('rec%04d', o) AS id
FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS o FROM documents)"""
SQL["take_slice"] = "SELECT doc_id, lang FROM documents WHERE doc_id < (SELECT max(doc_id) FROM documents)"
SQL["take_first"] = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20"


def split_sql(source: str, columns: str, first: float, second: float | None, name: str) -> str:
    inner = f"ceil({second}::DOUBLE * ceil({first}::DOUBLE * n))" if second is not None else "0"
    return f"""
SELECT {columns}, CASE WHEN r <= {inner} THEN 'val' WHEN r <= ceil({first}::DOUBLE * n) THEN '{name}' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || doc_id)) AS r, count(*) OVER () AS n FROM {source})"""


for preset, key in {
    "local": "split_local",
    "hub": "split_hub",
    "legacy": "split_legacy",
    "validation_only": "split_validation",
    "holdout": "split_holdout",
}.items():
    SQL[key] = split_sql("documents", "doc_id, lang", *SPLIT_PRESETS[preset])
SQL["split_exact"] = split_sql("documents", "doc_id", 0.1, None, "test")
SQL["split_sizes"] = f"""SELECT split, count(*) AS rows FROM ({split_sql("documents", "doc_id", *SPLIT_PRESETS["local"])}) GROUP BY split"""
SQL["split_resolve"] = f"""
{split_sql("(SELECT * FROM documents WHERE doc_id % 10 <> 0)", "doc_id, lang", *SPLIT_PRESETS["validation_only"])}
UNION ALL SELECT doc_id, lang, 'test' AS split FROM documents WHERE doc_id % 10 = 0"""
SQL["split_resolve_complete"] = """
SELECT doc_id, lang, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM documents"""
SQL["split_resolve_single"] = split_sql("documents", "doc_id, lang", *SPLIT_PRESETS["hub"])

# --- segments, teacher, items --------------------------------------------------------------

GREEK = r"\p{Greek}+(?:\s+\p{Greek}+)*"
PARAGRAPHS = f"""
paragraphs AS (
  SELECT doc_id + 1 AS paragraph_index, printf('rec%04d', doc_id + 1) AS id,
    CASE WHEN doc_id % 3 = 0 THEN text || {q(GREEK_TAIL)} ELSE text END AS text FROM documents)
"""
SENTENCES = rf"""
{PARAGRAPHS},
marked AS (
  SELECT *, regexp_replace(text, '({GREEK})', '<GRC>\1</GRC>', 'g') AS normalized_paragraph,
    regexp_extract_all(text, '{GREEK}') AS spans FROM paragraphs),
pieces AS (
  SELECT id, paragraph_index, {strip("piece")} AS sentence, i FROM (
    SELECT id, paragraph_index, unnest(l) AS piece, generate_subscripts(l, 1) AS i
    FROM (SELECT id, paragraph_index, regexp_extract_all(normalized_paragraph, '[^.!?]+[.!?]*') AS l FROM marked))),
sentences AS (
  SELECT id, paragraph_index, row_number() OVER (PARTITION BY paragraph_index ORDER BY i) AS sentence_index, sentence
  FROM pieces WHERE sentence <> ''),
joined AS (
  SELECT paragraph_index, count(*) AS n_sentences, string_agg(sentence, '|' ORDER BY sentence_index) AS sentences
  FROM sentences GROUP BY paragraph_index)
"""
SPANS = "array_to_string([concat('grc=', x) for x in spans], '|')"
SEGMENTS = f"""
{SENTENCES},
segments AS (
  SELECT id, paragraph_index, {q(wording.ORTHOGRAPHY_POLICY)} AS orthography_policy, normalized_paragraph,
    coalesce(n_sentences, 0) AS n_sentences, coalesce(sentences, '') AS sentences, {SPANS} AS foreign_spans
  FROM marked LEFT JOIN joined USING (paragraph_index))
"""
SQL["segments_rule"] = f"WITH {SEGMENTS} SELECT id, paragraph_index, orthography_policy, normalized_paragraph, n_sentences, sentences FROM segments"
SQL["jsonl_roundtrip"] = f"WITH {SEGMENTS} SELECT id, paragraph_index, orthography_policy, normalized_paragraph, sentences, foreign_spans FROM segments"
SQL["foreign_spans"] = f"""WITH {SENTENCES}
SELECT paragraph_index, generate_subscripts(spans, 1) AS i, 'grc' AS lang, unnest(spans) AS text FROM marked WHERE len(spans) > 0"""
SQL["sentences"] = f"WITH {SENTENCES} SELECT id, paragraph_index, sentence_index, sentence FROM sentences"
SQL["segment_requests"] = f"""WITH {PARAGRAPHS}
SELECT paragraph_index, {q(wording.TEACHER_MODEL)} AS model, {q(wording.SEGMENT_SYSTEM)} AS system,
  {template(wording.SEGMENT_USER, "paragraph", "text")} AS "user" FROM paragraphs"""
SQL["teacher_requests"] = f"""WITH {SENTENCES}
SELECT paragraph_index, sentence_index, {q(wording.TEACHER_MODEL)} AS model, {q(wording.TEACH_SYSTEM)} AS system,
  {template(wording.TEACH_USER, "sentence", "sentence")} AS "user" FROM sentences"""

def rejects(x: str, missing: str, faults: list[tuple[int, str, str]]) -> str:
    """Path and reason of the first fault, in the order of the description."""
    listed = [(f"{x} % 23 = 2", q(missing), "missing") if n == 23 else (f"{x} % 97 = {n}", path, reason) for n, path, reason in faults]
    bare = f"""WHEN {x} % 17 = 0 THEN {{cut}} WHEN {x} % 19 = 1 THEN {{none}} WHEN {x} % 97 IN (5, 7) THEN {{cut}}"""
    paths = " ".join(f"WHEN {test} THEN {path}" for test, path, _ in listed)
    reasons = " ".join(f"WHEN {test} THEN {q(reason)}" for test, _, reason in listed)
    return f"""CASE {bare.format(cut="NULL", none="NULL")} {paths} END AS path,
  CASE {bare.format(cut="'not one JSON value'", none="'no response'")} {reasons} END AS reason"""


DAMAGE = "(paragraph_index * 31 + sentence_index)"
SEGMENT_FAULTS = [
    (23, "", ""), (3, "'$.orthography_policy'", "an integer, not text"), (13, "'$.normalized_paragraph'", "an object, not text"),
    (11, "'$.sentences[1]'", "a boolean, not text"), (9, "'$.foreign_spans'", "null, not a list"),
]
PACK_FAULTS = [
    (3, "'$.translation.literal_en'", "an integer, not text"), (11, "'$.morphosyntax[0].head'", "text, not an integer"),
    (12, "'$.morphosyntax[0].head'", "a number, not an integer"), (13, "'$.transforms[' || (1 + sentence_index % 4) || ']'", "null, not an object"),
    (23, "", ""), (19, "'$.complement_info.has_complements'", "text, not a boolean"), (9, "'$.complement_info.complements'", "null, not a list"),
]
SQL["segmentations_rejects"] = f"""WITH {PARAGRAPHS}
SELECT * FROM (SELECT paragraph_index, {rejects("paragraph_index", "$.orthography_policy", SEGMENT_FAULTS)} FROM paragraphs) WHERE reason IS NOT NULL"""
SQL["teacher_packs_rejects"] = f"""WITH {SENTENCES}
SELECT * FROM (SELECT paragraph_index, sentence_index, {rejects(DAMAGE, "$.main_clause", PACK_FAULTS)} FROM sentences) WHERE reason IS NOT NULL"""
SOUND_SEGMENT = "paragraph_index % 17 <> 0 AND paragraph_index % 19 <> 1 AND paragraph_index % 23 <> 2 AND paragraph_index % 97 NOT IN (3, 5, 7, 9, 11, 13)"
SOUND_PACK = f"{DAMAGE} % 17 <> 0 AND {DAMAGE} % 19 <> 1 AND {DAMAGE} % 23 <> 2 AND {DAMAGE} % 97 NOT IN (3, 5, 7, 9, 11, 12, 13, 19)"
SQL["segmentations_parsed"] = f"""WITH {SEGMENTS}
SELECT id, paragraph_index, normalized_paragraph, sentences,
  CASE WHEN paragraph_index % 2 = 0 THEN foreign_spans ELSE '' END AS foreign_spans
FROM segments WHERE {SOUND_SEGMENT}"""
PACKS = f"""
{SENTENCES},
packs AS (
  SELECT paragraph_index AS p, sentence_index AS s, sentence, string_split({collapse("sentence")}, ' ') AS w
  FROM sentences WHERE {SOUND_PACK}),
shaped AS (
  SELECT *, CASE WHEN s % 3 = 0 THEN [] ELSE w[2:3] END AS comps,
    array_to_string([concat(w[i], chr(9), lower(w[i]), chr(9), CASE WHEN length(w[i]) > 5 THEN 'NOUN' ELSE 'X' END, chr(9),
      CASE WHEN i % 2 = 1 OR (p * 31 + s) % 97 = 17 THEN '_' ELSE 'Case=Nom' END, chr(9), CASE WHEN i = 1 THEN '0' ELSE '1' END, chr(9),
      CASE WHEN i = 1 THEN 'root' ELSE 'dep' END) for i in range(1, len(w) + 1)], chr(10)) AS morph
  FROM packs)
"""
STEM = "printf('p%04d.s%02d', p, s)"
ITEM_TAIL = "p AS paragraph_index, s AS sentence_index"
ITEM_SQL = {
    "items_translate": f"""SELECT {STEM} || '.t.translate' AS id, 'translate' AS task,
  {template(wording.TRANSLATE_PROMPT, "sentence", "sentence")} AS prompt, 'EN: ' || sentence AS target, {ITEM_TAIL}, NULL::VARCHAR AS transform FROM shaped""",
    "items_morph": f"""SELECT {STEM} || '.a.morphosyntax' AS id, 'morphosyntax' AS task,
  {template(wording.MORPH_PROMPT, "sentence", "sentence")} AS prompt, morph AS target, {ITEM_TAIL}, NULL::VARCHAR AS transform FROM shaped""",
    "items_transform": f"""SELECT {STEM} || printf('.x.%02d', i) AS id, 'transform' AS task,
  'Task: Rewrite in Latin as instructed (Swap' || i || '). Input: ' || sentence AS prompt, i || ': ' || sentence AS target, {ITEM_TAIL}, 'Swap' || i AS transform
  FROM shaped JOIN (SELECT unnest([1, 2, 3]) AS i) ON i <= 1 + s % 4""",
    "items_clause": f"""SELECT {STEM} || '.c.main_clause' AS id, 'main_clause' AS task,
  {template(wording.CLAUSE_PROMPT, "sentence", "sentence")} AS prompt, sentence AS target, {ITEM_TAIL}, NULL::VARCHAR AS transform FROM shaped""",
    "items_complements": f"""SELECT {STEM} || '.c.complements' AS id, 'complement_identification' AS task,
  {template(wording.COMPLEMENT_PROMPT, "sentence", "sentence")} AS prompt,
  CASE WHEN s % 2 = 0 THEN 'Yes. Complements identified: ' || array_to_string(comps, ', ') ELSE 'No complements are identified.' END AS target,
  {ITEM_TAIL}, NULL::VARCHAR AS transform FROM shaped""",
}
for name, sql in ITEM_SQL.items():
    SQL[name] = f"WITH {PACKS} {sql}"
ALL_ITEMS = " UNION ALL ".join(ITEM_SQL.values())
SQL["items_all"] = f"WITH {PACKS} {ALL_ITEMS}"
SQL["stream_items"] = SQL["items_all"]
SQL["morph_table"] = f'WITH {PACKS} SELECT p AS paragraph_index, s AS sentence_index, morph AS "table" FROM shaped'
SQL["teacher_packs_parsed"] = f"""WITH {PACKS}
SELECT p AS paragraph_index, s AS sentence_index, 'LIT: ' || sentence AS literal_en, len(w) AS n_tokens,
  1 + s % 4 AS n_transforms, s % 2 = 0 AS has_complements, array_to_string(comps, '|') AS complements FROM shaped"""
SQL["teacher_summary"] = f"""WITH {PACKS}
SELECT (SELECT count(*) FROM paragraphs) AS paragraphs, (SELECT count(*) FROM sentences) AS sentences,
  (SELECT count(*) FROM ({ALL_ITEMS})) AS items"""

# --- conversations -------------------------------------------------------------------------

TURNS = f"""
turns AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM (
    SELECT conv_id, turn, role, CASE WHEN role IN ('user', 'assistant') THEN {strip("text")} ELSE text END AS text
    FROM conversations)
  WHERE NOT (role = 'user' AND text = ''))
"""
HEADER = "'<|start_header_id|>' || {role} || '<|end_header_id|>' || chr(10) || chr(10)"
LLAMA_HEAD = (
    q(render.LLAMA_BOS) + " || " + HEADER.format(role="'system'") + " || "
    + q(f"{render.LLAMA_CUTOFF}Today Date: {render.LLAMA_DATE}\n\n")
)
LLAMA = f"""
{TURNS},
pieces AS (
  SELECT conv_id, 0 AS rn, false AS train, {LLAMA_HEAD} || coalesce(max(CASE WHEN rn = 1 AND role = 'system' THEN {strip("text")} END), '')
    || {q(render.LLAMA_EOT)} AS piece FROM turns GROUP BY conv_id
  UNION ALL
  SELECT conv_id, rn, role = 'assistant', {HEADER.format(role="role")} || {strip("text")} || {q(render.LLAMA_EOT)}
  FROM turns WHERE NOT (rn = 1 AND role = 'system')),
rendered AS (SELECT conv_id, string_agg(piece, '' ORDER BY rn) AS text FROM pieces GROUP BY conv_id)
"""
START, END = q(render.CHATML_START), q(render.CHATML_END + "\n")
CHATML = f"""
{TURNS},
pieces AS (
  SELECT conv_id, rn, 1 AS part, false AS train, {START} || role || chr(10) || text || {END} AS piece FROM turns WHERE role IN ('user', 'system')
  UNION ALL SELECT conv_id, rn, 1, false, {START} || 'assistant' || chr(10) FROM turns WHERE role = 'assistant'
  UNION ALL SELECT conv_id, rn, 2, true, text FROM turns WHERE role = 'assistant'
  UNION ALL SELECT conv_id, rn, 3, false, {END} FROM turns WHERE role = 'assistant'),
rendered AS (SELECT conv_id, string_agg(piece, '' ORDER BY rn, part) AS text FROM pieces GROUP BY conv_id)
"""
INST = f"""
{TURNS},
pieces AS (
  SELECT conv_id, 0 AS rn, '<s>[SYSTEM_PROMPT]' || coalesce(max(CASE WHEN rn = 1 AND role = 'system' THEN text END),
    {q(render.INST_SYSTEM.replace("{today}", AS_OF))}) || '[/SYSTEM_PROMPT]' AS piece FROM turns GROUP BY conv_id
  UNION ALL
  SELECT conv_id, rn, CASE role WHEN 'user' THEN '[INST]' || text || '[/INST]' WHEN 'assistant' THEN text || '</s>'
    ELSE '[SYSTEM_PROMPT]' || text || '[/SYSTEM_PROMPT]' END FROM turns WHERE NOT (rn = 1 AND role = 'system')),
rendered AS (SELECT conv_id, string_agg(piece, '' ORDER BY rn) AS text FROM pieces GROUP BY conv_id)
"""
FALLBACK = f"""
{TURNS},
rendered AS (
  SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY rn) AS text
  FROM turns GROUP BY conv_id)
"""
TOOL_TURNS = f"""
raw AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 AND turn IN (2, 3) THEN 'tool' ELSE role END AS role,
    conv_id % 4 = 0 AND turn < 2 AND role = 'assistant' AS calls,
    CASE WHEN conv_id % 16 = 0 AND turn < 2 AND role = 'assistant' THEN '' ELSE text END AS text
  FROM conversations),
cleaned AS (
  SELECT conv_id, turn, role, calls, CASE WHEN role IN ('user', 'assistant') THEN {strip("text")} ELSE text END AS text FROM raw),
turns AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM cleaned
  WHERE NOT (role = 'user' AND text = '') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pieces AS (
  SELECT conv_id, 0 AS rn, {START} || 'system' || chr(10) || coalesce(max(CASE WHEN rn = 1 AND role = 'system' THEN text || chr(10) || chr(10) END), '')
    || {q(render.CHATML_TOOLS_HEAD + "".join(chr(10) + t for t in TOOLS) + render.CHATML_TOOLS_TAIL)} || {END} AS piece FROM turns GROUP BY conv_id
  UNION ALL
  SELECT conv_id, rn, CASE
    WHEN role = 'tool' THEN CASE WHEN before = 'tool' THEN '' ELSE {START} || 'user' END || chr(10) || '<tool_response>' || chr(10)
      || text || chr(10) || '</tool_response>' || CASE WHEN after = 'tool' THEN '' ELSE {END} END
    WHEN role = 'assistant' THEN {START} || 'assistant' || chr(10) || text
      || CASE WHEN calls THEN CASE WHEN text <> '' THEN chr(10) ELSE '' END || '<tool_call>' || chr(10)
        || '{{"name": "lookup", "arguments": {{"turn": ' || turn || '}}}}' || chr(10) || '</tool_call>' ELSE '' END
      || CASE WHEN calls AND conv_id % 8 = 0 THEN chr(10) || '<tool_call>' || chr(10)
        || '{{"name": "count", "arguments": {{}}}}' || chr(10) || '</tool_call>' ELSE '' END || {END}
    ELSE {START} || role || chr(10) || text || {END} END
  FROM turns WHERE NOT (rn = 1 AND role = 'system')),
rendered AS (SELECT conv_id, string_agg(piece, '' ORDER BY rn) AS text FROM pieces GROUP BY conv_id)
"""
CALL = """'{"name": "lookup", "arguments": {"turn": ' || turn || '}}'"""
SPOKEN_CALL = """'{"name": "lookup", "arguments": {"turn": ' || turn || CASE WHEN conv_id // 4 % 4 < 2
  THEN ', "said": ' || CAST(to_json(said) AS VARCHAR) || ', "path": ["a, b", {"k: x": []}]' ELSE '' END || '}}'"""
assert TOOL_TURNS.count(CALL) == 1
TOOL_TEXTS = (
    TOOL_TURNS.replace(CALL, SPOKEN_CALL)
    .replace("  SELECT conv_id, turn, CASE WHEN conv_id % 4", "  SELECT conv_id, turn, text AS said, CASE WHEN conv_id % 4")
    .replace("SELECT conv_id, turn, role, calls, CASE", "SELECT conv_id, turn, said, role, calls, CASE")
)
for name, cte in {
    "render_llama": LLAMA,
    "render_chatml": CHATML,
    "render_chatml_tools": TOOL_TURNS,
    "render_chatml_calls": TOOL_TEXTS,
    "render_inst": INST,
    "render_fallback": FALLBACK,
}.items():
    SQL[name] = f"WITH {cte} SELECT conv_id, text FROM rendered"
SQL["generation_requests"] = f"WITH {LLAMA} SELECT conv_id, text || {HEADER.format(role=q('assistant'))} AS text FROM rendered"
SQL["generation_requests_chatml"] = f"WITH {CHATML} SELECT conv_id, text || {START} || 'assistant' || chr(10) AS text FROM rendered"
SQL["conversations_assembled"] = f"""WITH {TURNS}
SELECT conv_id, count(*) + 1 AS n, 'system=You are a helpful assistant.' || chr(1) || string_agg(role || '=' || text, chr(1) ORDER BY turn) AS messages
FROM turns GROUP BY conv_id"""
SQL["loss_mask"] = f"""WITH {LLAMA}
SELECT conv_id, string_agg(repeat(CASE WHEN train THEN '1' ELSE '0' END, {toks("piece")}), '' ORDER BY rn) AS mask FROM pieces GROUP BY conv_id"""
SQL["loss_mask_chatml"] = f"""WITH {CHATML}
SELECT conv_id, string_agg(repeat(CASE WHEN train THEN '1' ELSE '0' END, {toks("piece")}), '' ORDER BY rn, part) AS mask FROM pieces GROUP BY conv_id"""
SQL["loss_mask_completion"] = f"""WITH {LLAMA},
last_answer AS (SELECT conv_id, max(CASE WHEN train THEN rn END) AS answer FROM pieces GROUP BY conv_id)
SELECT conv_id, string_agg(repeat(CASE WHEN rn = answer THEN '1' ELSE '0' END, {toks("piece")}), '' ORDER BY rn) AS mask
FROM pieces JOIN last_answer USING (conv_id) GROUP BY conv_id"""
SQL["loss_mask_all"] = f"""WITH {INST}
SELECT conv_id, string_agg(repeat('1', {toks("piece")}), '' ORDER BY rn) AS mask FROM pieces GROUP BY conv_id"""
SQL["loss_mask_words"] = f"""WITH {LLAMA},
limits AS (
  SELECT conv_id, train, sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY rn) AS upto, length(piece) AS n FROM pieces WHERE piece <> ''),
parts AS (
  SELECT conv_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (
    SELECT conv_id, string_split(translate(text, {q(WHITESPACE)}, {q(" " * len(WHITESPACE))}), ' ') AS l FROM rendered)),
words AS (
  SELECT conv_id, i, word, sum(length(word) + 1) OVER (PARTITION BY conv_id ORDER BY i) - 1 AS upto FROM parts),
flags AS (
  SELECT w.conv_id, w.i, bool_or(s.train) AS train FROM words w JOIN limits s
    ON s.conv_id = w.conv_id AND s.upto - s.n < w.upto AND w.upto - length(w.word) < s.upto
  WHERE w.word <> '' GROUP BY w.conv_id, w.i)
SELECT conv_id, string_agg(CASE WHEN train THEN '1' ELSE '0' END, '' ORDER BY i) AS mask FROM flags GROUP BY conv_id"""
SQL["loss_mask_stats"] = f"""WITH {LLAMA}
SELECT sum(CASE WHEN train THEN {toks("piece")} ELSE 0 END)::BIGINT AS assistant_tokens, sum({toks("piece")})::BIGINT AS total_tokens,
  round(sum(CASE WHEN train THEN {toks("piece")} ELSE 0 END) / sum({toks("piece")}), 6) AS ratio FROM pieces"""

# --- lengths -------------------------------------------------------------------------------

COUNTS = f"""
{LLAMA},
mine AS (SELECT conv_id, sum(CASE WHEN train THEN {toks("piece")} ELSE 0 END)::BIGINT AS assistant_tokens FROM pieces GROUP BY conv_id),
counts AS (SELECT conv_id, {toks("text")}::BIGINT AS num_tokens FROM rendered)
"""
SQL["token_counts"] = f"WITH {COUNTS} SELECT conv_id, num_tokens, assistant_tokens FROM counts JOIN mine USING (conv_id)"
SQL["token_counts_fallback"] = f"WITH {FALLBACK} SELECT conv_id, {toks('text')}::BIGINT AS num_tokens FROM rendered"
SQL["token_counts_chatml"] = f"WITH {CHATML} SELECT conv_id, {toks('text')}::BIGINT AS num_tokens FROM rendered"
SQL["token_counts_words"] = f"""WITH {LLAMA}
SELECT conv_id, len(string_split({collapse("text")}, ' '))::BIGINT AS num_tokens FROM rendered"""
ITEM_CHATS = f"""
{ITEM_LINES},
chats AS (
  SELECT line_no, id, {LLAMA_HEAD} || {q(render.LLAMA_EOT)} || {HEADER.format(role=q("user"))} || prompt || {q(render.LLAMA_EOT)} AS asked,
    {HEADER.format(role=q("assistant"))} || target || {q(render.LLAMA_EOT)} AS answer
  FROM valid WHERE prompt <> '' AND target <> '')
"""
SQL["item_length_table"] = f"""WITH {ITEM_CHATS}
SELECT row_number() OVER (ORDER BY line_no) - 1 AS "index", {toks("asked || answer")}::BIGINT AS num_tokens FROM chats"""
SQL["training_rows"] = f"""WITH {ITEM_CHATS},
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || id)) AS r, count(*) OVER () AS total FROM chats)
SELECT id, CASE WHEN r <= ceil(0.5::DOUBLE * ceil(0.1::DOUBLE * total)) THEN 'val' WHEN r <= ceil(0.1::DOUBLE * total) THEN 'test' ELSE 'train' END AS split,
  asked || answer AS text, {toks("asked || answer")}::BIGINT AS n, {toks("answer")}::BIGINT AS trained FROM ranked"""
SQL["length_table"] = f"""WITH {COUNTS} SELECT row_number() OVER (ORDER BY conv_id) - 1 AS "index", num_tokens FROM counts"""
SQL["lengths_csv"] = SQL["length_table"]


def summary_sql(ctes: str, source: str) -> str:
    parts = ", ".join(
        f"round(quantile_cont(num_tokens, {p / 100}), 6) AS {name}"
        for name, p in {"p50": 50.0, "p90": 90.0, "p95": 95.0, "p99": 99.0, "p995": 99.5}.items()
    )
    return f"""{ctes} SELECT count(*) AS n, min(num_tokens) AS min_tokens, max(num_tokens) AS max_tokens,
  round(avg(num_tokens), 6) AS mean_tokens, round(stddev_pop(num_tokens), 6) AS std_tokens, {parts} FROM {source}"""


DOC_LENGTHS = f"doc_lengths AS (SELECT doc_id AS key, {toks('text')}::BIGINT AS num_tokens FROM documents)"
SQL["length_summary"] = summary_sql(f"WITH {COUNTS}", "counts")
SQL["document_length_summary"] = summary_sql(f"WITH {DOC_LENGTHS}", "doc_lengths")


def suggested(p: float, limit: int | None) -> str:
    raw = f"ceil(ceil(quantile_cont(num_tokens, {p / 100})) / 8.0) * 8"
    return f"CAST({f'least({raw}, {limit})' if limit else raw} AS BIGINT)"


SQL["suggest_length"] = f"""WITH {COUNTS}, s AS (SELECT {suggested(99.0, MODEL_LIMIT)} AS m FROM counts)
SELECT 99.0::DOUBLE AS percentile, m AS max_length, m >= {MODEL_LIMIT} AS capped, count(CASE WHEN num_tokens > m THEN 1 END) AS longer,
  round(count(CASE WHEN num_tokens > m THEN 1 END) / count(*), 6) AS truncation_rate FROM counts, s GROUP BY m"""
SQL["suggest_alternatives"] = f"WITH {COUNTS} " + " UNION ALL ".join(
    f"""SELECT {p}::DOUBLE AS percentile, m AS max_length, round(count(CASE WHEN num_tokens > m THEN 1 END) / count(*), 6) AS truncation_rate
  FROM counts, (SELECT {suggested(p, MODEL_LIMIT)} AS m FROM counts) GROUP BY m"""
    for p in (98.0, 99.0, 99.5, 99.9)
)
SQL["length_histogram"] = f"""WITH {COUNTS}, s AS (SELECT min(num_tokens) AS lo, max(num_tokens) AS hi FROM counts),
bins AS (SELECT unnest(range(50)) AS bin),
placed AS (SELECT CASE WHEN lo = hi THEN 25 ELSE least(((num_tokens - lo) * 50) // nullif(hi - lo, 0), 49) END AS bin FROM counts, s)
SELECT b.bin::BIGINT AS bin, round(CASE WHEN lo = hi THEN lo - 0.5::DOUBLE + b.bin * (1.0::DOUBLE / 50) ELSE lo + b.bin * ((hi - lo)::DOUBLE / 50) END, 6) AS bin_start,
  (SELECT count(*) FROM placed p WHERE p.bin = b.bin) AS examples FROM bins b, s"""
SQL["padding_report"] = f"""WITH {COUNTS}, s AS (SELECT {suggested(99.0, None)} AS m FROM counts)
SELECT m AS max_length, sum(num_tokens)::BIGINT AS total_tokens, sum(greatest(m - num_tokens, 0))::BIGINT AS padding_tokens,
  round(sum(greatest(m - num_tokens, 0)) / (sum(num_tokens) + sum(greatest(m - num_tokens, 0))), 6) AS padding_share FROM counts, s GROUP BY m"""

# --- blocks --------------------------------------------------------------------------------

TOKENS = f"""
tok AS (
  SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, string_split(body, ' ') AS l FROM (SELECT doc_id, {collapse("text")} AS body FROM documents) WHERE body <> ''))
"""
BLOCKS = f"""
{TOKENS},
placed AS (SELECT token, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM tok),
blocks AS (
  SELECT g // {BLOCK_LENGTH} AS block_id, string_agg(token, ' ' ORDER BY g) AS tokens, count(*) AS n
  FROM placed GROUP BY 1 HAVING count(*) = {BLOCK_LENGTH})
"""
VOCAB = f"""
{TOKENS},
vocab AS (SELECT row_number() OVER (ORDER BY token) - 1 AS id, token FROM (SELECT DISTINCT token FROM tok))
"""
SQL["token_blocks"] = f"WITH {BLOCKS} SELECT block_id, tokens FROM blocks"
SQL["token_blocks_files"] = f"""WITH {LINES},
tok AS (
  SELECT part, doc_id, piece, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (
    SELECT regexp_replace(file, '.txt$', '') || '-' || (doc_id // 512) AS part, doc_id, piece,
      string_split(body, ' ') AS l FROM (SELECT *, {collapse("value")} AS body FROM lines) WHERE body <> '')),
placed AS (SELECT token, row_number() OVER (ORDER BY part, doc_id, piece, i) - 1 AS g FROM tok)
SELECT g // {BLOCK_LENGTH} AS block_id, string_agg(token, ' ' ORDER BY g) AS tokens FROM placed GROUP BY 1 HAVING count(*) = {BLOCK_LENGTH}"""
SQL["blocks_masked"] = f"WITH {BLOCKS} SELECT block_id, n, n AS attended FROM blocks"
SQL["block_preview"] = f"""WITH {BLOCKS},
plain AS (
  SELECT block_id, array_to_string([x for x in string_split(tokens, ' ') if NOT regexp_matches(x, '^<\\|[a-z_]+\\|>$')], ' ') AS t
  FROM blocks WHERE block_id < 3)
SELECT block_id, CASE WHEN length(t) > 400 THEN rtrim(substr(t, 1, 400)) || ' …' ELSE t END AS preview FROM plain"""
SQL["vocabulary"] = f"WITH {VOCAB} SELECT id, token FROM vocab"
SQL["ids_encoded"] = f"WITH {VOCAB} SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS ids FROM tok JOIN vocab USING (token) GROUP BY doc_id"
SQL["ids_decoded"] = f"WITH {TOKENS} SELECT doc_id, string_agg(token, ' ' ORDER BY i) AS text FROM tok GROUP BY doc_id"
SQL["ids_decoded_2d"] = f"""WITH {TOKENS}
SELECT doc_id, (i - 1) // 64 AS row, string_agg(token, ' ' ORDER BY i) AS text FROM tok GROUP BY 1, 2"""
ID_BLOCKS = f"""
{VOCAB},
coded AS (SELECT token, id, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM tok JOIN vocab USING (token)),
id_blocks AS (
  SELECT g // {BLOCK_LENGTH} AS block_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY g) AS input_ids, string_agg(token, ' ' ORDER BY g) AS tokens,
    count(*) AS attended FROM coded GROUP BY 1 HAVING count(*) = {BLOCK_LENGTH})
"""
SQL["token_blocks_ids"] = f"WITH {ID_BLOCKS} SELECT block_id, input_ids, attended FROM id_blocks"
SQL["block_preview_ids"] = f"""WITH {ID_BLOCKS},
plain AS (
  SELECT block_id, input_ids, array_to_string([x for x in string_split(tokens, ' ') if NOT regexp_matches(x, '^<\\|[a-z_]+\\|>$')], ' ') AS t
  FROM id_blocks WHERE block_id < 3)
SELECT block_id, CASE WHEN length(t) > 400 THEN rtrim(substr(t, 1, 400)) || ' …' ELSE t END AS preview, input_ids AS ids FROM plain"""
PACKED = f"""
{DOC_LENGTHS},
ordered AS (
  SELECT key, least(num_tokens, {PACK_LENGTH}) AS pt, row_number() OVER (ORDER BY least(num_tokens, {PACK_LENGTH}) DESC, key) AS rn FROM doc_lengths),
packed AS (
  SELECT rn, key, pt, 0::BIGINT AS bin, pt AS used FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.rn, o.key, o.pt, CASE WHEN p.used + o.pt > {PACK_LENGTH} THEN p.bin + 1 ELSE p.bin END,
    CASE WHEN p.used + o.pt > {PACK_LENGTH} THEN o.pt ELSE p.used + o.pt END
  FROM packed p JOIN ordered o ON o.rn = p.rn + 1)
"""
SQL["packed_sequences"] = f"WITH RECURSIVE {PACKED} SELECT key, num_tokens, pt AS packed_tokens, 0::BIGINT AS shard, bin FROM packed JOIN doc_lengths USING (key)"
SQL["packing_stats"] = f"""WITH RECURSIVE {PACKED},
bins AS (SELECT bin, sum(pt) AS used FROM packed GROUP BY bin)
SELECT count(*) AS bins, (SELECT count(*) FROM packed) AS sequences, max(used)::BIGINT AS fullest_bin, sum(used)::BIGINT AS packed_tokens,
  round(sum(used) / (count(*) * {PACK_LENGTH}), 6) AS fill,
  (SELECT sum(greatest(num_tokens - {PACK_LENGTH}, 0))::BIGINT FROM doc_lengths) AS truncated_tokens FROM bins"""

# --- evaluation ----------------------------------------------------------------------------

EXAM = f"""
questions AS (
  SELECT exam_name, id, text AS question, substr('abcd', CAST(n % 4 + 1 AS INT), 1) AS correct_answer,
    [concat(substr('abcd', i, 1), ') ', w[i]) for i in range(1, least(len(w), 4) + 1)] AS opts FROM (
    SELECT *, [x for x in string_split({collapse("text")}, ' ') if x <> ''] AS w FROM (
      SELECT 'corpus' AS exam_name, 'd' || doc_id AS id, doc_id AS n, coalesce(text, '') AS text FROM documents
      UNION ALL SELECT 'items', 'b' || item_id, item_id, coalesce(text, '') FROM benchmark)))
"""
PROMPT = """chr(10) || 'Question: ' || question || chr(10)
  || coalesce(array_to_string([concat(o, chr(10)) for o in opts], ''), '') || 'Answer:'"""
RUNS = """
runs AS (
  SELECT CASE WHEN k % 5 = 4 THEN 'old_sweep_' || source ELSE 'grid_sweep_lr' || CASE WHEN k % 2 = 0 THEN '1e-05' ELSE '5e-06' END
    || '_bs' || (k // 2 % 2 + 1) || '_ep' || (k // 4 % 2 + 1) || '_' || source END AS run, k % 10 = 3 AS crashed, k
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS BIGINT) AS k FROM documents))
"""
PREDICTIONS = f"""
{EXAM}, {RUNS},
predictions AS (
  SELECT run, exam_name, id, question, opts, correct_answer, {pick("run || '|' || id", ANSWERS)} || ' rest ' AS raw,
    {pick("'judge|' || run || '|' || id", VERDICTS)} AS verdict
  FROM runs CROSS JOIN questions WHERE NOT crashed),
matched AS (
  SELECT *, {strip("raw")} AS predicted_raw,
    CASE WHEN substr({strip("raw")}, 1, 1) IN ('a', 'b', 'c', 'd') THEN substr({strip("raw")}, 1, 1) ELSE '?' END AS predicted_answer,
    CASE WHEN lower({strip("verdict")}) IN ('a', 'b', 'c', 'd', '?') THEN lower({strip("verdict")}) ELSE '?' END AS judged_answer
  FROM predictions),
accuracy AS (
  SELECT run, exam_name, count(CASE WHEN predicted_answer = correct_answer THEN 1 END) AS correct, count(*) AS total,
    count(CASE WHEN predicted_answer = correct_answer THEN 1 END) / count(*) AS accuracy
  FROM matched GROUP BY run, exam_name),
summary AS (
  SELECT runs.run, exam_name, accuracy, correct, total, total IS NOT NULL AS success,
    CASE WHEN total IS NULL THEN 'no predictions' END AS error
  FROM runs LEFT JOIN accuracy USING (run)),
params AS (
  SELECT run, regexp_extract(run, 'lr([0-9e-]+)_bs', 1)::DOUBLE AS learning_rate, regexp_extract(run, '_bs([0-9]+)_', 1)::BIGINT AS batch_size,
    regexp_extract(run, '_ep([0-9]+)', 1)::BIGINT AS epochs FROM runs WHERE run LIKE 'grid%')
"""
SQL["exam_prompts"] = f'WITH {EXAM} SELECT exam_name, id, {PROMPT} AS "user" FROM questions'
SQL["eval_requests"] = f"""WITH {EXAM}, {RUNS}
SELECT run, exam_name, id, {PROMPT} AS "user", CASE exam_name WHEN 'corpus' THEN 'Answer with one letter.' ELSE 'Choose.' END AS system,
  CASE exam_name WHEN 'corpus' THEN 20 ELSE 50 END::BIGINT AS max_new_tokens, CASE exam_name WHEN 'corpus' THEN 0.0 ELSE 0.2 END::DOUBLE AS temperature
FROM questions CROSS JOIN runs"""
EXAM_PARTS = f"""
{EXAM},
parts AS (SELECT *, CAST(substr(id, 2) AS BIGINT) // {CHUNK_DOCUMENTS} AS part, exam_name AS kind FROM questions)
"""
SQL["exam_files"] = f"""WITH {EXAM_PARTS}
SELECT kind || '-' || part AS exam_name, id, question, coalesce(array_to_string(opts, chr(10)), '') AS options, correct_answer FROM parts"""
SQL["exam_config_requests"] = f"""WITH {EXAM_PARTS}
SELECT 'local' AS run, kind || '-' || part AS exam_name, id, {PROMPT} AS "user", CASE kind WHEN 'corpus' THEN 'Answer with one letter.' ELSE 'Choose.' END AS system,
  CASE kind WHEN 'corpus' THEN 20 ELSE 50 END AS max_new_tokens, CASE kind WHEN 'corpus' THEN 0.0 ELSE 0.2 END::DOUBLE AS temperature
FROM parts WHERE part % 7 <> 1"""
SQL["exam_config_faults"] = f"""WITH {EXAM_PARTS}
SELECT DISTINCT kind || '-' || part AS exam_name, 'texts/absent.v1.txt' AS preprompt_file, 'no preprompt file, or an empty one' AS reason FROM parts WHERE part % 7 = 1
UNION ALL SELECT DISTINCT 'gone-' || kind || '-' || part // 64, 'texts/corpus.v1.txt', 'no exam file' FROM parts"""
SQL["match_first_char"] = f"WITH {PREDICTIONS} SELECT run, exam_name, id, predicted_raw, predicted_answer FROM matched"
SQL["judge_verdicts"] = f"WITH {PREDICTIONS} SELECT run, exam_name, id, predicted_raw, judged_answer AS predicted_answer FROM matched"
JUDGE = template(
    wording.JUDGE_USER.replace("{answer}", "\x02").replace("{options}", "\x03"), "none", "''"
).replace("\x02", "' || predicted_raw || '").replace(
    "\x03",
    "' || coalesce(array_to_string(opts, chr(10)), '') || '",
)
SQL["judge_requests"] = f"""WITH {PREDICTIONS}
SELECT run, exam_name, id, {q(wording.JUDGE_MODEL)} AS model, {q(wording.JUDGE_SYSTEM)} AS system, {JUDGE} AS "user" FROM matched"""
SQL["scored_rows"] = f"""WITH {PREDICTIONS}
SELECT run, exam_name, id, question, predicted_raw, predicted_answer, correct_answer AS correct, predicted_answer = correct_answer AS is_correct FROM matched"""
SQL["exam_accuracy"] = f"WITH {PREDICTIONS} SELECT run, exam_name, correct, total, round(accuracy, 6) AS accuracy FROM accuracy"
SQL["results_roundtrip"] = f"WITH {PREDICTIONS} SELECT run, exam_name, correct, total FROM accuracy"
SQL["judged_accuracy"] = f"""WITH {PREDICTIONS}
SELECT run, exam_name, count(CASE WHEN judged_answer = correct_answer THEN 1 END) AS correct, count(*) AS total,
  round(count(CASE WHEN judged_answer = correct_answer THEN 1 END) / count(*), 6) AS accuracy FROM matched GROUP BY run, exam_name"""
SQL["sweep_summary"] = f"WITH {PREDICTIONS} SELECT run, exam_name, round(accuracy, 6) AS accuracy, correct, total, success, error FROM summary"
SQL["sweep_counts"] = f"""WITH {PREDICTIONS}
SELECT count(DISTINCT run) AS total_models, count(DISTINCT CASE WHEN success THEN run END) AS successful,
  count(DISTINCT CASE WHEN NOT success THEN run END) AS failed FROM summary"""
SQL["stream_rejects"] = SQL["teacher_packs_rejects"]
SOURCE = "CAST(regexp_extract(run, 'src([0-9]+)$', 1) AS BIGINT)"
ERRORS = f"""
{PREDICTIONS},
exams AS (SELECT exam_name, count(*) AS n FROM questions GROUP BY exam_name),
setups AS (SELECT run, crashed, exam_name, n FROM runs CROSS JOIN exams),
given AS (
  SELECT run, exam_name, count(*) AS given FROM predictions
  WHERE NOT ({SOURCE} % 5 = 1 AND (exam_name = 'items' OR id LIKE '%7')) GROUP BY run, exam_name),
errors AS (
  SELECT run, exam_name, 'load' AS stage, 'out of memory: ' || run AS error FROM setups WHERE crashed
  UNION ALL SELECT run, exam_name, 'answer', 'timed out: ' || run FROM setups WHERE {SOURCE} = 1 AND NOT crashed AND exam_name = 'items'
  UNION ALL SELECT run, exam_name, 'answer', CASE WHEN given IS NULL THEN 'no answers' ELSE (n - given) || ' of ' || n || ' questions unanswered' END
  FROM setups LEFT JOIN given USING (run, exam_name)
  WHERE NOT crashed AND NOT ({SOURCE} = 1 AND exam_name = 'items') AND coalesce(given, 0) < n)
"""
SQL["sweep_errors"] = f"WITH {ERRORS} SELECT run, exam_name, stage, error FROM errors"
SQL["sweep_summary_errors"] = f"""WITH {ERRORS},
told AS (SELECT run, string_agg(DISTINCT error, '; ' ORDER BY error) AS told FROM errors GROUP BY run)
SELECT run, exam_name, round(accuracy, 6) AS accuracy, correct, total, success, CASE WHEN NOT success THEN told END AS error FROM summary LEFT JOIN told USING (run)"""
SQL["sweep_results"] = f"""WITH {PREDICTIONS},
named AS (SELECT *, CASE WHEN run LIKE 'grid%' THEN 'grid' ELSE 'old' END AS sweep FROM summary),
manifest AS (
  SELECT sweep, count(DISTINCT run) AS total_models, count(DISTINCT CASE WHEN success THEN run END) AS successful,
    count(DISTINCT CASE WHEN NOT success THEN run END) AS failed, CASE sweep WHEN 'grid' THEN 't3' ELSE 't2' END AS timestamp FROM named GROUP BY sweep)
SELECT run, exam_name, round(accuracy, 6) AS accuracy, correct, total, success, error, sweep, total_models, successful, failed, timestamp
FROM named JOIN manifest USING (sweep)"""
RANK = "row_number() OVER (ORDER BY accuracy DESC NULLS LAST, run, exam_name NULLS LAST)"
SQL["leaderboard"] = f"""WITH {PREDICTIONS}
SELECT {RANK} AS rank, run, exam_name, round(accuracy, 6) AS accuracy, correct, total, success, error FROM summary"""
SQL["leaderboard_top"] = f"""WITH {PREDICTIONS}
SELECT * FROM (SELECT {RANK} AS rank, run, exam_name, correct, total FROM summary WHERE success) WHERE rank <= 3"""
SQL["sweep_metrics"] = f"""WITH {PREDICTIONS}
SELECT round(max(accuracy), 6) AS best_accuracy, round(min(accuracy), 6) AS worst_accuracy, round(avg(accuracy), 6) AS mean_accuracy,
  count(*) AS scored FROM summary WHERE success"""
SQL["sweep_by_param"] = f"""WITH {PREDICTIONS}
SELECT learning_rate, batch_size, epochs, count(*) AS scored, round(avg(accuracy), 6) AS mean_accuracy, round(max(accuracy), 6) AS best_accuracy
FROM summary JOIN params USING (run) WHERE success GROUP BY ALL"""
SQL["run_hyperparams"] = f"WITH {PREDICTIONS} SELECT run, learning_rate, batch_size, epochs FROM params"
SQL["best_artifact"] = f"""
WITH paths AS (
  SELECT CASE WHEN k % 10 >= 7 THEN 'plain_' ELSE 'grid_sweep_lr1e-05_bs1_ep1_' END || source AS run,
    CASE WHEN k % 3 = 0 AND doc_id % 25 = k % 25 THEN NULL ELSE doc_id * 40 END AS step
  FROM (SELECT source, doc_id, CAST(substr(source, 4) AS BIGINT) AS k FROM documents))
SELECT run, CASE WHEN count(*) > count(step) THEN 'final_model' ELSE 'checkpoint-' || max(step) END AS artifact
FROM paths WHERE '{SWEEP_ROOT}/' || run LIKE '%sweep%' GROUP BY run"""

SQL["run_results"] = f"""WITH {PREDICTIONS},
artifacts AS ({SQL["best_artifact"]})
SELECT run, exam_name, run AS model, round(accuracy, 6) AS accuracy, correct, total,
  CASE exam_name WHEN 'corpus' THEN 20 ELSE 50 END::BIGINT AS max_new_tokens, CASE exam_name WHEN 'corpus' THEN 0.0 ELSE 0.2 END::DOUBLE AS temperature,
  CASE exam_name WHEN 'corpus' THEN ' Answer with one letter. ' ELSE 'Choose. ' END AS preprompt, '{SWEEP_ROOT}/' || run || '/' || artifact AS model_path,
  CASE WHEN run LIKE '%ep2%' THEN '2024-07-27T00:00:00' ELSE '2024-07-26T00:00:00' END AS benchmark_timestamp
FROM accuracy LEFT JOIN artifacts USING (run)"""

# --- training logs -------------------------------------------------------------------------

SERIES = """
log AS (
  SELECT CAST(user_id AS VARCHAR) AS run, ts, event_id, event_id * 20 AS step,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN value END AS loss,
    CASE WHEN event_type IN ('signup', 'purchase') THEN value END AS eval_loss FROM events),
series AS (
  SELECT run, 'train' AS series, ts, event_id, step, loss AS value FROM log WHERE loss IS NOT NULL
  UNION ALL SELECT run, 'eval', ts, event_id, step, eval_loss FROM log WHERE eval_loss IS NOT NULL)
"""
SQL["loss_series"] = f"WITH {SERIES} SELECT run, series, step, value FROM series"
SQL["loss_smoothed"] = f"""WITH {SERIES}
SELECT run, series, step, value, round(CASE series
  WHEN 'train' THEN avg(value) OVER (PARTITION BY run, series ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
  ELSE avg(value) OVER (PARTITION BY run, series ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 4) AS smoothed
FROM series"""
SQL["perplexity"] = f"""WITH {SERIES}
SELECT step, round(exp(eval_loss / 100), 6) AS perplexity, eval_loss * 4 > 709.782712893384 AS overflow FROM log"""
FILE_LOGS = f"""
logged AS (
  SELECT 'u' || user_id % {LOG_RUNS} || '-' || event_id // {LOG_RECORDS} AS run, ts, event_id, event_type AS kind, value,
    CASE WHEN event_id % 13 <> 0 THEN event_id * 20 END AS step, event_type = 'signup' AND event_id % 5 = 0 AS held FROM events),
records AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
    CASE WHEN kind IN ('view', 'click', 'purchase') THEN CASE WHEN event_id % 7 = 0 THEN floor(value) ELSE value END END AS loss,
    CASE WHEN kind IN ('signup', 'purchase') AND NOT held THEN value END AS eval_loss FROM logged)
"""
SQL["training_log_files"] = f"""WITH {FILE_LOGS},
series AS (
  SELECT run, 'train' AS series, pos, step, loss AS value FROM records WHERE step IS NOT NULL AND loss IS NOT NULL
  UNION ALL SELECT run, 'eval', pos, step, eval_loss FROM records WHERE step IS NOT NULL AND eval_loss IS NOT NULL)
SELECT run, series, pos, step, value, round(CASE series
  WHEN 'train' THEN avg(value) OVER (PARTITION BY run, series ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
  ELSE avg(value) OVER (PARTITION BY run, series ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 4) AS smoothed
FROM series"""
SQL["log_metrics"] = f"""WITH {FILE_LOGS},
metrics AS (
  SELECT run, 'loss' AS metric, pos, step, loss AS value, false AS is_eval FROM records
  UNION ALL SELECT run, 'eval_loss', pos, step, eval_loss, true FROM records
  UNION ALL SELECT run, 'eval_held_loss', pos, step, CASE WHEN held THEN value END, true FROM records
  UNION ALL SELECT run, 'epoch', pos, step, event_id / 1000, false FROM records)
SELECT * FROM metrics WHERE step IS NOT NULL AND value IS NOT NULL"""
SQL["stream_take_all"] = "SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0 AND text IS NOT NULL"
SQL["stream_take_counts"] = "SELECT count(*) // 2 AS taken, true AS each_known_once, true AS within FROM documents"
