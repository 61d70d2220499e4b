"""Request texts sent to the outside teacher and judge models.

They must equal the established wording so that old and new requests get comparable responses.
"""

SEGMENT_SYSTEM = (
    "You are a Latin philologist and text segmenter. "
    "Return ONLY a valid JSON object conforming to the provided schema. "
    "Do not translate or explain. No commentary."
)

SEGMENT_USER = """\
Segment the following Latin paragraph into sentences and lightly normalize orthography.

Normalization policy:
- Replace 'u' with 'v' in Latin words where appropriate (e.g., 'diuisio'→'divisio').
- Keep i/j as-is.
- Preserve all content; do NOT introduce new words.
- Wrap any Greek or clearly non-Latin spans with <GRC>…</GRC> (copy characters unchanged).
- Keep punctuation minimal and standardize to modern dots/commas if needed.

Return fields:
- orthography_policy: exactly "u->v; keep i/j"
- normalized_paragraph: the whole paragraph after the light normalization
- sentences: array of sentence strings (use the normalized text)
- foreign_spans: array of objects {lang, text} for each non-Latin span (e.g., lang='grc')

Paragraph (verbatim):
<<<
{paragraph}
>>>
"""

TEACH_SYSTEM = (
    "You are a Classical Latin expert for translation and morpho-syntax. "
    "Produce STRICT JSON matching the schema. No explanations beyond short labels. "
    "Do NOT include chain-of-thought."
)

TEACH_USER = """\
For the Latin sentence below, produce a compact teacher pack with:
- translation: literal_en and idiomatic_en (idiomatic should read as natural, fluent English)
- morphosyntax: UD-style tokens (form, lemma, upos, feats, head, deprel). Head is 1-based; 0 for root.
- transforms: 1–3 varied rewrites with increased diversity. Include when applicable:
  * Voice transformations (Active↔Passive)
  * Number transformations (Singular↔Plural)
  * Tense transformations (Past↔Future, where grammatically possible)
  * Clause simplifications or other syntactic rewrites
- main_clause: Identify the main clause of the sentence
- complement_info: Determine if complements are present. If yes, list them; if no, indicate none identified.

Rules:
- Keep Greek text inside <GRC>…</GRC> unchanged.
- Idiomatic translation should read as natural, fluent English.
- Morphological features use UD features (e.g., Case=Gen|Number=Sing|Gender=Neut).
- For transforms, ensure variety and only include those that are grammatically valid for the sentence.
- Keep everything concise.

Latin sentence:
<<<
{sentence}
>>>
"""

JUDGE_SYSTEM = "You are a precise answer matching assistant. Return only a single character."

JUDGE_USER = """\
You are evaluating a model's answer to a multiple-choice question.
                The model provided the following response:
                "{answer}"

                The available options are:
                {options}

                Your task is to determine which option (a, b, c, or d) the model's response best matches or refers to.
                - If the response clearly indicates or matches one of the options, return ONLY the letter (a, b, c, or d).
                - If the response doesn't match any option or is ambiguous, return ONLY "?".

                Return ONLY a single character: a, b, c, d, or ?
                Do not provide any explanation."""

TEACHER_MODEL = "gpt-4o-2024-08-06"
JUDGE_MODEL = "gpt-4o-mini"
ORTHOGRAPHY_POLICY = "u->v; keep i/j"

# Item wording and names.
TRANSLATE_PROMPT = "Task: Translate the Latin sentence into idiomatic English. Latin: {sentence}"
MORPH_PROMPT = (
    "Task: For each token, output FORM<TAB>LEMMA<TAB>UPOS<TAB>FEATS<TAB>HEAD<TAB>DEPREL "
    "for the sentence. Latin: {sentence}"
)
TRANSFORM_PROMPT = "Task: Rewrite in Latin as instructed ({type}). Input: {source}"
CLAUSE_PROMPT = 'Task: In this text "{sentence}", what is the main clause?'
COMPLEMENT_PROMPT = (
    "Task: Does this text contain any complements? If so, which ones? Latin: {sentence}"
)
COMPLEMENTS_FOUND = "Yes. Complements identified: "
COMPLEMENTS_NONE = "No complements are identified."
