"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Learning: of the labelled rows at most ``MAX_ROWS`` per class are sampled, lowest hash of the id first,
texts of at most ``MAX_CHARS`` code points. Their labels mark documents; tokens get labels from them: a
token of a toxic document is toxic if one of its features (the word, its first 3 to 7 letters) is found
in at least ``MIN_DOCS`` toxic documents and at least ``MIN_RATIO`` times as often as in clean ones. The
field (two labels, weights of hashed features, transitions) is fitted to these token labels; a logistic
curve over the sum of squared marginals and the text's length then gives the document's score,
at the rate of toxic rows among all labelled ones.

Scoring reads the whole text, and its marginals are those of the whole chain. Messages run over pieces of
``PIECE`` tokens at a time; the product of a piece's 2 x 2 transfer matrices carries them from one piece of
a text to the next, in both directions. Spans are runs of tokens whose marginal is at least one half, as
code point ranges (start, end).

Null and empty texts have no token and get the score of a text without toxic tokens. Without rows of
both classes every score is 0. Rows may repeat. The names in ``into`` must be free in the table; a clash is
an error.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, refuse_taken

MAX_ROWS = 1_200
MAX_CHARS = 100_000
MIN_DOCS, MIN_RATIO = 5, 4.0
REJECT = 0.7
BITS = 18
PIECE = 256
ROWS = 1_024  # pieces whose messages run at the same time
MAX_WORDS = 150_000
TOKEN = re.compile(r"[^\W_]+")
ROUNDS, BATCH, RATE, DECAY = 4, 256, 0.2, 1e-4
STEPS = 100  # batches at least, so that a field of few rows is fitted too


def features(word: str) -> list[int]:
    """Hashed features of a word; the first is always there."""
    low = word.lower()
    names = [f"w {low}", *(f"{n} {low[:n]}" for n in range(3, 8) if len(low) > n)]
    return [zlib.crc32(name.encode()) & ((1 << BITS) - 1) for name in names]


class Field:
    """Weights: of features (for the toxic label, the other one has zero), transitions, document curve."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.moves = np.zeros((2, 2))  # log weights of label -> next label
        self.start = 0.0
        self.curve = np.zeros(4)

    def emission(self, word: str) -> float:
        return float(self.weights[features(word)].sum())

    def messages(self, scores: np.ndarray, real: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Odds of the toxic label from the left (own score included) and from the right, column by column.

        ``scores``: rows of tokens; ``real`` is false where a row has no token. ``before``: odds from the left
        at the token before each row, nan where a text begins; ``after``: odds from the right at its last.
        """
        m = np.exp(self.moves)
        own = np.exp(np.clip(scores, -30, 30))
        left, right = np.empty_like(own), np.ones_like(own)
        odds = np.full(len(own), np.exp(self.start))
        if before is not None:
            odds = np.where(np.isnan(before), odds, (m[0, 1] + m[1, 1] * before) / (m[0, 0] + m[1, 0] * before))
        for t in range(own.shape[1]):
            if t:
                moved = (m[0, 1] + m[1, 1] * odds) / (m[0, 0] + m[1, 0] * odds)
                odds = np.where(real[:, t - 1], moved, odds)
            odds = np.where(real[:, t], odds * own[:, t], odds)
            np.clip(odds, 1e-30, 1e30, odds)
            left[:, t] = odds
        odds = np.ones(len(own)) if after is None else after
        right[:, -1:] = odds[:, None]
        for t in range(own.shape[1] - 2, -1, -1):
            ahead = odds * own[:, t + 1]
            moved = (m[1, 0] + m[1, 1] * ahead) / (m[0, 0] + m[0, 1] * ahead)
            odds = np.where(real[:, t + 1], moved, odds)
            right[:, t] = odds
        return left, right

    def transfers(self, scores: np.ndarray, real: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each row's product of transfer matrices, up to a factor; ``first``: no transition leads into the row."""
        m = np.exp(self.moves)
        own = np.exp(np.clip(scores, -30, 30))
        out = np.tile(np.eye(2), (len(own), 1, 1))
        for t in range(own.shape[1]):
            step = out @ m
            if t == 0:
                step[first] = out[first]
            step[:, :, 1] *= own[:, t, None]
            out = np.where(real[:, t, None, None], step, out)
            if t % 16 == 15:
                out /= out.max(axis=(1, 2), keepdims=True)
        return out / out.max(axis=(1, 2), keepdims=True)

    def borders(self, spans: list[tuple[int, int]], rows) -> tuple[np.ndarray, np.ndarray]:
        """``before`` and ``after`` of ``messages`` for all pieces, those of one text side by side."""
        before, after = np.full(len(spans), np.nan), np.ones(len(spans))
        texts = np.array([i for i, _ in spans])
        follows = np.append(texts[1:] == texts[:-1], False) if len(spans) else np.zeros(0, bool)
        parts = np.flatnonzero(follows | np.append(False, follows[:-1])) if len(spans) else np.zeros(0, int)
        matrices = {}
        for at in range(0, len(parts), ROWS):
            some = parts[at : at + ROWS]
            scores, real = rows(some)
            matrices.update(zip(some.tolist(), self.transfers(scores, real, np.array([spans[x][1] == 0 for x in some]))))
        carried = np.zeros(2)
        for x in parts.tolist():
            if spans[x][1] == 0:
                carried = np.array([1.0, np.exp(self.start)])
            else:
                before[x] = np.clip(carried[1] / max(carried[0], 1e-300), 1e-30, 1e30)
            carried = carried @ matrices[x]
            carried /= carried.max()
        for x in reversed(parts.tolist()):
            if follows[x]:
                carried = matrices[x + 1] @ carried
                carried /= carried.max()
                after[x] = np.clip(carried[1] / max(carried[0], 1e-300), 1e-30, 1e30)
            else:
                carried = np.ones(2)
        return before, after

    def marginals(self, lists: list[np.ndarray]) -> list[np.ndarray]:
        """For each list of emission scores, the probability of the toxic label at every token."""
        spans = [(i, at) for i, scores in enumerate(lists) for at in range(0, len(scores), PIECE)]
        out = [np.zeros(len(scores), np.float32) for scores in lists]

        def rows(chosen) -> tuple[np.ndarray, np.ndarray]:
            parts = [lists[spans[x][0]][spans[x][1] :][:PIECE] for x in chosen]
            width = max(map(len, parts))
            scores, real = np.zeros((len(parts), width)), np.zeros((len(parts), width), bool)
            for row, part in enumerate(parts):
                scores[row, : len(part)], real[row, : len(part)] = part, True
            return scores, real

        before, after = self.borders(spans, rows)
        for first in range(0, len(spans), ROWS):
            chosen = range(first, min(first + ROWS, len(spans)))
            scores, real = rows(chosen)
            left, right = self.messages(scores, real, before[chosen.start : chosen.stop], after[chosen.start : chosen.stop])
            odds = left * right
            share = odds / (1 + odds)
            for row, x in enumerate(chosen):
                i, at = spans[x]
                n = min(PIECE, len(lists[i]) - at)
                out[i][at : at + n] = share[row, :n]
        return out

    def inputs(self, found: np.ndarray) -> np.ndarray:
        """What the document curve sees of a text's marginals."""
        total = float(np.square(found).sum())  # so a long text's many small marginals weigh little
        seen = np.log1p(10 * total)
        return np.array([1.0, seen, total / np.sqrt(len(found) + 1.0), seen * np.log1p(len(found))])

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.inputs(found) @ self.curve, -30, 30))))


def _token_labels(docs: list[np.ndarray], toxic: np.ndarray, word_features: list[list[int]]) -> np.ndarray:
    """Whether each word counts as toxic where it stands in a toxic document."""
    seen = np.zeros((2, 1 << BITS))
    for words, label in zip(docs, toxic):
        if len(words):
            seen[label][np.unique(np.concatenate([word_features[w] for w in np.unique(words)]))] += 1
    rates = (seen[0] + 0.5) / max(1, (toxic == 0).sum()), seen[1] / max(1, (toxic == 1).sum())
    strong = (seen[1] >= MIN_DOCS) & (rates[1] >= MIN_RATIO * rates[0])
    return np.array([bool(strong[f].any()) for f in word_features])


def fit(texts: list[str], toxic: np.ndarray, rate: float) -> Field:
    """A field from documents and their labels; ``rate``: the share of toxic rows that scores assume."""
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w.lower(), len(vocabulary)) for w in TOKEN.findall(t)], np.int64) for t in texts]
    word_features = [features(w) for w in vocabulary]
    padded = np.full((len(word_features) + 1, max(map(len, word_features), default=1)), -1)
    for i, f in enumerate(word_features):
        padded[i, : len(f)] = f
    marked = _token_labels(docs, toxic, word_features)

    width = 64
    rows = [(words[at : at + width], marked[words[at : at + width]] & bool(label)) for words, label in zip(docs, toxic) for at in range(0, len(words), width)]
    words, labels = np.full((len(rows), width), len(word_features)), np.zeros((len(rows), width), bool)
    for i, (w, y) in enumerate(rows):
        words[i, : len(w)], labels[i, : len(w)] = w, y
    field = Field()
    # Transitions begin at the rates of the token labels, so that a word never seen is as likely toxic as they say.
    inside = words < len(word_features)
    pair = inside[:, :-1] & inside[:, 1:]
    moved = np.array([[((labels[:, :-1] == i) & (labels[:, 1:] == j) & pair).sum() + 1.0 for j in (0, 1)] for i in (0, 1)])
    field.moves = np.log(moved / moved.sum(axis=1, keepdims=True))
    field.start = float(np.log((labels[:, 0].sum() + 1.0) / ((inside[:, 0] & ~labels[:, 0]).sum() + 1.0)))
    squares, move_squares, start_square = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6), 1e-6
    order = np.random.default_rng(0)
    for _ in range(max(ROUNDS, STEPS // max(1, -(-len(rows) // BATCH)))):
        turn = order.permutation(len(rows))
        for first in range(0, len(turn), BATCH):
            at = turn[first : first + BATCH]
            w, y = words[at], labels[at]
            real = w < len(word_features)
            present, back = np.unique(w, return_inverse=True)
            known = padded[present]
            emissions = np.where(known >= 0, field.weights[known], 0).sum(axis=1)
            scores = emissions[back].reshape(w.shape) * real
            left, right = field.messages(scores, real)
            share = left * right / (1 + left * right)
            # Gradient of the log likelihood: what is labelled less what is expected.
            error = np.where(real, y - share, 0)
            word_error = np.bincount(back.ravel(), error.ravel(), len(present))
            index = known[known >= 0]
            gradient = np.bincount(index, np.broadcast_to(word_error[:, None], known.shape)[known >= 0], 1 << BITS)
            touched = np.unique(index)
            step = gradient[touched] - DECAY * len(at) * field.weights[touched]
            squares[touched] += step**2
            field.weights[touched] += (RATE * step / np.sqrt(squares[touched])).astype(np.float32)
            pair = real[:, :-1] & real[:, 1:]
            own, m = np.exp(np.clip(scores[:, 1:], -30, 30)), np.exp(field.moves)
            ahead = [np.ones_like(own), own * right[:, 1:]]
            behind = [np.ones_like(own), left[:, :-1]]
            joint = np.array([[behind[i] * m[i, j] * ahead[j] for j in (0, 1)] for i in (0, 1)])
            joint /= joint.sum(axis=(0, 1))
            move = np.array([[(((y[:, :-1] == i) & (y[:, 1:] == j) & pair).sum() - (joint[i, j] * pair).sum()) for j in (0, 1)] for i in (0, 1)])
            move_squares += move**2
            field.moves += 0.1 * move / np.sqrt(move_squares)
            first_error = error[:, 0].sum()
            start_square += first_error**2
            field.start += 0.1 * first_error / np.sqrt(start_square)

    emissions = np.array([field.weights[f].sum() for f in word_features] or [0.0])
    found = field.marginals([emissions[d] for d in docs])
    x, y = np.array([field.inputs(f) for f in found]), toxic.astype(float)
    weights = np.where(toxic == 1, rate / max(1, (toxic == 1).sum()), (1 - rate) / max(1, (toxic == 0).sum())) * len(toxic)
    for _ in range(30):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ field.curve, -30, 30)))
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        field.curve += np.linalg.solve(hessian, x.T @ (weights * (y - p)) - 0.05 * field.curve)
    return field


def learn(df: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Field | None:
    """A field from the labelled rows that are ``usable`` (a condition on the key).

    ``labels`` may repeat a key; it is toxic if any row says so. At most 2 * ``max_rows`` rows of at
    most MAX_CHARS come to the driver, where the field is fitted.
    """
    known = labels.filter(usable & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("toxic_label"))
    counts = known.agg(F.sum("toxic_label").alias("ones"), F.count(F.lit(1)).alias("n")).first()
    if not counts["n"] or not 0 < counts["ones"] < counts["n"]:
        return None
    order = [F.xxhash64(key), F.col(key)]
    sample = known.filter("toxic_label = 1").orderBy(*order).limit(max_rows).unionByName(known.filter("toxic_label = 0").orderBy(*order).limit(max_rows))
    rows = (
        df.select(F.col(key).alias("sampled"), F.col(text).alias("t"))
        .filter(F.length("t") <= MAX_CHARS)
        .join(F.broadcast(sample), F.col("sampled") == F.col(key))  # at most 2 * max_rows keys
        .dropDuplicates(["sampled"])
        .orderBy("sampled")
        .select("t", "toxic_label")
        .toPandas()
    )
    toxic = rows["toxic_label"].to_numpy(np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        return None
    return fit(rows["t"].tolist(), toxic, counts["ones"] / counts["n"])


class _Emissions(dict):
    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = self.field.emission(word)
        return value


def _spans(text: str, found: np.ndarray) -> list[dict]:
    spans: list[dict] = []
    if len(found) and found.max() >= 0.5:
        last = -2
        for i, match in enumerate(TOKEN.finditer(text)):
            if found[i] >= 0.5:
                if i == last + 1:
                    spans[-1]["end"] = match.end()
                else:
                    spans.append({"start": match.start(), "end": match.end()})
                last = i
    return spans


def score(
    df: DataFrame, field: Field | None, text: str = "text", keep: list[str] | None = None, into: tuple[str, str, str] = ("score", "predicted", "spans")
) -> DataFrame:
    """score, predicted (1 from REJECT on) and spans of each whole text, beside the columns ``keep``.

    ``into`` names the three columns.
    """
    refuse_taken(df.columns if keep is None else keep, into, text if keep is None else None)
    shared = df.sparkSession.sparkContext.broadcast(field)  # 2^BITS weights
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make():
        model = shared.value
        emissions = _Emissions(model) if model else None

        def compute(texts):
            scores, spans = [], []
            for first in range(0, len(texts), 1_000):
                part = [t or "" for t in texts[first : first + 1_000]]
                if model is None:
                    scores += [0.0] * len(part)
                    spans += [[]] * len(part)
                    continue
                found = model.marginals([np.array(list(map(emissions.__getitem__, TOKEN.findall(t))), np.float64) for t in part])
                scores += [model.score(f) for f in found]
                spans += [_spans(t, f) for t, f in zip(part, found)]
            return dict(zip(into, (pa.array(scores, pa.float64()), pa.array([int(s >= REJECT) for s in scores], pa.int32()), pa.array(spans, pairs))))

        return compute

    return map_texts(df, text, make, f"`{into[0]}` double, `{into[1]}` int, `{into[2]}` array<struct<start:bigint,end:bigint>>", keep)
