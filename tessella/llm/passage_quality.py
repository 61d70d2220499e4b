"""Document quality by attention-based multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE`` words, all of them. A passage is encoded from its words: the mean
of embeddings of hashed words, mean character shares of the words, and how much it and its text repeat
words, through one tanh layer. Gated attention, softmax of w . (tanh(hV) * sigmoid(hU)), weighs the
passages of a text, and a logistic unit scores the weighted sum. Only documents have labels; everything is
learned from them together, by back-propagation.

Learning: of the usable labelled rows at most ``MAX_ROWS`` of either class are sampled, lowest hash of the
id first, texts of at most ``MAX_CHARS`` code points. One row in five of the sample chooses the epoch and the
scale of the scores. Scores are at the rate of good rows among all labelled ones. Ids and labels are
never part of an input.

Null and empty texts are one passage without words, scored like any other. Without rows of both classes
every score is 0.5. Rows may repeat; a key that is labelled more than once is good if no row denies it.
The new columns take the names in ``into``, which must be free; other columns are passed through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, refuse_taken

MAX_ROWS = 2_000
MAX_CHARS = 20_000
PASSAGE = 64
BITS, WIDTH, GATE = 13, 16, 8
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.01, 1e-3
GOOD = 0.7
#: Class of each byte: 0 lower, 1 upper, 2 digit, 3 end of sentence, 4 other ASCII, 5 beyond ASCII.
CLASSES = np.array([5 if b >= 128 else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 if chr(b) in ".,?" else 4 for b in range(256)])
SHARES = int(CLASSES.max()) + 1
STATS = SHARES + 3


def word_stats(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of words and their numbers: shares of byte classes, length, all capitals, no letter."""
    rows = np.fromiter((zlib.crc32(w.lower()) & ((1 << BITS) - 1) for w in words), np.int64, len(words))
    stats = np.zeros((len(words), STATS), np.float32)
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        kinds = CLASSES[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for kind in range(SHARES):
            stats[:, kind] = np.add.reduceat((kinds == kind).astype(np.float32), starts) / sizes
        stats[:, SHARES] = np.log1p(sizes) / 3
        stats[:, SHARES + 1] = (stats[:, 1] > 0) & (stats[:, 0] + stats[:, 5] == 0)
        stats[:, SHARES + 2] = stats[:, 0] + stats[:, 1] + stats[:, 5] == 0
    return rows, stats


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """How many different values each group has."""
    pairs = np.unique(group.astype(np.int64) << 32 | value)
    return np.bincount(pairs >> 32, minlength=groups)


@dataclass
class Bags:
    """The passages of some texts, those of one text side by side."""

    ids: np.ndarray  # of all words, into the different words
    rows: np.ndarray  # embedding row of each different word
    stats: np.ndarray
    starts: np.ndarray  # where a passage's words begin in ``ids``, and the end
    first: np.ndarray  # where a text's passages begin, and the end
    extra: np.ndarray  # of each passage


def bags(texts: list[str | None]) -> Bags:
    known: dict[bytes, int] = {}
    ids, sizes = [], []
    for text in texts:
        words = (text or "").encode().split()
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        sizes.append(len(words))
    rows, stats = word_stats(list(known))
    n = np.array(sizes, np.int64)
    passages = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(passages)])
    of = np.repeat(np.arange(len(texts)), passages)
    place = np.arange(first[-1]) - first[of]
    starts = np.concatenate([[0], np.cumsum(n)])[of] + PASSAGE * place
    starts = np.append(starts, n.sum())
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    lengths = np.diff(starts)
    inside = np.repeat(np.arange(len(lengths)), lengths)
    own = 1 - _distinct(inside, flat, len(lengths)) / np.maximum(1, lengths)
    whole = 1 - _distinct(of[inside], flat, len(texts)) / np.maximum(1, n)
    extra = np.stack([own, whole[of], np.log1p(lengths) / 4], axis=1).astype(np.float32)
    return Bags(flat, rows, stats, starts, first, extra)


def _means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean of the rows from each start to the next; no rows have mean 0."""
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), values.shape[1]), np.float32)
    filled = np.flatnonzero(sizes)
    if len(filled):
        out[filled] = np.add.reduceat(values, starts[filled], axis=0) / sizes[filled, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _seeded(rows: int, columns: int, scale: float, seed: int) -> np.ndarray:
    return (np.random.default_rng(seed).standard_normal((rows, columns)) * scale).astype(np.float32)


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, WIDTH), np.float32))
    stats: np.ndarray = field(default_factory=lambda: _seeded(STATS, WIDTH, 0.5, 1))
    extra: np.ndarray = field(default_factory=lambda: _seeded(3, WIDTH, 0.5, 2))
    bias: np.ndarray = field(default_factory=lambda: np.zeros((1, WIDTH), np.float32))
    look: np.ndarray = field(default_factory=lambda: _seeded(WIDTH, GATE, 0.3, 3))  # V
    gate: np.ndarray = field(default_factory=lambda: _seeded(WIDTH, GATE, 0.3, 4))  # U
    weigh: np.ndarray = field(default_factory=lambda: _seeded(GATE, 1, 0.3, 5))  # w
    out: np.ndarray = field(default_factory=lambda: _seeded(WIDTH, 1, 0.3, 6))
    base: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    scale: tuple[float, float] = (1.0, 0.0)

    DENSE = ("stats", "extra", "bias", "look", "gate", "weigh", "out", "base")

    def encode(self, bag: Bags) -> np.ndarray:
        word = self.words[bag.rows] + bag.stats @ self.stats
        return np.tanh(_means(word[bag.ids], bag.starts) + bag.extra @ self.extra + self.bias)

    def attend(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention of every passage within its text, and the two gates."""
        look, gate = np.tanh(h @ self.look), _sigmoid(h @ self.gate)
        s = ((look * gate) @ self.weigh)[:, 0]
        sizes = np.diff(first)
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first[:-1]), sizes))
        return e / np.repeat(np.add.reduceat(e, first[:-1]), sizes), look, gate

    def logits(self, bag: Bags) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, before scaling; and the attention of each passage."""
        h = self.encode(bag)
        a, _, _ = self.attend(h, bag.first)
        z = np.add.reduceat(h * a[:, None], bag.first[:-1], axis=0)
        return (z @ self.out + self.base)[:, 0], a

    def scores(self, bag: Bags) -> tuple[np.ndarray, np.ndarray]:
        logits, a = self.logits(bag)
        return _sigmoid(self.scale[0] * logits.astype(np.float64) + self.scale[1]), a


def _select(bag: Bags, texts: np.ndarray) -> Bags:
    """The bags of some texts; the table of different words is shared."""
    at = np.concatenate([np.arange(bag.first[t], bag.first[t + 1]) for t in texts])
    sizes = np.diff(bag.starts)[at]
    ids = np.concatenate([bag.ids[bag.starts[bag.first[t]] : bag.starts[bag.first[t + 1]]] for t in texts])
    passages = np.diff(bag.first)[texts]
    return Bags(ids, bag.rows, bag.stats, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(passages)]), bag.extra[at])


def gradients(model: Model, bag: Bags, good: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Of the weighted log loss: by dense parameter; and embedding rows with their gradients."""
    sizes, lengths = np.diff(bag.first), np.diff(bag.starts)
    of = np.repeat(np.arange(len(sizes)), sizes)
    h = model.encode(bag)
    a, look, gate = model.attend(h, bag.first)
    z = np.add.reduceat(h * a[:, None], bag.first[:-1], axis=0)
    error = ((_sigmoid(z @ model.out + model.base)[:, 0] - good) * weights).astype(np.float32)[:, None]
    dz = (error * model.out.T)[of]
    da = (dz * h).sum(axis=1)
    ds = a * (da - np.repeat(np.add.reduceat(a * da, bag.first[:-1]), sizes))
    through = ds[:, None] * model.weigh.T
    dlook, dgate = through * gate * (1 - look**2), through * look * gate * (1 - gate)
    dh = (a[:, None] * dz + dlook @ model.look.T + dgate @ model.gate.T) * (1 - h**2)
    means = _means(bag.stats[bag.ids], bag.starts)
    dense = {
        "stats": means.T @ dh, "extra": bag.extra.T @ dh, "bias": dh.sum(axis=0, keepdims=True),
        "look": h.T @ dlook, "gate": h.T @ dgate, "weigh": (look * gate).T @ ds[:, None],
        "out": z.T @ error, "base": error.sum(keepdims=True),
    }
    rows, back = np.unique(bag.rows[bag.ids], return_inverse=True)
    share = np.repeat(dh / np.maximum(1, lengths)[:, None], lengths, axis=0)
    words = np.stack([np.bincount(back, share[:, i], len(rows)) for i in range(WIDTH)], axis=1)
    return dense, rows, words


def _loss(logits: np.ndarray, good: np.ndarray, weights: np.ndarray) -> float:
    p = np.clip(_sigmoid(logits), 1e-6, 1 - 1e-6)
    return float(-(weights * np.where(good == 1, np.log(p), np.log(1 - p))).sum() / weights.sum())


def fit(texts: list[str], good: np.ndarray, rate: float) -> Model:
    """A model of documents and their labels; ``rate``: the share of good rows that scores assume."""
    weights = np.where(good == 1, rate / max(1, (good == 1).sum()), (1 - rate) / max(1, (good == 0).sum())) * len(good)
    bag, model = bags(texts), Model()
    check = np.arange(0, len(texts), 5) if len(texts) >= 50 else np.arange(len(texts))
    train = np.setdiff1d(np.arange(len(texts)), check) if len(texts) >= 50 else check
    order, squares = np.random.default_rng(0), np.full(1 << BITS, 1e-8)
    moments = {name: [np.zeros_like(getattr(model, name)), np.zeros_like(getattr(model, name))] for name in Model.DENSE}
    held, best, kept, step = _select(bag, check), np.inf, None, 0
    for _ in range(max(EPOCHS, 40 * BATCH // max(1, len(train)))):  # few rows take more rounds
        turn = order.permutation(train)
        for begin in range(0, len(turn), BATCH):
            part = turn[begin : begin + BATCH]
            dense, rows, words = gradients(model, _select(bag, part), good[part], weights[part] / len(part))
            step += 1
            for name, g in dense.items():
                value, (mean, square) = getattr(model, name), moments[name]
                mean += 0.1 * (g - mean)
                square += 0.001 * (g**2 - square)
                value -= RATE * ((mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            words += DECAY / len(part) * model.words[rows]
            squares[rows] += (words**2).mean(axis=1)
            model.words[rows] -= (RATE * words / np.sqrt(squares[rows])[:, None]).astype(np.float32)
        loss = _loss(model.logits(held)[0], good[check], weights[check])
        if loss < best:
            best, kept = loss, {name: getattr(model, name).copy() for name in ("words", *Model.DENSE)}
    for name, value in (kept or {}).items():
        setattr(model, name, value)
    model.scale = _scale(model.logits(held)[0].astype(np.float64), good[check], weights[check])
    return model


def _scale(logits: np.ndarray, good: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, near 1 and 0 if the rows say little; the slope is never negative."""
    x, theta, prior = np.stack([logits, np.ones(len(logits))], axis=1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(20):
        p = _sigmoid(x @ theta)
        slope = x.T @ (weights * (p - good)) + (theta - prior)
        theta -= np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.eye(2), slope)
    return max(0.0, float(theta[0])), float(theta[1])


def learn(df: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Model | None:
    """A model from the labelled rows that are ``usable`` (a condition on the key), None without both classes.

    At most 2 * ``max_rows`` texts of at most MAX_CHARS come to the driver, where the model is fitted.
    """
    known = labels.filter(usable & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("good_label"))
    counts = known.agg(F.sum("good_label").alias("ones"), F.count(F.lit(1)).alias("n")).first()
    if not counts["n"] or not 0 < counts["ones"] < counts["n"]:
        return None
    order = [F.xxhash64(key), F.col(key)]
    sample = known.filter("good_label = 1").orderBy(*order).limit(max_rows).unionByName(known.filter("good_label = 0").orderBy(*order).limit(max_rows))
    rows = (
        df.select(F.col(key).alias("sampled"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        .filter(F.length("t") <= MAX_CHARS)
        .join(F.broadcast(sample), F.col("sampled") == F.col(key))  # at most 2 * max_rows keys
        .groupBy("sampled")
        .agg(F.min("t").alias("t"), F.first("good_label").alias("good_label"))
        .orderBy(F.xxhash64("sampled"), "sampled")
        .toPandas()
    )
    good = rows["good_label"].to_numpy(np.int64)
    if not len(good) or good.min() == good.max():
        return None
    return fit(rows["t"].tolist(), good, counts["ones"] / counts["n"])


def score(
    df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, into: tuple[str, str, str, str] = ("score", "predicted", "n_passages", "top_passage")
) -> DataFrame:
    """Score, prediction (1 from GOOD on), number of passages and the one with most attention (from 0)."""
    refuse_taken(df.columns if keep is None else keep, into, text if keep is None else None)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^BITS rows of WIDTH numbers

    def make():
        held = shared.value

        def compute(texts):
            bag = bags(texts)
            scores, a = held.scores(bag) if held else (np.full(len(texts), 0.5), np.zeros(bag.first[-1]))
            top = [int(np.argmax(a[x:y])) for x, y in zip(bag.first, bag.first[1:])]
            columns = pa.array(scores, pa.float64()), pa.array((scores >= GOOD).astype(np.int32)), pa.array(np.diff(bag.first)), pa.array(top, pa.int64())
            return dict(zip(into, columns))

        return compute

    return map_texts(df, text, make, f"`{into[0]}` double, `{into[1]}` int, `{into[2]}` bigint, `{into[3]}` bigint", keep)
