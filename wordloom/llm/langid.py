"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of ``window`` bytes (the last one padded; whole texts,
not prefixes).  Each byte is a learned vector; filters of several widths run over a window,
each filter keeps its maximum (max pooling), and a softmax layer gives the
languages' probabilities.  Narrow filters are padded with zeros to the widest, so a
batch of windows is one matrix product.  A document's probabilities are
the mean over its windows, weighted by bytes.

Training uses a bounded sample of labelled rows (``per_language`` different texts of each language,
chosen by a hash of the text; at most ``max_languages`` languages), one window of each by
the same hash.  The trained network is some thousand numbers, broadcast to the tasks.

A softmax has no answer "none of these", so a network always names a language.  A text is ``accepted`` if the network
and its byte pairs agree: its pairs (``pair_fit``) have to suit a language that the network holds possible, the one it names or
one at least ``RIVAL`` times as probable, clearly better than that language's own bytes in random order would.

Defined cases.  Null texts and texts without a letter are ``und`` with score 0.  Null labels
are not learned from.  Without any labelled text every text is ``und``.
Repeated rows are predicted alike.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import common as cm

UNKNOWN = "und"
# Classes of (lower) bytes whose pairs are counted: 0 for blanks and marks, 1 for digits, the letters a to z, bytes beyond ASCII.
KINDS = 2 + 26 + 128
KIND = np.concatenate([np.zeros(48, np.int32), np.ones(10, np.int32), np.zeros(39, np.int32), np.arange(2, 28, dtype=np.int32), np.zeros(5, np.int32), np.arange(28, KINDS, dtype=np.int32)])
MIXED = KINDS * KINDS  # stands for every pair of a word of letters and digits
PRIOR_PAIRS = 5.0  # weight of the single bytes' shares in a pair's probability
NEEDED = 0.25  # seen before MIXED was added: texts of sf0.001 to sf0.1 reach 0.33 or more, random letters and other alphabets at most -0.16, Finnish 0.03
RIVAL = 0.02  # languages of a smaller share of the named one's probability are ruled out by the network
FEW_ROWS = 30  # learned rows of a language under which its pairs are hardly known


@dataclass(frozen=True)
class NetParams:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 12           # of each width
    embedding: int = 6
    per_language: int = 1500    # bound on the labelled rows that are learned from, of each language
    max_languages: int = 200
    epochs: int = 8
    least_steps: int = 0        # more epochs if few rows would give fewer steps than this
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class ByteNet:
    """Weights; ``mask`` holds the zeros that pad narrow filters."""

    p: NetParams
    names: list[str]
    w: dict[str, np.ndarray] = field(default_factory=dict)
    fit_of: np.ndarray | None = None  # (languages, pairs), see pair_fit
    slack: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.w:
            return
        rng, p = np.random.default_rng(self.p.seed), self.p
        wide, n = max(p.widths), p.filters * len(p.widths)
        self.w = {
            "embed": rng.normal(0, 0.5, (256, p.embedding)), "conv": rng.normal(0, 1, (wide * p.embedding, n)) / np.sqrt(wide * p.embedding),
            "bias": np.zeros(n), "out": rng.normal(0, 1, (n, len(self.names))) / np.sqrt(n), "prior": np.zeros(len(self.names)),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.w["embed"][0] = 0  # padding
        self.w["conv"] *= self.mask()

    def mask(self) -> np.ndarray:
        p, wide = self.p, max(self.p.widths)
        return np.concatenate([np.repeat(np.arange(wide) < w, p.embedding)[:, None].repeat(p.filters, 1) for w in p.widths], 1).astype(np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows * places, widest * embedding) inputs of the filters."""
        wide, e = max(self.p.widths), self.p.embedding
        x = np.zeros((len(windows), windows.shape[1] + wide - 1, e), np.float32)
        x[:, : windows.shape[1]] = self.w["embed"][windows]
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (len(windows), windows.shape[1], wide * e), (s[0], s[1], s[2]))
        return view.reshape(-1, wide * e)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.empty((len(windows), self.w["conv"].shape[1]), np.float32)
        for at in range(0, len(windows), 64):
            part = windows[at: at + 64]
            pooled[at: at + 64] = (self._patches(part) @ self.w["conv"]).reshape(len(part), windows.shape[1], -1).max(1)
        return _softmax(np.maximum(pooled + self.w["bias"], 0) @ self.w["out"] + self.w["prior"])

    def fit(self, windows: np.ndarray, labels: np.ndarray) -> ByteNet:
        """Adam on cross-entropy; the gradient of a maximum goes to the place that gave it."""
        p, w, mask = self.p, self.w, self.mask()
        rng, wide, e = np.random.default_rng(p.seed), max(p.widths), p.embedding
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        batches = -(-len(windows) // p.batch)
        epochs = max(p.epochs, -(-p.least_steps // max(batches, 1)))
        step, total = 0, epochs * batches
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), p.batch):
                x, y = windows[order[at: at + p.batch]], labels[order[at: at + p.batch]]
                n = len(x)
                patches = self._patches(x).reshape(n, x.shape[1], -1)
                responses = patches @ w["conv"]
                place = responses.argmax(1)
                pooled = np.take_along_axis(responses, place[:, None], 1)[:, 0] + w["bias"]
                hidden = np.maximum(pooled, 0)
                error = _softmax(hidden @ w["out"] + w["prior"])
                error[np.arange(n), y] -= 1
                error /= n
                back = (error @ w["out"].T) * (pooled > 0)
                seen = patches[np.arange(n)[:, None], place]  # (n, filters, widest * embedding)
                to_patch = (back[:, :, None] * (w["conv"] * mask).T[None]).reshape(n, -1, wide, e)
                padded = np.zeros((n, x.shape[1] + wide - 1), np.int64)
                padded[:, : x.shape[1]] = x
                read = padded[np.arange(n)[:, None, None], place[:, :, None] + np.arange(wide)]
                embed = np.zeros_like(w["embed"])
                np.add.at(embed, read.ravel(), to_patch.reshape(-1, e))
                embed[0] = 0
                grads = {"embed": embed, "conv": np.einsum("nf,nfd->df", back, seen) * mask, "bias": back.sum(0), "out": hidden.T @ error, "prior": error.sum(0)}
                step += 1
                rate = p.rate * (1 - step / (total + 1))
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def windows_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows of whole texts, the row of each, and its number of bytes."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    count = -(-np.diff(offsets) // size)
    row = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + nth * size
    length = np.minimum(offsets[1:][row] - start, size)
    at = start[:, None] + np.arange(size)
    out = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros((len(row), size), np.uint8)
    out[np.arange(size) >= length[:, None]] = 0
    return cm.TO_LOWER[out], row, length


def _pairs(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring bytes' classes (``MIXED`` in words of letters and digits), and where they count: one of the two is of a letter."""
    kinds = KIND[np.pad(windows, ((0, 0), (0, 1)))]
    flat = kinds.ravel()
    starts = np.flatnonzero(np.diff(flat > 0, prepend=False))  # of words and of what is between them
    if len(starts):
        mixed = (np.minimum.reduceat(np.where(flat > 0, flat, KINDS), starts) == 1) & (np.maximum.reduceat(flat, starts) > 1)
        within = np.zeros(len(flat), bool)
        within[starts[0]:] = np.repeat(mixed, np.diff(starts, append=len(flat)))
        within = within.reshape(kinds.shape)
    else:
        within = np.zeros(kinds.shape, bool)
    first, second = kinds[:, :-1], kinds[:, 1:]
    pairs = np.where(within[:, :-1] | within[:, 1:], MIXED, first * KINDS + second)
    return pairs, (first > 1) | (second > 1)


def pair_fit(windows: np.ndarray, labels: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(languages, pairs) log-probabilities of a byte after another, above the mean that a text of the language needs, and each language's slack.

    The mean needed lies ``NEEDED`` of the way from what the language's own bytes reach in random order to what its learned
    rows reach (the median of the rows, each judged without its own pairs).  Words of letters and digits (blobs,
    keys) count like random order.  Rows of a language of fewer than ``FEW_ROWS`` may reach less: its slack spares them all.
    """
    out, slack = np.empty((languages, MIXED + 1), np.float32), np.zeros(languages)
    pairs, inside = _pairs(windows)
    inside &= pairs != MIXED
    for k in range(languages):
        seen = [pairs[i][inside[i]] for i in np.flatnonzero(labels == k)]
        seen = [x for x in seen if len(x)]
        count = np.bincount(np.concatenate([*seen, np.empty(0, int)]).astype(int), minlength=MIXED).astype(float)
        own = [_log_pairs(count - np.bincount(x, minlength=MIXED))[0][x].mean() for x in seen]
        log, share = _log_pairs(count)
        chance = np.outer(share, share)
        chance[:2, :2] = 0
        random = (chance.ravel() @ log) / chance.sum()
        needed = random + NEEDED * max(np.median(own) - random, 0) if own else random
        out[k, :MIXED], out[k, MIXED] = log - needed, random - needed
        if 0 < len(own) < FEW_ROWS:
            slack[k] = max(needed - min(own), 0)
    return out, slack


def _log_pairs(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each pair's second byte after its first, and the shares of single bytes."""
    table = count.reshape(KINDS, KINDS)
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * KINDS)
    return np.log((table + PRIOR_PAIRS * share) / (table.sum(1, keepdims=True) + PRIOR_PAIRS)).ravel(), share


def sampled(labelled: DataFrame, p: NetParams, text: str = "text", label: str = "lang") -> pd.DataFrame:
    """label, h, bytes: a window of at most ``per_language`` different texts of each label, those of the least hash shares."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(text).alias("h")).where("label is not null and text rlike '\\\\p{L}'")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "label").limit(p.max_languages).collect()}
    part = F.pmod("h", F.lit(1_000_000))
    share = F.lit(0)
    for name, n in counts.items():  # 1.2 times the bound, then cut to it
        share = F.when(F.col("label") == name, F.lit(int(min(1, 1.2 * p.per_language / max(n, 1)) * 1_000_000) + 1)).otherwise(share)
    size = F.octet_length("text")
    start = F.pmod(F.shiftrightunsigned("h", 24), F.greatest(size - F.lit(p.window), F.lit(0)) + 1)
    few = rows.where(part < share).select("label", "h", F.substring(F.encode("text", "UTF-8"), start.cast("int") + 1, F.lit(p.window)).alias("bytes")).distinct()
    nth = F.row_number().over(Window.partitionBy("label").orderBy(part, "h"))
    return few.withColumn("nth", nth).where(F.col("nth") <= p.per_language).drop("nth").toPandas().sort_values(["h", "label"], ignore_index=True)


def train(labelled: DataFrame, p: NetParams = NetParams(), text: str = "text", label: str = "lang") -> ByteNet | None:
    """A network from a bounded sample of the labelled rows; None if there are none."""
    sample = sampled(labelled, p, text, label)
    if sample.empty:
        return None
    names = sorted(set(sample["label"]))
    windows = np.zeros((len(sample), p.window), np.uint8)
    for i, b in enumerate(sample["bytes"]):
        windows[i, : len(b)] = cm.TO_LOWER[np.frombuffer(b, np.uint8)]
    labels = np.searchsorted(names, sample["label"])
    net = ByteNet(p, names).fit(windows, labels)
    net.fit_of, net.slack = pair_fit(windows, labels, len(names))
    return net


def labelled(net: ByteNet | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Predicted language and score of each text."""
    return _named(net, texts)[:2]


def _named(net: ByteNet | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted language and score of each text, and the probabilities of all languages."""
    letters = pc.match_substring_regex(texts, "\\p{L}").to_numpy(zero_copy_only=False)
    if net is None:
        return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros((len(texts), 0))
    windows, row, length = windows_of(texts, net.p.window)
    total = np.zeros((len(texts), len(net.names)))
    for at in range(0, len(row), 4096):
        some = slice(at, at + 4096)
        np.add.at(total, row[some], net.probabilities(windows[some]) * length[some, None])
    total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
    best = total.argmax(1)
    score = np.clip(total[np.arange(len(best)), best], 0, 1)
    return np.where(letters, np.array(net.names, object)[best], UNKNOWN), np.where(letters, score, 0.0), total


def fitting(net: ByteNet | None, texts: pa.Array, lang: np.ndarray, possible: np.ndarray | None = None) -> np.ndarray:
    """Whether each text's byte pairs suit the language it was given, or else another that is ``possible`` (texts, languages) for it; nothing suits ``und``."""
    fits = np.zeros(len(texts), bool)
    if net is None:
        return fits
    windows, row, _ = windows_of(texts, net.p.window)
    known = lang != UNKNOWN
    named = np.searchsorted(net.names, np.where(known, lang, net.names[0]).astype(str))
    for k in range(-1, 0 if possible is None else len(net.names)):  # -1: the given language
        left = np.flatnonzero((known & ~fits & (True if k < 0 else possible[:, k]))[row])
        total = np.zeros(len(texts))
        for at in range(0, len(left), 1024):
            some = left[at: at + 1024]
            of = named[row[some]] if k < 0 else np.full(len(some), k)
            pairs, inside = _pairs(windows[some])
            values = net.fit_of[of[:, None], pairs] + (net.slack[of][:, None] if k < 0 else 0)
            total += np.bincount(row[some], np.where(inside, values, 0).sum(1), len(texts))
        fits |= known & (total > 0)
    return fits


def predict(docs: DataFrame, net: ByteNet | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score -- a row per input row."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    shared, kind = docs.sparkSession.sparkContext.broadcast(net), docs.schema["id"].dataType.simpleString()

    def run(rows, texts):
        lang, score = labelled(shared.value, texts)
        return {"id": rows["id"], "lang_pred": lang, "score": score}

    return cm.map_texts(docs, run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", doc_id)


def accepted(docs: DataFrame, net: ByteNet | None, rival: float = RIVAL, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose byte pairs suit the language that the network names, or one at least ``rival`` times as probable."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(rows, texts):
        lang, score, probability = _named(shared.value, texts)
        return fitting(shared.value, texts, lang, probability >= rival * score[:, None])

    return cm.filter_texts(docs, run, text)
