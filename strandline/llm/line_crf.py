"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import cut, table

#: Most labelled documents that a model is fitted on (those of smallest id hash), and most lines of all of them together.
#: Documents are whole: one that does not fit in the lines left is not in the sample.
SAMPLE, SAMPLE_LINES = 6_000, 400_000
#: A document is kept if its score reaches this.
ACCEPT = 0.7
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_SYMBOL = b"!\"#$%&*+/<=>@[\\]^_`{|}~"
_MARKS = frozenset(_SYMBOL)
_ENDS = frozenset(b".!?:;\"')")
OWN = 19


def line_features(line: bytes) -> list[float]:
    """OWN features of a line, most of them shares."""
    words = line.split()
    n, count = len(line), len(words)
    if not count:
        return [1.0] + [0.0] * (OWN - 1)
    upper = n - len(line.translate(None, _UPPER))
    lower = n - len(line.translate(None, _LOWER))
    digit = (n - len(line.translate(None, _DIGIT))) / n
    symbol = (n - len(line.translate(None, _SYMBOL))) / n
    upper_share = upper / max(1, upper + lower)
    unique = len(set(words)) / count
    repeat = sum(map(bytes.__eq__, words, words[1:])) / count
    marked = sum([w[-1] in _MARKS for w in words]) / count
    pipe = words.count(b"|") / count
    short = sum([len(w) < 4 for w in words]) / count
    size = math.log1p(n) / 8
    return [
        0.0,
        size,
        upper_share,
        digit,
        symbol,
        unique,
        repeat,
        marked,
        pipe,
        short,
        (n / count) / 10,
        float(words[-1][-1] in _ENDS),
        float(upper_share > 0.4),
        float(symbol > 0.06),
        float(marked > 0.3),
        float(repeat > 0.2),
        float(unique < 0.5),
        float(pipe > 0.15),
        float(count < 4),
    ]


def chain_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of a text's non-empty lines: bias, own, previous and next line's features, and equality."""
    lines = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    n = len(lines)
    out = np.zeros((n, 3 * OWN + 3))
    if n:
        own = np.array([line_features(x) for x in lines])
        out[:, 0] = 1
        out[:, 1 : OWN + 1] = own
        out[1:, OWN + 1 : 2 * OWN + 1] = own[:-1]
        out[:-1, 2 * OWN + 1 : 3 * OWN + 1] = own[1:]
        same = np.array([a == b for a, b in zip(lines, lines[1:], strict=False)], dtype=float)
        out[1:, 3 * OWN + 1] = same
        out[:-1, 3 * OWN + 2] = same
    return out, np.array([len(x) for x in lines], dtype=float)


class Model(NamedTuple):
    """Emission weights of "good", start and transition scores (0 bad, 1 good), and the calibration."""

    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray
    slope: float
    shift: float
    prior: float


def marginals(emission: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability that each line is good, by scaled forward-backward passes over one chain."""
    n = len(emission)
    a00, a01, a10, a11 = np.exp(move - move.max()).ravel().tolist()
    good = (1 / (1 + np.exp(-np.clip(emission, -60, 60)))).tolist()
    s = 1 / (1 + math.exp(-max(-60.0, min(60.0, start[1] - start[0]))))
    forward = []
    b, g = 1 - s, s
    for i in range(n):
        if i:
            b, g = b * a00 + g * a10, b * a01 + g * a11
        b, g = b * (1 - good[i]), g * good[i]
        total = b + g
        if total <= 0:
            b, g, total = 0.5, 0.5, 1.0
        b, g = b / total, g / total
        forward.append(g)
    out = [0.0] * n
    b = g = 1.0
    for i in range(n - 1, -1, -1):
        f = forward[i]
        x, y = (1 - f) * b, f * g
        out[i] = y / (x + y) if x + y > 0 else f
        eb, eg = b * (1 - good[i]), g * good[i]
        b, g = a00 * eb + a01 * eg, a10 * eb + a11 * eg
        total = b + g
        if total <= 0:
            b = g = total = 1.0
        b, g = b / total, g / total
    return np.array(out)


def raw_score(model: Model, features: np.ndarray, lengths: np.ndarray) -> float | None:
    """Log-odds of the length-weighted mean marginal; None without lines."""
    if not len(lengths):
        return None
    p = float(np.average(marginals(features @ model.weights, model.start, model.move), weights=lengths))
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def score_text(model: Model, text: str | None) -> float:
    """Probability that a text is of label 1; without lines, the share of label 1 in the sample."""
    raw = raw_score(model, *chain_features(text))
    return model.prior if raw is None else 1 / (1 + math.exp(-(model.slope * raw + model.shift)))


def fit(chains: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, steps: int = 160, decay: float = 2e-4) -> Model:
    """A model from labelled documents: each line carries its document's label.

    Maximises the mean, over documents, of the chain's log-likelihood a line, less an L2 penalty, by Adam with
    exact gradients from batched forward-backward passes. The calibration is a logistic fit of labels on raw scores.
    """
    width = 3 * OWN + 3
    used = [i for i, c in enumerate(chains) if len(c)]
    if not used or len(set(labels[used].tolist())) < 2:
        prior = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(width), np.zeros(2), np.zeros((2, 2)), 1.0, 0.0, prior)
    y = labels[used].astype(int)
    size = np.array([len(chains[i]) for i in used])
    order = np.argsort(-size, kind="stable")
    used, y, size = [used[i] for i in order], y[order], size[order]
    flat = np.concatenate([chains[i] for i in used])
    docs, most = len(used), int(size[0])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    alive = [int((size > t).sum()) for t in range(most)]
    weight = 1 / size / docs
    params = {"w": np.zeros(width), "s": np.zeros(2), "m": np.zeros((2, 2))}
    first_moment = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    gold = np.repeat(y, size)
    line_weight = np.repeat(weight, size)
    for step in range(1, steps + 1):
        e = np.clip(flat @ params["w"], -40, 40)
        p = 1 / (1 + np.exp(-e))
        emit = np.stack([1 - p, p], axis=1)
        trans = np.exp(params["m"] - params["m"].max())
        begin = np.exp(params["s"] - params["s"].max())
        alpha = np.zeros((len(flat), 2))
        for t in range(most):
            at = first[: alive[t]] + t
            a = (begin[None, :] if t == 0 else alpha[at - 1] @ trans) * emit[at]
            alpha[at] = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
        beta = np.ones((len(flat), 2))
        pair = np.zeros((2, 2))
        for t in range(most - 2, -1, -1):
            at = first[: alive[t + 1]] + t
            ahead = emit[at + 1] * beta[at + 1]
            b = ahead @ trans.T
            beta[at] = b / np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
            joint = alpha[at][:, :, None] * trans[None] * ahead[:, None, :]
            joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
            pair += (joint * weight[: alive[t + 1], None, None]).sum(axis=0)
        post = alpha * beta
        post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
        grad = {"w": flat.T @ ((gold - post[:, 1]) * line_weight) - decay * params["w"]}
        starts = post[first]
        grad["s"] = ((np.eye(2)[y] - starts) * weight[:, None]).sum(axis=0) - decay * params["s"]
        seen = np.zeros((2, 2))
        for c in (0, 1):
            seen[c, c] = (weight * (size - 1))[y == c].sum()
        grad["m"] = seen - pair - 50 * decay * params["m"]
        for k in params:
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            params[k] = params[k] + 0.1 * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    model = Model(params["w"], params["s"], params["m"], 1.0, 0.0, float(labels.mean()))
    raw = np.array([raw_score(model, chains[i], lengths[i]) for i in used])
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -40, 40)))
        v = p * (1 - p) + 1e-9
        g = np.array([((y - p) * raw).mean() - 1e-3 * slope, (y - p).mean()])
        h = np.array([[(v * raw * raw).mean() + 1e-3, (v * raw).mean()], [(v * raw).mean(), v.mean() + 1e-6]])
        slope, shift = np.array([slope, shift]) + np.clip(np.linalg.solve(h, g), -2, 2)
    return model._replace(slope=float(max(slope, 1e-3)), shift=float(shift))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents outside the held-out quarter.

    Held out are ids whose crc32 (as text) leaves 2 modulo 4. The sample, those of the smallest id hash, is the only
    thing that reaches the driver, as features of all lines of its documents; these have at most SAMPLE_LINES lines
    together. Texts under one id are documents of their own, equal ones count once, and each takes a line of that bound more
    than it has; an id whose texts do not fit any more is left out.
    """
    chosen = (
        labels.where("quality in (0, 1) and doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, int(q), *(x.astype(np.float32).tobytes() for x in chain_features(t))) for k, q, t in zip(batch.doc_id, batch.quality, batch.text, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "quality", "features", "lengths"])

    # rows of one id and text are one; each counts as a line more than it has, so that empty texts count too
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    held = cut(labelled.mapInPandas(extract, "doc_id long, quality int, features binary, lengths binary"))
    # four bytes a length, one length a line
    sizes = held.groupBy("doc_id").agg(F.sum(F.length("lengths") / 4 + 1).cast("long").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fits, left = [], SAMPLE_LINES
    for r in sizes:
        if r.n <= left:
            fits.append(r.doc_id)
            left -= r.n
    rows = sorted((held if len(fits) == len(sizes) else held.where(F.col("doc_id").isin(fits))).collect(), key=lambda r: (r.doc_id, r.features))
    chains = [np.frombuffer(r.features, np.float32).reshape(-1, 3 * OWN + 3).astype(float) for r in rows]
    return fit(chains, [np.frombuffer(r.lengths, np.float32).astype(float) for r in rows], np.array([r.quality for r in rows], dtype=int))


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ACCEPT on), replacing such columns.

    Lines are what newlines separate, blank ones aside; each is good or bad with a probability that its own and its
    neighbours' features give, and the document's score is their length-weighted mean, calibrated. Null, empty and
    blank texts score the share of label 1 in the sample. Repeated rows score alike; only ``text`` is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(shared.value, t) for t in texts], dtype=float)

    scored = docs.drop("score", "predicted").withColumn("score", score(text))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learned from ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op2_line_crf": op2_line_crf}
ORACLES: dict[str, str] = {}
