"""Quality classifier by positive-unlabelled learning.

The non-negative unbiased risk estimator is minimised over trusted positives, unlabelled web text and an
estimated class prior. Features are shares and lengths of the text and hashed shares of its words and word pairs, all
computed by Spark. The model, piecewise linear in the former and linear in the latter, is fitted on bounded samples; its score is a Column,
so texts never leave the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, words

#: Rows of either sample, about; drawn by a hash of their ids.
SAMPLE = 6000
KNOTS = 8
#: Buckets that words and word pairs are hashed to.
BUCKETS = 256
STEPS, RATE, PENALTY = 400, 0.05, 1e-3
#: Share of the positives above a threshold that an estimate of the prior needs, and the width of its confidence bound in standard errors.
LEAST_ABOVE, WIDTH = 0.05, 1.6

NAMES = ["length", "symbols", "exclamations", "upper", "digits", "stops", "word_length", "distinct_words", "repeated_lines", "line_length"]


def with_features(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """The columns `keep`, the features of NAMES, none of them null, and _b: the bucket of each word and each pair of neighbours.
    Null and empty texts are alike."""
    kept = [F.col(f"`{x}`") for x in keep]
    c = F.coalesce(text, F.lit(""))
    parts = df.select(*kept, c.alias("_t"), F.transform(words(text), lambda w: F.xxhash64(w)).alias("_h"), F.split(c, "\n", -1).alias("_l"))
    t, hashes, lines = F.col("_t"), F.col("_h"), F.col("_l")
    chars = F.char_length(t).cast("double")
    n, count = F.greatest(chars, F.lit(1.0)), F.greatest(F.size(hashes), F.lit(1)).cast("double")

    def times(found: str) -> Column:
        return F.regexp_count(t, F.lit(found)).cast("double")

    made = [
        F.log1p(chars), times("[#*$%&|<>]") / count, times("[!?]") / count, times("\\p{Lu}") / n, times("[0-9]") / n, times("[.,;:]") / count,
        n / count, F.size(F.array_distinct(hashes)) / count, (F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines), F.log1p(n / F.size(lines)),
    ]
    pairs = F.zip_with(hashes, F.slice(hashes, 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.pmod(a.bitwiseXOR(F.shiftleft(b, 1)), F.lit(BUCKETS)).cast("int")))
    buckets = F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")), F.slice(pairs, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))
    return parts.select(*kept, *[x.cast("double").alias(f"_{name}") for name, x in zip(NAMES, made, strict=True)], buckets.alias("_b"))


@dataclass(frozen=True)
class Model:
    knots: np.ndarray  # (features, KNOTS)
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of the named features and the bucket shares."""
        z = (_expand(x, self.knots) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights + self.bias, -40, 40)))

    def margin(self) -> Column:
        """The model's log odds over the columns of `with_features` as one expression: for each named feature a line between two knots."""
        w = self.weights / self.scale
        count, knots = self.knots.shape
        rest = self.bias - float(w @ self.centre)
        total = F.lit(rest)
        for j, name in enumerate(NAMES):
            hinge, step = w[count + j * knots : count + (j + 1) * knots], w[count * (1 + knots) + j * knots : count * (1 + knots) + (j + 1) * knots]
            lines = [(float(step[:k].sum() - (hinge[:k] * self.knots[j, :k]).sum()), float(w[j] + hinge[:k].sum())) for k in range(knots + 1)]
            x = F.col(f"_{name}")
            part = F.lit(lines[-1][0]) + F.lit(lines[-1][1]) * x
            for k in range(knots - 1, -1, -1):
                part = F.when(x <= float(self.knots[j, k]), F.lit(lines[k][0]) + F.lit(lines[k][1]) * x).otherwise(part)
            total = total + part
        by_bucket = F.split(F.lit(",".join(repr(float(x)) for x in w[count * (1 + 2 * knots) :])), ",").cast("array<double>")
        found = F.aggregate(F.col("_b"), F.lit(0.0), lambda s, b: s + F.get(by_bucket, b))
        return total + found / F.greatest(F.size("_b"), F.lit(1))


def _expand(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    first = x[:, : len(knots)]
    hinges = np.maximum(first[:, :, None] - knots[None, :, :], 0).reshape(len(x), -1)
    steps = (first[:, :, None] > knots[None, :, :]).astype(float).reshape(len(x), -1)
    return np.concatenate([first, hinges, steps, x[:, len(knots) :]], axis=1)


def _descend(p: np.ndarray, u: np.ndarray, gradient) -> np.ndarray:
    """Weights, the bias last, after STEPS steps of Adam."""
    w, m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for t in range(1, STEPS + 1):
        g = gradient(p, u, p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]) + PENALTY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _scaled(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, ...]:
    first = np.concatenate([positive[:, : len(NAMES)], unlabelled[:, : len(NAMES)]])
    knots = np.quantile(first, np.linspace(0.02, 0.98, KNOTS), axis=0).T
    raw_p, raw_u = _expand(positive, knots), _expand(unlabelled, knots)
    both = np.concatenate([raw_p, raw_u])
    centre, scale = both.mean(axis=0), both.std(axis=0) + 1e-9
    return knots, centre, scale, (raw_p - centre) / scale, (raw_u - centre) / scale


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]) with the logistic loss by Adam.
    Where the second part is negative, the step goes against it, so that it isn't fitted to below zero."""
    knots, centre, scale, p, u = _scaled(positive, unlabelled)

    def gradient(p: np.ndarray, u: np.ndarray, fp: np.ndarray, fu: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(fp), _sigmoid(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        plus = np.append(prior * ((sp - 1) @ p) / len(p), prior * (sp - 1).mean())
        minus = np.append(su @ u / len(u) - prior * (sp @ p) / len(p), su.mean() - prior * sp.mean())
        return plus + minus if negative >= 0 else -minus

    w = _descend(p, u, gradient)
    return Model(knots, centre, scale, w[:-1], float(w[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts among the unlabelled ones, from positives and unlabelled texts alone.

    Positives are told from unlabelled texts on one half of either sample and scored on the other. Above a threshold lie a share p of
    the positives and a share u of the unlabelled; u / p bounds the prior from above, and is nearest to it where hardly any bad text
    scores so high. The threshold of the least upper confidence bound decides. With fewer than 20 rows of either it is 0.5.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    _, _, _, p, u = _scaled(positive, unlabelled)

    def gradient(p: np.ndarray, u: np.ndarray, fp: np.ndarray, fu: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(fp), _sigmoid(fu)
        return np.append(((sp - 1) @ p) / len(p) + su @ u / len(u), (sp - 1).mean() + su.mean())

    found = []
    for half in (0, 1):
        w = _descend(p[half::2], u[half::2], gradient)
        above, also = np.sort(p[1 - half :: 2] @ w[:-1])[::-1], np.sort(u[1 - half :: 2] @ w[:-1])
        counts = np.arange(max(5, int(LEAST_ABOVE * len(above))), len(above) + 1)
        share_p = counts / len(above)
        share_u = 1 - np.searchsorted(also, above[counts - 1], side="left") / len(also)
        error = np.sqrt(share_u * (1 - share_u) / len(also)) + share_u / share_p * np.sqrt(share_p * (1 - share_p) / len(above))
        best = int(np.argmin((share_u + WIDTH * error) / share_p))
        found.append(share_u[best] / share_p[best])
    return float(min(0.99, max(0.01, np.mean(found))))


def _matrix(sample: DataFrame) -> np.ndarray:
    made = with_features(sample, F.col("text"), [])
    arrow = made.select(F.array(*[f"_{name}" for name in NAMES]).alias("x"), "_b").toArrow()
    x = arrow.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    lists = arrow.column("_b").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    flat = np.bincount(row * BUCKETS + lists.flatten().to_numpy(zero_copy_only=False), minlength=len(size) * BUCKETS)
    return np.concatenate([x, flat.reshape(-1, BUCKETS) / np.maximum(size, 1)[:, None]], axis=1)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Model | None:
    """A model from about `sample` trusted positives (label 1) and about `sample` unlabelled texts.

    Only rows of `docs` (doc_id, text) under `may_learn` lend their labels, and only label 1 teaches anything: the prior is estimated from
    positives and unlabelled texts. None if there are no positives or no texts. Null ids have no label.
    """
    trusted = labels.filter("quality = 1").select("doc_id").distinct()
    judged = docs.filter(may_learn).join(trusted, "doc_id", "left_semi")
    good = _matrix(hash_sample(judged, sample, judged.count(), "doc_id"))
    unlabelled = _matrix(hash_sample(docs, sample, docs.count(), "doc_id", salt=1))
    if not len(good) or not len(unlabelled):
        return None
    return fit(good, unlabelled, estimated_prior(good, unlabelled))


def scored(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with `out`, the probability that the text is good: every row, empty and null texts too; 0.5 without a model.
    A column of that name is replaced."""
    kept = [c for c in docs.columns if c != out]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.5).alias(out))
    made = with_features(docs, F.col(f"`{text}`"), kept)
    margin = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), model.margin()))
    return made.select(*[F.col(f"`{c}`") for c in kept], (1 / (1 + F.exp(-margin))).alias(out))
