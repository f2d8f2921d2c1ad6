"""Operator 4: quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text, no trusted negatives: a small
network minimises the non-negative unbiased risk
``pi R+(P) + max(0, R-(U) - pi R-(P))`` with the class prior ``pi`` estimated
from the data. Texts are scored whole by a vectorised function of the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import words

FIT_POSITIVES = 6_000    # bound of the sample of labelled positives
FIT_UNLABELLED = 12_000  # bound of the sample of unlabelled texts
HIDDEN = 16
STEPS = 800
BATCH = 512
DECAY = 1e-3
THRESHOLD = 0.7
SEED = 11

_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r",
                             b".,;:?", b"!", b"|", b"#$%&*", b"()[]{}<>/\\=+-_@~^`\"'"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 11
N_CLASSES = 12
N_FEATURES = N_CLASSES + 8


def features(texts: list) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers per text: shares of byte classes,
    share of distinct words, of words equal to the one before, of distinct
    lines and the like. A null text counts as empty; an empty one is all zero."""
    out = np.zeros((len(texts), N_FEATURES))
    for lo in range(0, len(texts), 128):
        part = texts[lo:lo + 128]
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in part]
        h, n = words(part)
        at = np.concatenate(([0], np.cumsum(n)))
        for i, b in enumerate(raw):
            if not b:
                continue
            row = out[lo + i]
            a = _CLASS[np.frombuffer(b, dtype=np.uint8)]
            row[:N_CLASSES] = np.bincount(a, minlength=N_CLASSES) / len(b)
            w = h[at[i]:at[i + 1]]
            lines = b.split(b"\n")
            k = N_CLASSES
            row[k] = np.log1p(len(b)) / 10
            row[k + 1] = len(set(lines)) / len(lines)
            row[k + 2] = np.log1p(len(b) / len(lines)) / 10
            if len(w):
                distinct = len(np.unique(w))
                row[k + 3] = np.log1p(len(w)) / 10
                row[k + 4] = distinct / len(w)
                row[k + 5] = float(np.mean(w[1:] == w[:-1])) if len(w) > 1 else 0.0
                row[k + 6] = np.log1p(distinct) / np.log1p(len(w))
                row[k + 7] = len(b) / len(w) / 20
    return out


def _forward(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hid = np.tanh(((x - m["mean"]) / m["scale"]).clip(-6, 6) @ m["w1"] + m["b1"])
    return hid, hid @ m["w2"] + m["b2"]


def predict(m: dict, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows; each is summed on its own, so that equal rows
    get equal scores whatever batch they are in."""
    hid = np.tanh(np.einsum("ij,jk->ik", ((x - m["mean"]) / m["scale"]).clip(-6, 6), m["w1"]) + m["b1"])
    return 1.0 / (1.0 + np.exp(-np.clip(np.einsum("ik,k->i", hid, m["w2"]) + m["b2"], -40, 40)))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, hidden: int = HIDDEN) -> dict:
    """Adam on mini-batches. ``prior`` None: plain positive against unlabelled
    logistic loss (for the prior's estimate)."""
    rng = np.random.default_rng(SEED)
    both = np.vstack((pos, unl))
    m = {"mean": both.mean(0), "scale": both.std(0) + 1e-3, "w1": rng.normal(0, 0.3, (both.shape[1], hidden)),
         "b1": np.zeros(hidden), "w2": rng.normal(0, 0.3, hidden), "b2": 0.0}
    names = ("w1", "b1", "w2", "b2")
    mom = {k: [np.zeros_like(m[k], dtype=float), np.zeros_like(m[k], dtype=float)] for k in names}
    for step in range(1, STEPS + 1):
        p, u = (x[rng.integers(0, len(x), BATCH)] for x in (pos, unl))
        xp, xu = (((x - m["mean"]) / m["scale"]).clip(-6, 6) for x in (p, u))
        (hp, gp), (hu, gu) = _forward(m, p), _forward(m, u)
        sp, su = (1 / (1 + np.exp(-np.clip(g, -40, 40))) for g in (gp, gu))
        if prior is None:
            dp, du = (sp - 1) / BATCH, su / BATCH
        else:
            # negative part of the risk: R-(U) - prior R-(P), logistic loss
            negative = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
            if negative >= 0:
                dp, du = prior * ((sp - 1) - sp) / BATCH, su / BATCH
            else:  # step back from the negative risk only
                dp, du = prior * sp / BATCH, -su / BATCH
        bp, bu = (d[:, None] * m["w2"] * (1 - h ** 2) for d, h in ((dp, hp), (du, hu)))
        grads = {"w1": xp.T @ bp + xu.T @ bu, "b1": bp.sum(0) + bu.sum(0),
                 "w2": hp.T @ dp + hu.T @ du, "b2": dp.sum() + du.sum()}
        rate = 0.02 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k in names:
            g = grads[k] + (DECAY * m[k] if k.startswith("w") else 0)
            mom[k] = [0.9 * mom[k][0] + 0.1 * g, 0.999 * mom[k][1] + 0.001 * g * g]
            m[k] = m[k] - rate * (mom[k][0] / (1 - 0.9 ** step)) / (np.sqrt(mom[k][1] / (1 - 0.999 ** step)) + 1e-8)
    return m


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled, cross-fitted: a positive
    against unlabelled score fitted on one half is read on the other; there
    the smallest ratio of unlabelled to positive mass above a threshold that
    keeps half of the positives, plus its standard error."""
    found = []
    for fold in (0, 1):
        m = _fit(pos[fold::2], unl[fold::2], None, hidden=4)
        sp, su = predict(m, pos[1 - fold::2]), predict(m, unl[1 - fold::2])
        best = 1.0
        for t in np.quantile(sp, np.linspace(0.0, 0.5, 26)):
            p, u = np.mean(sp >= t), np.mean(su >= t)
            best = min(best, u / p + np.sqrt(u * (1 - u) / len(su)) / p + u / p ** 2 * np.sqrt(p * (1 - p) / len(sp)))
        found.append(best)
    return float(np.clip(np.mean(found), 0.05, 0.95))


def fit(positives: np.ndarray, unlabelled: np.ndarray) -> dict:
    """The model and the class prior it was fitted with. With fewer than two
    rows of either kind there is nothing to learn and every score is 0.5."""
    if min(len(positives), len(unlabelled)) < 2:
        zero = np.zeros(N_FEATURES)
        return {"mean": zero, "scale": zero + 1, "w1": np.zeros((N_FEATURES, HIDDEN)), "b1": np.zeros(HIDDEN),
                "w2": np.zeros(HIDDEN), "b2": 0.0, "prior": None}
    prior = class_prior(positives, unlabelled)
    return _fit(positives, unlabelled, prior) | {"prior": prior}


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          quality: str = "quality") -> dict:
    """Fit on texts of rows labelled 1 (``labels`` as the caller allows them)
    against unlabelled texts. Both samples are the rows of smallest id hash,
    at most ``FIT_POSITIVES`` and ``FIT_UNLABELLED``, one row per id; only
    their features come to the driver."""
    order = F.xxhash64(F.col("id"), F.lit(SEED))
    ids = docs.select(F.col(doc_id).alias("id")).filter("id IS NOT NULL")
    pos = (labels.filter(F.col(quality) == 1).select(F.col(doc_id).alias("id")).distinct()
                 .join(ids.distinct(), "id", "left_semi").orderBy(order, "id").limit(FIT_POSITIVES))
    unl = ids.distinct().orderBy(order, "id").limit(FIT_UNLABELLED)
    picked = pos.withColumn("p", F.lit(1)).unionAll(unl.withColumn("p", F.lit(0)))
    # One text per id, however many rows share it: the one of the smallest hash.
    rows = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(picked), "id")
                .groupBy("id", "p").agg(F.min(F.struct(F.xxhash64("t").alias("h"), F.col("t").alias("t"))).alias("r"))
                .select("id", "p", "r.t"))

    def feats(batches):
        for pdf in batches:
            x = features(pdf["t"].tolist())
            yield pd.DataFrame({"id": pdf["id"], "p": pdf["p"], "x": list(x)})

    got = rows.mapInPandas(feats, "id long, p int, x array<double>").toPandas().sort_values(["p", "id"])
    x = np.array(got["x"].tolist()).reshape(len(got), N_FEATURES)
    is_pos = got["p"].to_numpy() == 1
    return fit(x[is_pos], x[~is_pos])


def scorer(model: dict):
    """A pandas function of the text column: the score between 0 and 1."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(model, features(texts.tolist())))
    return score


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  quality: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1
    from ``threshold`` on). Columns of those names are replaced. A null text
    is scored as an empty one; equal texts get equal scores; labels without a
    document, or documents without a label, are no error."""
    model = train(docs, labels, doc_id, text, quality)
    kept = docs.drop("score", "predicted")
    return (kept.withColumn("score", scorer(model)(F.col(text)))
                .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
