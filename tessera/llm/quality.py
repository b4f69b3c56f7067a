"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator (Kiryo et al., 2017).

Trusted positives are labelled rows of quality 1; unlabelled web text is drawn from all documents of the learning
folds, whatever their label. Labels of quality 0 are never used. The class prior is estimated by best bin estimation
(Garg et al., 2021): over thresholds, the least ratio of the unlabelled to the positive share above the threshold.
The model, a small network over text statistics, is fitted on a bounded sample (POSITIVES and UNLABELLED rows of least
hash), whose features, not texts, reach the driver. Every text is scored whole; the weights travel with the task.

Defined cases: null text counts as empty, and empty texts get a score as any other; very long texts are read whole; null
ids and repeated rows are scored one by one, and of rows that repeat an id one text (of the least hash) may be learnt;
repeated labels count as positive when one of them is; without any positive, every score is 0.5; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import one_text, sampled

POSITIVES = 4000
UNLABELLED = 8000
THRESHOLD = 0.3
FEATURES = 20
#: Taken off the estimated prior: too low a prior costs little, too high a one makes negatives positive.
CAUTION = 0.02

_CLASSES = [range(65, 91), range(97, 123), range(48, 58), b" \t\n\r\v\f", b"!?", b"|", b"$*#%&@^~+=_", b".,;:'\"-()", range(128, 256), b"<>{}[]\\/`"]


def features(text: str | None) -> np.ndarray:
    """Statistics of bytes, words and lines; shares, so that length matters only by its logarithm."""
    out = np.zeros(FEATURES, np.float32)
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, w = counts.sum(), len(words)
    for i, own in enumerate(_CLASSES):
        out[i] = counts[list(own)].sum() / n
    distinct = len(set(words))
    out[10] = out[0] / (out[0] + out[1] + 1e-6)
    out[11] = sum(map(eq, words, words[1:])) / w
    out[12] = sum(map(eq, words, words[2:])) / w
    out[13] = np.log(distinct) / np.log(w + 1)
    out[14] = (counts[33] + counts[63]) / w
    out[15] = counts[124] / w
    out[16] = counts[[36, 42, 35, 37, 38]].sum() / w
    out[17] = len(set(lines)) / len(lines)
    out[18] = n / w / 10
    out[19] = np.log(w) / 10
    return out


class Net:
    """Standardized inputs, one hidden layer of tanh units, a logistic output; Adam on the non-negative risk."""

    def __init__(self, x: np.ndarray, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-3
        self.w = [rng.normal(0, 0.3, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]

    def _hidden(self, x):
        return np.tanh(np.clip((x - self.mean) / self.sd, -8, 8) @ self.w[0] + self.w[1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def gradients(self, p: np.ndarray, u: np.ndarray, prior: float) -> list[np.ndarray]:
        """Of prior * R_p(+) + R_u(-) - prior * R_p(-) under the logistic loss, by the weights; where the negative part
        R_u(-) - prior * R_p(-) is below 0, of that part's opposite."""
        z = np.clip((np.concatenate([p, u]) - self.mean) / self.sd, -8, 8)
        h = np.tanh(z @ self.w[0] + self.w[1])
        s = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3][0], -30, 30)))
        sp, su = s[: len(p)], s[len(p) :]
        negative = (-np.log(1 - su + 1e-9)).mean() - prior * (-np.log(1 - sp + 1e-9)).mean()
        if negative >= 0:
            g = np.concatenate([(prior * (sp - 1) - prior * sp) / len(p), su / len(u)])
        else:  # the negative part has been fitted beyond what is possible: step back
            g = np.concatenate([prior * sp / len(p), -su / len(u)])
        gh = np.outer(g, self.w[2]) * (1 - h * h)
        return [z.T @ gh, gh.sum(0), h.T @ g, g.sum(keepdims=True)]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Net:
        """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under the logistic loss."""
        rng = np.random.default_rng(seed)
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for t in range(1, steps + 1):
            p, u = positive[rng.integers(0, len(positive), batch)], unlabelled[rng.integers(0, len(unlabelled), batch)]
            for i, d in enumerate(self.gradients(p, u, prior)):
                d = d + 1e-4 * self.w[i]
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                self.w[i] = self.w[i] - rate * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Best bin estimation of the share of positives among the unlabelled, from held-out scores of a classifier that
    tells them apart."""
    cuts = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Net, float] | None:
    """The model and the estimated prior; None without positives or unlabelled rows."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    every = np.concatenate([positive, unlabelled])
    # with a prior of 1/2 on both sides and no subtraction this is plain positive-against-unlabelled learning
    split = Net(every).fit(positive[::2], unlabelled[::2], 0.5, 600)
    for _ in range(2):
        share = max(0.05, prior(split.score(positive[1::2]), split.score(unlabelled[1::2])) - CAUTION)
        split = Net(every).fit(positive[::2], unlabelled[::2], share, 1000)  # tells them apart better than the first
    return Net(every).fit(positive, unlabelled, share), share


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            x = [features(t).astype(float).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["positive", "x"])

    return docs.mapInArrow(run, "positive boolean, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Net, float] | None:
    """docs: doc_id, text. labels: doc_id and the label. learn: whether a doc_id's row may be learnt from."""
    ids = docs.select("doc_id").where(learn & F.col("doc_id").isNotNull())
    good = labels.where((F.col(label) == 1) & learn).select("doc_id").distinct()
    chosen = sampled(ids.join(good, "doc_id", "left_semi").distinct(), positives, "doc_id").select("doc_id", F.lit(True).alias("positive"))
    chosen = chosen.unionByName(sampled(ids.distinct(), unlabelled, "doc_id").select("doc_id", F.lit(False).alias("positive")))
    texts = one_text(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text"), "doc_id", "positive")
    rows = _featured(texts.select("positive", "text")).collect()  # positives + unlabelled rows at most
    x = {side: np.array([r["x"] for r in rows if r["positive"] is side], np.float32).reshape(-1, FEATURES) for side in (True, False)}
    # the order in which tasks end must not matter
    x = {side: v[np.lexsort(v.T)] for side, v in x.items()}
    rng = np.random.default_rng(1)
    return train(x[True][rng.permutation(len(x[True]))], x[False][rng.permutation(len(x[False]))])


def scored(docs: DataFrame, model: tuple[Net, float] | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], np.float32).reshape(-1, FEATURES)
            s = model[0].score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.astype(float))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def rejected(docs: DataFrame, model: tuple[Net, float] | None, threshold: float = THRESHOLD) -> Column:
    """A column, true for texts to reject."""

    @F.pandas_udf("boolean")
    def low(texts):
        import pandas as pd

        x = np.array([features(t) for t in texts], np.float32).reshape(-1, FEATURES)
        return pd.Series(model[0].score(x) < threshold if model else np.zeros(len(x), bool))

    return low("text")
