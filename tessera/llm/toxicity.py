"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins word features (a hashed embedding, and how much more often toxic than clean training texts hold
the word) and character features (the same two over its character trigrams, averaged), so unseen spellings near
learnt words are caught. Windows of WINDOW words, each STRIDE after the last, cover a text whole; the last one ends with
the text; shorter texts are padded. A text's score is the greatest window's, put on a probability scale by a logistic
fit over the training texts.

The network is fitted on a bounded sample of labelled rows (TOXIC and CLEAN texts of least hash). Labels hold for texts,
so in every pass the window of a toxic text that scores highest is its positive example, and windows of clean texts
are negative ones. Scoring needs no shuffle; the weights travel with the task.

Defined cases: null text counts as empty, and empty texts are scored as a window of padding; very long texts are scored
whole; null ids and repeated rows are scored one by one, and of rows that repeat an id one text (of the least hash) may be
learnt; repeated labels count as toxic when one of them is; without toxic or clean training rows every score is 0; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import one_text, sampled

TOXIC = 1000
CLEAN = 2000
#: Windows of clean texts that a pass may pick hard ones from.
POOL = 16_000
THRESHOLD = 0.3
WINDOW, STRIDE = 24, 16
WORDS, GRAMS = 1 << 15, 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN = 6, 6, 8
INPUT = WORD_DIM + CHAR_DIM + 2
#: Training texts are dealt into so many folds for evidence.
FOLDS = 4
DECAY = 1e-3
#: Words that a task keeps inputs of.
KEPT_WORDS = 300_000

_BREAKS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split() if text else []


def starts(n: int) -> list[int]:
    """Where windows of a text of n words begin."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def word_ids(some: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in some), np.int64, len(some)) % WORDS


def gram_ids(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each word, edges marked by a space, in one row; and where each word's begin."""
    b = np.frombuffer(b" " + b" ".join(some) + b" ", np.uint8).astype(np.uint64)
    h = b[:-2] * np.uint64(0x9E3779B1) ^ b[1:-1] * np.uint64(0x85EBCA6B) ^ b[2:] * np.uint64(0xC2B2AE35)
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D)
    h = ((h ^ (h >> np.uint64(13))) % np.uint64(GRAMS)).astype(np.int64)
    inside = b[1:-1] != 32
    lengths = np.fromiter(map(len, some), np.int64, len(some))
    return h[inside], np.concatenate([[0], np.cumsum(lengths)[:-1]])


def evidence(toxic: list, clean: list) -> dict:
    """How strongly each item of a set speaks for toxic texts: the signed root of the likelihood ratio statistic of the
    numbers of texts of either side that hold it. toxic, clean: the texts' items. Items of one text alone have none."""
    counts = [collections.Counter(), collections.Counter()]
    for side, n in zip((toxic, clean), counts):
        for items in side:
            n.update(set(items))
    keys = [k for k in {**counts[0], **counts[1]} if counts[0][k] + counts[1][k] >= 2]
    t, c = (np.array([n[k] for k in keys], float) for n in counts)
    share = (len(toxic) + 1) / (len(toxic) + len(clean) + 2)
    n = t + c
    root = 2 * (t * np.log((t + 1e-9) / (n * share + 1e-9)) + c * np.log((c + 1e-9) / (n * (1 - share) + 1e-9)))
    z = np.sign(t - n * share) * np.sqrt(np.maximum(root, 0))
    return dict(zip(keys, np.clip(z, -12, 12).tolist()))


def gram_evidence(toxic: list[list[bytes]], clean: list[list[bytes]]) -> np.ndarray:
    """The same for hashed character trigrams."""
    found = evidence(*[[gram_ids(t)[0].tolist() if t else [] for t in side] for side in (toxic, clean)])
    out = np.zeros(GRAMS)
    out[list(found)] = list(found.values())
    return out


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        n = lambda *s, by=0.3: r.normal(0, by, s)
        self.p = {
            "word": n(WORDS, WORD_DIM, by=0.05),
            "char": n(GRAMS, CHAR_DIM, by=0.05),
            "att": n(2 * HIDDEN, HIDDEN),
            "att_b": np.zeros(HIDDEN),
            "att_v": n(HIDDEN),
            "out": n(2 * HIDDEN),
            "out_b": np.full(1, -1.0),
        }
        for d in "fb":
            self.p |= {f"x{d}": n(INPUT, 3 * HIDDEN), f"h{d}": n(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN)}
        self.word_z: dict[bytes, float] = {}
        self.gram_z = np.zeros(GRAMS)
        self.slope, self.shift = 1.0, 0.0

    def as_float32(self) -> Network:
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def inputs(self, some: list[bytes]) -> np.ndarray:
        """Input rows of distinct words."""
        w = word_ids(some)
        g, at = gram_ids(some)
        n = np.diff(np.append(at, len(g)))[:, None]
        chars = np.add.reduceat(np.column_stack([self.p["char"][g], self.gram_z[g] / 4]), at) / n
        return np.column_stack([self.p["word"][w], np.fromiter((self.word_z.get(x, 0.0) for x in some), float, len(some)) / 4, chars]).astype(self.p["out"].dtype)

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"]

    def _gru(self, d: str, steps: list[np.ndarray], keep: list | None = None) -> list[np.ndarray]:
        u, h, out = self.p[f"h{d}"], np.zeros((len(steps[0]), HIDDEN), steps[0].dtype), []
        for a in steps:
            m = h @ u
            zr = np.tanh((a[:, : 2 * HIDDEN] + m[:, : 2 * HIDDEN]) * a.dtype.type(0.5)) * a.dtype.type(0.5) + a.dtype.type(0.5)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + r * m[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, z, r, c, m[:, 2 * HIDDEN :]))
            h = c + z * (h - c)
            out.append(h)
        return out

    def logits(self, projected: list[np.ndarray], windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """windows: rows of WINDOW numbers of projected inputs."""
        t = range(windows.shape[1])
        kf, kb = (None, None) if keep is None else ([], [])
        f = self._gru("f", [projected[0][windows[:, i]] for i in t], kf)
        b = self._gru("b", [projected[1][windows[:, i]] for i in reversed(t)], kb)[::-1]
        h = np.concatenate([np.stack(f, 1), np.stack(b, 1)], 2)
        a = np.tanh(h @ self.p["att"] + self.p["att_b"])
        e = a @ self.p["att_v"]
        e = np.exp(e - e.max(1, keepdims=True))
        alpha = e / e.sum(1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", alpha, h)
        if keep is not None:
            keep |= {"h": h, "a": a, "alpha": alpha, "pooled": pooled, "f": kf, "b": kb}
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def gradients(self, x: np.ndarray, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted cross entropy over windows, by the parameters and by the input rows."""
        k: dict = {}
        s = 1 / (1 + np.exp(-np.clip(self.logits(self.project(x), windows, k), -30, 30)))
        d = (s - target) * weight / len(target)
        p, h, a, alpha = self.p, k["h"], k["a"], k["alpha"]
        g = {"out": k["pooled"].T @ d, "out_b": d.sum(keepdims=True)}
        pooled = d[:, None] * p["out"]
        dh = alpha[:, :, None] * pooled[:, None, :]
        da = np.einsum("bth,bh->bt", h, pooled)
        de = alpha * (da - (alpha * da).sum(1, keepdims=True))
        g["att_v"] = np.einsum("bt,bth->h", de, a)
        dt = de[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("bti,btj->ij", h, dt), dt.sum((0, 1))
        dh += dt @ p["att"].T
        dx = np.zeros_like(x)
        for name, part, order in (("f", dh[:, :, :HIDDEN], range(WINDOW)), ("b", dh[:, :, HIDDEN:], range(WINDOW - 1, -1, -1))):
            u, gx, gu, gc = p[f"h{name}"], np.zeros_like(p[f"x{name}"]), np.zeros_like(p[f"h{name}"]), np.zeros(3 * HIDDEN)
            carry = np.zeros_like(part[:, 0])
            for at, (prev, z, r, c, mc) in zip(reversed(order), reversed(k[name])):
                gh = part[:, at] + carry
                gcand = gh * (1 - z) * (1 - c * c)
                gz, gr = gh * (prev - c) * z * (1 - z), gcand * mc * r * (1 - r)
                gates = np.concatenate([gz, gr, gcand], 1)
                through = np.concatenate([gz, gr, gcand * r], 1)
                carry = gh * z + through @ u.T
                own = x[windows[:, at]]
                gx += own.T @ gates
                gu += prev.T @ through
                gc += gates.sum(0)
                np.add.at(dx, windows[:, at], gates @ p[f"x{name}"].T)
            g |= {f"x{name}": gx, f"h{name}": gu, f"c{name}": gc}
        return g, dx

    def learn(self, toxic: list[list[bytes]], clean: list[list[bytes]], passes: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 11) -> Network:
        """Windows of toxic texts are picked by the present network (at first by word evidence), those of clean texts by
        chance, with as many hard ones."""
        r = np.random.default_rng(seed)
        self.word_z = evidence(toxic, clean)
        self.gram_z = gram_evidence(toxic, clean)
        distinct = sorted({w for t in (*toxic, *clean) for w in t})
        number, v_size = {w: i for i, w in enumerate(distinct)}, len(distinct)
        sides = []
        for side in (toxic, clean):
            rows, owner = [], []
            for i, t in enumerate(side):
                ids = [number[w] + 1 + (i % FOLDS) * v_size for w in t]
                for s in starts(len(ids)):
                    rows.append((ids[s : s + WINDOW] + [0] * WINDOW)[:WINDOW])
                    owner.append(i)
            sides.append((np.array(rows), np.array(owner)))
        (tw, to), (cw, co) = sides
        g_ids, g_at = gram_ids(distinct)
        g_n = np.diff(np.append(g_at, len(g_ids)))
        w_ids = word_ids(distinct)
        # a text's words carry the evidence of the other folds' texts, as an unseen text's do
        word_z, gram_z = [], []
        for fold in range(FOLDS):
            rest = [[t for i, t in enumerate(side) if i % FOLDS != fold] for side in (toxic, clean)]
            got = evidence(*rest)
            word_z.append(np.array([got.get(w, 0.0) for w in distinct]) / 4)
            gram_z.append(np.add.reduceat(gram_evidence(*rest)[g_ids], g_at) / g_n / 4 if v_size else [])
        word_z, gram_z = np.concatenate(word_z), np.concatenate(gram_z)

        def rows_of(own):
            """Input rows of numbers of (fold, word); 0 is padding."""
            x, real = np.zeros((len(own), INPUT)), own > 0
            k = own[real] - 1
            if len(k):
                x[real] = self.inputs([distinct[i] for i in k % v_size])
                x[real, WORD_DIM], x[real, INPUT - 1] = word_z[k], gram_z[k]
            return x, real, k

        z = np.append(0, word_z)
        ts, cs = z[tw].max(1), z[cw].max(1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, steps = 0, None
        for turn in range(passes):
            best = np.lexsort((-ts, to))
            positive = tw[best[np.unique(to[best], return_index=True)[1]]]
            many = 3 * max(len(positive), 64)
            hard = np.argsort(-cs, kind="stable")[: many // 3]
            negative = cw[np.concatenate([hard, r.integers(0, len(cw), many - len(hard))])]
            repeats = max(1, 768 // len(positive))
            windows = np.concatenate([np.tile(positive, (repeats, 1)), np.tile(negative, (repeats, 1))])
            target = np.repeat([1.0, 0.0], [len(positive) * repeats, len(negative) * repeats])
            order = r.permutation(len(windows))
            steps = steps or passes * math.ceil(len(order) / batch)
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                own, at = np.unique(windows[pick], return_inverse=True)
                at = at.reshape(-1, WINDOW)
                x, real, k = rows_of(own)
                kept = r.random((len(own), 1)) > 0.5  # learnt parts rest at times, so that evidence and order carry too
                learnt = [*range(WORD_DIM), *range(WORD_DIM + 1, INPUT - 1)]
                x[:, learnt] *= kept
                g, dx = self.gradients(x, at, target[pick], np.where(target[pick] == 1, 1.5, 1.0))
                dx[:, learnt] *= kept
                g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
                w = k % max(1, v_size)
                np.add.at(g["word"], w_ids[w], dx[real, :WORD_DIM])
                n = g_n[w]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                np.add.at(g["char"], g_ids[np.repeat(g_at[w], n) + within], np.repeat(dx[real, WORD_DIM + 1 : INPUT - 1] / n[:, None], n, axis=0))
                step += 1
                for key, d in g.items():
                    d = np.clip(d, -1, 1) + DECAY * self.p[key]
                    m[key] = 0.9 * m[key] + 0.1 * d
                    v[key] = 0.999 * v[key] + 0.001 * d * d
                    pace = rate * (0.1 if key in ("word", "char") else 1.0)
                    self.p[key] = self.p[key] - pace * (1 - step / (steps + 1)) * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
            last = turn == passes - 1
            pool = np.arange(len(cw)) if last else np.sort(r.permutation(len(cw))[:POOL])
            ts, cs = np.zeros(len(tw)), np.full(len(cw), -np.inf)
            for fold in range(FOLDS):
                own = np.arange(fold * v_size, (fold + 1) * v_size + 1)  # the first stands for padding
                parts = [rows_of(np.where(own[i : i + 20_000] == fold * v_size, 0, own[i : i + 20_000]))[0] for i in range(0, len(own), 20_000)]
                projected = [np.concatenate(x).astype(np.float32) for x in zip(*map(self.project, parts))]
                for rows, owner, out, pick in ((tw, to, ts, np.arange(len(tw))), (cw, co, cs, pool)):
                    pick = pick[owner[pick] % FOLDS == fold]
                    if len(pick):
                        out[pick] = self._all(projected, np.maximum(rows[pick] - fold * v_size, 0))
        top_t, top_c = np.full(len(toxic), -np.inf), np.full(len(clean), -np.inf)
        np.maximum.at(top_t, to, ts)
        np.maximum.at(top_c, co, cs)
        self.calibrate(top_t, top_c)
        return self.as_float32()

    def _all(self, projected, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.logits(projected, windows[i : i + 4096]) for i in range(0, len(windows), 4096)])

    def calibrate(self, toxic: np.ndarray, clean: np.ndarray) -> None:
        """Logistic regression of the label on a text's greatest logit, lightly held back, by Newton steps."""
        x, y = np.concatenate([toxic, clean]), np.repeat([1.0, 0.0], [len(toxic), len(clean)])
        w = np.array([1.0, 0.0])
        a = np.column_stack([x, np.ones_like(x)])
        for _ in range(50):
            s = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            grad = a.T @ (s - y) + 0.1 * (w - [1, 0])
            hess = (a * (s * (1 - s) + 1e-9)[:, None]).T @ a + 0.1 * np.eye(2)
            w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
        self.slope, self.shift = max(0.05, float(w[0])), float(w[1])


class Scorer:
    """Scores texts, with inputs of the words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self):
        self.number: dict[bytes, int] = {}
        self.size, self.rows = 1, [np.zeros((4096, 3 * HIDDEN), np.float32) for _ in "fb"]
        for own, pad in zip(self.rows, self.net.project(np.zeros((1, INPUT), np.float32))):
            own[0] = pad[0]

    def _meet(self, new: list[bytes]) -> None:
        need = self.size + len(new)
        for i, part in enumerate(self.net.project(self.net.inputs(new))):
            if need > len(self.rows[i]):
                self.rows[i] = np.concatenate([self.rows[i], np.zeros((max(need, 2 * len(self.rows[i])) - len(self.rows[i]), 3 * HIDDEN), np.float32)])
            self.rows[i][self.size : need] = part
        self.number.update(zip(new, range(self.size, need)))
        self.size = need

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.size > KEPT_WORDS:
            self._clear()
        lists = [words(t) for t in texts]
        new = [w for w in {w for t in lists for w in t} if w not in self.number]
        if new:
            self._meet(new)
        get = self.number.__getitem__
        flat = np.fromiter((i for t in lists for i in map(get, t)), np.int32)
        windows, owner, base = [], [], 0
        span = np.arange(WINDOW, dtype=np.int64)
        for i, t in enumerate(lists):
            n = len(t)
            if n < WINDOW:
                windows.append(np.concatenate([flat[base : base + n], np.zeros(WINDOW - n, np.int32)])[None])
                owner.append(np.array([i]))
            else:
                s = np.array(starts(n))
                windows.append(flat[base + s[:, None] + span])
                owner.append(np.full(len(s), i))
            base += n
        windows, owner = np.concatenate(windows), np.concatenate(owner)
        top = np.full(len(texts), -np.inf)
        for lo in range(0, len(windows), 2048):
            np.maximum.at(top, owner[lo : lo + 2048], self.net.logits(self.rows, windows[lo : lo + 2048]))
        return 1 / (1 + np.exp(-np.clip(self.net.slope * top + self.net.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", toxic: int = TOXIC, clean: int = CLEAN) -> Network | None:
    """docs: doc_id, text. labels: doc_id and the label. learn: whether a doc_id's row may be learnt from."""
    marks = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = sampled(marks.where("y = 1"), toxic, "doc_id").unionByName(sampled(marks.where("y = 0"), clean, "doc_id"))
    rows = one_text(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "y").collect()  # toxic + clean rows at most
    texts: dict = {1: {}, 0: {}}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or "")):
        texts[r["y"]].setdefault(r["text"] or "", None)  # copies teach once
    sides = [[words(t) for t in texts[y]] for y in (1, 0)]
    if not all(sides):
        return None
    net = Network().learn(*sides)
    # toxic texts are rarer among labelled rows than in the sample
    every = {r["y"]: r["count"] for r in marks.where("y in (0, 1)").groupBy("y").count().collect()}
    net.shift += math.log(every[1] / every[0]) - math.log(len(sides[0]) / len(sides[1]))
    return net


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 2 MB at any size of input

    def run(batches):
        score = Scorer(shared.value) if shared.value else None
        for b in batches:
            out, some, held = [], [], 0
            for t in b.column(1):
                some.append(t.as_py())
                held += len(some[-1] or "")
                if held > 300_000:
                    out.append(score(some) if score else np.zeros(len(some)))
                    some, held = [], 0
            if some:
                out.append(score(some) if score else np.zeros(len(some)))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out).astype(float))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
