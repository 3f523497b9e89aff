"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its own vector plus the mean vector of its hashed character trigrams, so unseen and altered words
have an input too. Windows of ``SPAN`` words, each half over the one before, cover the whole text; every
window gets a logit, and the largest, calibrated on documents kept out of the gradient, gives the document's
score. Only the fit uses a bounded sample: at most ``MAX_DOCS`` labelled documents of a class, the ones with the smallest
id hashes, each with its whole text. Labels belong to documents, not to windows: at first, windows
of toxic documents count as toxic where they have words that mark toxic documents beyond chance; after a round,
where the network finds them so. A labelled document without any such window teaches little, as a wrong label would.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import map_batches

SPAN, STRIDE = 32, 16
MAX_DOCS = {0: 3600, 1: 1200}
PAGES = 32
WORDS, TRIGRAMS = 20_000, 1 << 14
WIDTH, HIDDEN, ATTENTION = 12, 8, 8
ROUNDS, BATCH = 3, 256
LEAST_STEPS = 120
SURE = 4.0
UNSEEN = 0.2
_BREAKS = {c: " " for c in range(128) if not chr(c).isalnum()}


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; everything in ASCII that isn't a letter or digit ends a word."""
    return (text or "").lower().translate(_BREAKS).split()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of ``<word>`` for all words, and where each word's begin."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    mixed = (codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)
    ends = np.cumsum(sizes)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = False
    inside[ends - 2] = False
    buckets = (mixed % np.uint32(TRIGRAMS)).astype(np.int64)[inside[:-2]]
    return buckets, np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])


def windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in the texts laid end to end) and sizes of all overlapping windows, text after text."""
    starts, sizes, base = [], [], 0
    for n in lengths:
        last = max(0, -(-(n - SPAN) // STRIDE)) if n else -1
        for i in range(last + 1):
            starts.append(base + i * STRIDE)
            sizes.append(min(SPAN, n - i * STRIDE))
        base += n
    return np.array(starts, np.int64), np.array(sizes, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Weights by name, the known words, and the calibration (slope, offset) of document logits."""

    w: dict[str, np.ndarray]
    known: dict[str, int]
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def inputs(self, words: list[str], unseen: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words, and what the backward pass needs; ``unseen`` words show their characters only."""
        ids = np.array([self.known.get(x, 0) for x in words], np.int64)
        if unseen is not None:
            ids[unseen] = 0
        tri, starts = trigrams(words)
        counts = np.diff(np.append(starts, len(tri)))
        mean = np.add.reduceat(self.w["Ec"][tri], starts, axis=0) / counts[:, None].astype(np.float32)
        return self.w["Ew"][ids] + mean, (ids, tri, counts)

    def _run(self, a: np.ndarray, side: str, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction over ``a(steps, windows, 3 * HIDDEN)``."""
        steps, n, _ = a.shape
        u_w, h = self.w["U" + side], np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            u = h @ u_w
            gates = _sigmoid(a[t, :, :2 * HIDDEN] + u[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[t, :, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
            m = mask[t][:, None]
            new = np.where(m, c + z * (h - c), h)
            if keep is not None:
                keep.append((t, h, u, z, r, c, m))
            h = states[t] = new
        return states

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``at(steps, windows)`` are rows of the word inputs ``x``."""
        both = []
        for side in "fb":
            projected = x @ self.w["W" + side] + self.w["B" + side]
            steps = None if keep is None else keep.setdefault(side, [])
            both.append(self._run(projected[at], side, mask, steps))
        h = np.concatenate(both, axis=2)
        hidden = np.tanh(h @ self.w["Wa"])
        e = np.where(mask, hidden @ self.w["va"], np.float32(-1e9))
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = (alpha[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep.update(h=h, hidden=hidden, alpha=alpha, pooled=pooled)
        return pooled @ self.w["wo"] + self.w["bo"][0]

    def gradients(self, words: list[str], at: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray,
                  unseen: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss."""
        w, keep = self.w, {}
        x, (ids, tri, counts) = self.inputs(words, unseen)
        logits = self.forward(x, at, mask, keep)
        dl = ((_sigmoid(logits) - labels) * weights / max(weights.sum(), 1e-6)).astype(np.float32)
        g = {"wo": keep["pooled"].T @ dl, "bo": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * w["wo"]
        alpha, h, hidden = keep["alpha"], keep["h"], keep["hidden"]
        da = (h * dp[None]).sum(axis=2)
        de = alpha * (da - (alpha * da).sum(axis=0))
        g["va"] = np.tensordot(hidden, de, ((0, 1), (0, 1)))
        dpre = de[:, :, None] * w["va"] * (1 - hidden ** 2)
        g["Wa"] = np.tensordot(h, dpre, ((0, 1), (0, 1)))
        dh_all = alpha[:, :, None] * dp[None] + dpre @ w["Wa"].T
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u_w, dh = w["U" + side], np.zeros((at.shape[1], HIDDEN), np.float32)
            g["U" + side] = np.zeros_like(u_w)
            rows = np.zeros((len(x), 3 * HIDDEN), np.float32)
            out = dh_all[:, :, k * HIDDEN:(k + 1) * HIDDEN]
            for t, before, u, z, r, c, m in reversed(keep[side]):
                dh = dh + out[t]
                live = np.where(m, dh, 0)
                dz = live * (before - c) * z * (1 - z)
                dc = live * (1 - z) * (1 - c ** 2)
                dr = dc * u[:, 2 * HIDDEN:] * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                g["U" + side] += before.T @ du
                np.add.at(rows, at[t], np.concatenate([dz, dr, dc], axis=1))
                dh = live * z + du @ u_w.T + np.where(m, 0, dh)
            g["W" + side], g["B" + side] = x.T @ rows, rows.sum(axis=0)
            dx += rows @ w["W" + side].T
        g["Ew"] = np.zeros_like(w["Ew"])
        np.add.at(g["Ew"], ids, dx)
        g["Ew"][0] = 0
        g["Ec"] = np.zeros_like(w["Ec"])
        np.add.at(g["Ec"], tri, np.repeat(dx / counts[:, None].astype(np.float32), counts, axis=0))
        return g

    def _all_inputs(self, words: list[str], slice_: int = 20_000) -> np.ndarray:
        """``inputs`` of many words, a slice at a time."""
        return np.concatenate([self.inputs(words[i:i + slice_])[0] for i in range(0, len(words), slice_)])

    def logits_at(self, words: list[str], flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """Logits of the windows of texts laid end to end in ``flat``, which numbers ``words``."""
        logits = np.zeros(len(starts), np.float32)
        if len(starts):
            x = self._all_inputs(words)
            for i in range(0, len(starts), chunk):
                logits[i:i + chunk] = self.forward(x, *_dealt(flat, starts[i:i + chunk], sizes[i:i + chunk]))
        return logits

    def window_logits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of tokenised texts, and the text that each window is of."""
        flat, words, starts, sizes, owner = _laid(texts)
        return self.logits_at(words, flat, starts, sizes), owner

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts; a text without words scores 0."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        logits, owner = self.window_logits([words_of(t) for t in texts])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logits)
        return np.where(np.isneginf(best), 0.0, _sigmoid(self.slope * np.where(np.isneginf(best), 0, best) + self.offset))


def _laid(texts) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Tokenised texts end to end as word numbers, the words, and their windows with the texts they are of."""
    index: dict[str, int] = {}
    parts, lengths = [], []
    for t in texts:
        parts.append(np.array([index.setdefault(w, len(index)) for w in t], np.int32))
        lengths.append(len(t))
    flat = np.concatenate([*parts, np.zeros(SPAN, np.int32)])
    starts, sizes = windows(lengths)
    owner = np.repeat(np.arange(len(lengths)), [max(0, -(-(n - SPAN) // STRIDE)) + 1 if n else 0 for n in lengths])
    return flat, list(index), starts, sizes, owner


def _dealt(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(SPAN)[:, None]
    mask = steps < sizes[None, :]
    return np.where(mask, flat[np.minimum(starts[None, :] + steps, len(flat) - 1)], 0), mask


def _fresh(known: dict[str, int], rng: np.random.Generator) -> Network:
    def draw(*shape, scale=None):
        return rng.normal(0, scale or 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    w = {"Ew": draw(len(known) + 1, WIDTH, scale=0.1), "Ec": draw(TRIGRAMS, WIDTH, scale=0.3), "Wa": draw(2 * HIDDEN, ATTENTION),
         "va": draw(ATTENTION), "wo": draw(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
    w["Ew"][0] = 0
    for side in "fb":
        w |= {"W" + side: draw(WIDTH, 3 * HIDDEN), "U" + side: draw(HIDDEN, 3 * HIDDEN), "B" + side: np.zeros(3 * HIDDEN, np.float32)}
    return Network(w, known)


def _calibrate(logits: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by damped Newton steps on smoothed targets, which keep them finite on separable scores."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2)).astype(np.float64)
    centre, spread = float(logits.mean()), float(logits.std()) or 1.0
    x = np.stack([(logits - centre) / spread, np.ones(len(logits))], axis=1).astype(np.float64)

    def loss(theta: np.ndarray) -> float:
        m = x @ theta
        return float((np.logaddexp(0, m) - goal * m).sum() + 5e-4 * theta @ theta)

    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * theta)
        size = 1.0
        while size > 1e-6 and loss(theta - size * move) > loss(theta):
            size /= 2
        theta = theta - size * move
    slope = max(theta[0] / spread, 1e-3)
    return float(slope), float(theta[1] - slope * centre)


def _seeds(y: np.ndarray, fit: np.ndarray, flat: np.ndarray, words: list[str], starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per window, the signed root of the likelihood ratio by which its most telling word marks toxic documents."""
    seen = np.zeros((2, len(words)))
    for doc in np.flatnonzero(fit):
        own = slice(*np.searchsorted(owner, [doc, doc + 1]))
        if own.start < own.stop:
            last = own.stop - 1
            seen[int(y[doc]), np.unique(flat[starts[own.start]:starts[last] + sizes[last]])] += 1
    y = y[fit]
    n = np.array([[(y == 0).sum()], [(y > 0).sum()]], float)
    rate = seen.sum(axis=0) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(seen > 0, seen * np.log(seen / n / rate), 0) + np.where(seen < n, (n - seen) * np.log((1 - seen / n) / (1 - rate)), 0)
    root = np.sqrt(np.maximum(2 * gain.sum(axis=0), 0)) * np.sign(seen[1] / n[1] - seen[0] / n[0])
    telling = root[flat]
    out = np.empty(len(starts))
    for i in range(0, len(starts), 8192):
        steps = starts[i:i + 8192, None] + np.arange(SPAN)[None, :]
        inside = np.arange(SPAN)[None, :] < sizes[i:i + 8192, None]
        out[i:i + 8192] = np.where(inside, telling[np.minimum(steps, len(flat) - 1)], -np.inf).max(axis=1)
    return out


def _drawn(usable: np.ndarray, target: np.ndarray, found: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows for one round: all toxic ones, the tenth of the others that looks most toxic, and a quarter of the rest."""
    toxic, clean = usable[target[usable] > 0], usable[target[usable] == 0]
    clean = clean[np.argsort(-found[clean], kind="stable")]
    hard = len(clean) // 10
    return np.concatenate([toxic, clean[:hard], clean[hard:][rng.random(len(clean) - hard) < 0.25]])


def train(texts: Iterable[str], labels: Iterable[int], seed: int = 11) -> Network:
    """Fit on labelled texts; a constant where a class is missing."""
    return fit(zip(texts, labels), seed)


def fit(rows: Iterable[tuple[str, int]], seed: int = 11) -> Network:
    """``train`` on pairs of text and label, of which one text is held at a time; all of them are kept as word numbers."""
    labels: list[int] = []

    def tokenised():
        for text, label in rows:
            labels.append(label)
            yield words_of(text)

    flat, words, starts, sizes, owner = _laid(tokenised())
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Network({}, {}, constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    counts = Counter()
    for doc in range(len(y)):
        a, b = np.searchsorted(owner, [doc, doc + 1])
        if a < b:
            counts.update(np.unique(flat[starts[a]:starts[b - 1] + sizes[b - 1]]).tolist())
    common = sorted((w for w, c in counts.items() if c >= 4), key=lambda w: (-counts[w], words[w]))[:WORDS]
    net = _fresh({words[w]: i + 1 for i, w in enumerate(common)}, rng)
    aside = np.arange(len(y)) % 5 == 4  # for the calibration
    usable = np.flatnonzero(~aside[owner])
    found = _seeds(y, ~aside, flat, words, starts, sizes, owner) - SURE
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    step = 0
    for round_ in range(ROUNDS):
        if round_:
            found = net.logits_at(words, flat, starts, sizes)
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner, found)
        toxic, sure = y[owner] > 0, found >= 0
        if not (toxic & sure).any():  # nothing stands out: the most toxic window of each
            sure = found >= best[owner]
        target = np.where(toxic & sure, 1.0, 0.0).astype(np.float32)
        weight = np.where(toxic & ~sure, 0.1, 1.0).astype(np.float32)
        used = _drawn(usable, target, found, rng)
        share = [max(1e-6, float(weight[used][target[used] == v].sum())) for v in (0, 1)]
        balanced = weight * np.where(target > 0, share[0] / share[1], 1.0).astype(np.float32)
        order = np.concatenate([rng.permutation(used) for _ in range(-(-LEAST_STEPS * BATCH // max(1, len(used))))])  # few windows are gone over again
        for i in range(0, len(order), BATCH):
            pick = order[i:i + BATCH]
            at, mask = _dealt(flat, starts[pick], sizes[pick])
            rows, local = np.unique(at, return_inverse=True)
            g = net.gradients([words[j] for j in rows], local.reshape(at.shape), mask, target[pick], balanced[pick],
                              rng.random(len(rows)) < UNSEEN)
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.w[k] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
                if k[0] == "E":  # decay keeps rare words and trigrams near nought
                    net.w[k] *= np.float32(1 - 0.002)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, net.logits_at(words, flat, starts, sizes))
    check = aside & np.isfinite(best)
    if not (check & (y > 0)).any() or not (check & (y == 0)).any():
        check = np.isfinite(best)
    net.slope, net.offset = _calibrate(best[check], y[check])
    return net


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_docs: dict[int, int] = MAX_DOCS) -> Iterator[tuple[str, int]]:
    """The sample for the fit, bounded in documents and not in their texts, in a fixed order and one row at a time."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs[v]) for v in (0, 1)]
    ids = picked[0].unionAll(picked[1]).select(F.col("doc_id").alias("id"), "toxic")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("id", "text", "toxic")
    rows = rows.distinct().repartition(PAGES, "id")
    for r in rows.sortWithinPartitions(F.xxhash64(F.lit(5), "id"), "id", "text").toLocalIterator():
        yield r["text"], r["toxic"]


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, held_out, score, predicted``.

    Null and empty texts score 0. Rows with a null id aren't held out nor learned from. Repeated rows each get a row.
    Without labelled documents of both classes, the score is the share of toxic ones among those there are.
    """
    net = fit(sample(docs, labels))

    def run(batch: pa.RecordBatch) -> dict:
        scores = net.scores(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores.astype(np.float64),
                "predicted": (scores >= 0.5).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_batches(rows, run, RESULT)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    net = fit(sample(docs, labels))

    def clean(batches):
        for batch in batches:
            yield batch.filter(pa.array(net.scores(batch.column("text").to_pylist()) < 0.5, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
