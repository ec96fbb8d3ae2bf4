"""Toxicity by a linear-chain conditional random field over words.

Training reads a bounded sample of labelled documents on the driver: at most ``sample`` of each label and
``sample_bytes`` of text together (documented bounds), chosen by hash; a document that would exceed the
bytes is not cut but left out, and of rows with one id one is taken. Documents that mostly repeat another in the sample are left out, so that a copied
text's own words don't pass for toxic. Words that mark toxic documents far more often than clean ones
are the labelled tokens of toxic documents; all tokens of clean ones are labelled clean. The field has
two states, a weight per word and per five-letter beginning, and transition weights; it is fitted by
gradient steps on the exact likelihood.

Scoring computes forward-backward marginals of every word of whole texts. All texts of a batch are
one chain with restarts, walked in lanes: the product of each lane's transfer matrices is found for
all lanes at once, then the lanes are entered with exact messages. A logistic curve over the largest
marginal, their sum and their density turns them into the document's score; runs of words with a
marginal of one half or more are the offending spans (code points).

Labels, language, source and id are no inputs of a score. Defined results: a null text is empty and
gets the score of a text without words; without labelled rows of both kinds every score is the share
of toxic labels (0 without labels); repeated rows each get a row; repeated labels count as toxic if
any is; null labels don't count; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, tidy

WORDS = re.compile(r"\w+")
LANE = 512


def chain_pass(e: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Normalised forward messages of a chain with restarts: m_t = (m_(t-1) T) * e_t, or first * e_t at a start."""
    n = len(e)
    lanes = -(-n // LANE)
    pad = lanes * LANE - n
    e3 = np.concatenate([e, np.ones((pad, 2))]).reshape(lanes, LANE, 2).transpose(1, 2, 0).copy()
    s2 = np.concatenate([starts, np.ones(pad, bool)]).reshape(lanes, LANE).T.copy()
    (a, b), (c, d) = trans
    # products of the lanes' matrices; a start forgets what came before: both rows become first
    p00, p01, p10, p11 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    if lanes > 1:
        for t in range(LANE):
            s, (e0, e1) = s2[t], e3[t]
            n00, n01, n10, n11 = (p00 * a + p01 * c) * e0, (p00 * b + p01 * d) * e1, (p10 * a + p11 * c) * e0, (p10 * b + p11 * d) * e1
            if s.any():
                f0, f1 = first[0] * e0, first[1] * e1
                n00, n10, n01, n11 = np.where(s, f0, n00), np.where(s, f0, n10), np.where(s, f1, n01), np.where(s, f1, n11)
            z = np.maximum(n00 + n01, n10 + n11)
            p00, p01, p10, p11 = n00 / z, n01 / z, n10 / z, n11 / z
    m = np.empty((2, lanes))
    now = first / first.sum()
    for k in range(lanes):
        m[:, k] = now
        now = np.array([now[0] * p00[k] + now[1] * p10[k], now[0] * p01[k] + now[1] * p11[k]])
        now = now / now.sum()
    out = np.empty((LANE, 2, lanes))
    m0, m1 = m
    for t in range(LANE):
        s, (e0, e1) = s2[t], e3[t]
        m0, m1 = np.where(s, first[0], m0 * a + m1 * c) * e0, np.where(s, first[1], m0 * b + m1 * d) * e1
        z = m0 + m1
        m0, m1 = m0 / z, m1 / z
        out[t, 0], out[t, 1] = m0, m1
    return out.transpose(2, 0, 1).reshape(-1, 2)[:n]


def marginals(weights: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state for log odds ``weights`` of the words; also the forward and backward messages."""
    e = np.stack([np.ones(len(weights)), np.exp(np.clip(weights, -30, 30))], axis=1)
    ends = np.append(starts[1:], True)
    forward = chain_pass(e, starts, trans, first)
    backward = chain_pass(e[::-1], ends[::-1], trans.T.copy(), np.ones(2))[::-1]
    both = forward * backward / e
    return both[:, 1] / both.sum(axis=1), forward, backward


class Field:
    """Weights of a fitted chain: small enough to go with the tasks (at most ``most`` words and beginnings)."""

    def __init__(self, words: dict[str, float], heads: dict[str, float], bias: float, trans: np.ndarray, first: np.ndarray):
        self.words, self.heads, self.bias, self.trans, self.first = words, heads, bias, trans, first
        self.curve = np.array([0.0, 0.0, 0.0, 0.0])
        self._known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = word.lower()
        return self.bias + self.words.get(w, 0.0) + self.heads.get(w[:5], 0.0)

    def weights(self, words: list[str]) -> list[float]:
        known, out = self._known, []
        if len(known) > 100_000:
            known.clear()
        for w in words:
            x = known.get(w)
            if x is None:
                x = known[w] = self.weight(w)
            out.append(x)
        return out

    def features(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per text: 1, log odds of the largest marginal, log of 1 + their sum, density; and the marginals."""
        each = [np.array(self.weights(WORDS.findall(t))) for t in texts]
        counts = np.array([len(w) for w in each], np.int64)
        out = np.tile(np.array([1.0, -12.0, 0.0, 0.0]), (len(texts), 1))
        if not counts.any():
            return out, [np.zeros(0)] * len(texts)
        every = np.concatenate(each)
        at = np.concatenate([[0], np.cumsum(counts)])
        starts = np.zeros(len(every), bool)
        starts[at[:-1][counts > 0]] = True
        p, _, _ = marginals(every, starts, self.trans, self.first)
        split = np.split(p, at[1:-1])
        for i, q in enumerate(split):
            if len(q):
                top, total = min(max(float(q.max()), 1e-6), 1 - 1e-6), float(q.sum())
                out[i] = 1.0, max(-12.0, np.log(top / (1 - top))), np.log1p(total), total / len(q)
        return out, split

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve, -30, 30)))


def _spans(text: str, p: np.ndarray) -> str:
    runs: list[list[int]] = []
    last = -2
    for i, m in enumerate(WORDS.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                runs[-1][1] = m.end()
            else:
                runs.append([m.start(), m.end()])
            last = i
    return ",".join(f"{a}:{b}" for a, b in runs)


def distinct_texts(texts: list[str], order: list[int]) -> list[int]:
    """Indices of ``order`` whose sampled eight-word shingles are mostly new."""
    seen: set[int] = set()
    keep = []
    for i in order:
        w = texts[i].split()
        hashes = {xxhash.xxh64_intdigest(" ".join(w[k : k + 8])) for k in range(max(1, len(w) - 7))}
        hashes = {h for h in hashes if h % 4 == 0} or hashes
        if len(hashes & seen) <= 0.3 * len(hashes):
            keep.append(i)
        seen |= hashes
    return keep


def fit(texts: list[str], toxic: list[int], prior: float, ratio: float = 10.0, rounds: int = 40, most: int = 50_000) -> Field:
    """Fits the field and its document curve; ``prior`` is the share of toxic documents among all labelled ones."""
    y = np.array(toxic, bool)
    kept = distinct_texts(texts, sorted(range(len(texts)), key=lambda i: (texts[i], i)))
    df = [Counter(), Counter()]
    for i in kept:
        df[int(y[i])].update({w.lower() for w in WORDS.findall(texts[i])})
    n1, n0 = max(1, sum(bool(y[i]) for i in kept)), max(1, sum(not y[i] for i in kept))
    least = max(5, 0.02 * n1)
    lexicon = {w for w, k in df[1].items() if k >= least and k / n1 >= ratio * (df[0][w] + 0.5) / n0}

    common = [w for w, k in (df[0] + df[1]).most_common(most) if k >= 3]
    word_id = {w: i + 1 for i, w in enumerate(common)}
    head_id: dict[str, int] = {}
    for w in common:
        head_id.setdefault(w[:5], len(head_id) + 1)
    wid, hid, label, starts = [], [], [], []
    for i in kept:
        tokens = [w.lower() for w in WORDS.findall(texts[i])]
        if tokens:
            wid.append(np.array([word_id.get(w, 0) for w in tokens], np.int32))
            hid.append(np.array([head_id.get(w[:5], 0) for w in tokens], np.int32))
            label.append(np.array([bool(y[i]) and w in lexicon for w in tokens]))
            starts.append(np.arange(len(tokens)) == 0)
    field = Field({}, {}, -6.0, np.array([[0.99, 0.01], [0.7, 0.3]]), np.array([0.99, 0.01]))
    if label:
        wid, hid, label, starts = np.concatenate(wid), np.concatenate(hid), np.concatenate(label).astype(np.float32), np.concatenate(starts)
        theta = np.zeros(len(word_id) + len(head_id) + 3)
        nw, total = len(word_id) + 1, len(label)
        theta[-1] = -6.0
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        trans_log = np.log(field.trans)
        follow = ~starts[1:]
        gold = np.zeros((2, 2))
        np.add.at(gold, (label[:-1][follow].astype(int), label[1:][follow].astype(int)), 1)
        for k in range(1, rounds + 1):
            trans = np.exp(trans_log)
            x = theta[wid] * (wid > 0) + theta[nw + hid] * (hid > 0) + theta[-1]
            p, forward, backward = marginals(x, starts, trans, field.first)
            pair = np.zeros((2, 2))
            for a in range(0, total - 1, 65536):
                some = slice(a, min(a + 65536, total - 1))
                both = (forward[:-1][some, :, None] * trans * backward[1:][some, None, :])[follow[some]]
                pair += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            g = np.zeros_like(theta)
            r = p - label
            g[:nw] = np.bincount(wid, r, nw)
            g[nw : len(theta) - 1] = np.bincount(hid, r, len(theta) - 1 - nw)
            g[0] = g[nw] = 0.0
            g[-1] = r.sum()
            g += 0.05 * theta
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            theta -= 0.4 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
            step = (gold - pair) / total
            trans_log += 0.5 * step / (np.abs(step).max() + 1e-9) / k
        field.trans = np.exp(trans_log)
        field.bias = float(theta[-1])
        field.words = {w: float(theta[i]) for w, i in word_id.items() if abs(theta[i]) > 1e-3}
        field.heads = {h: float(theta[nw + i]) for h, i in head_id.items() if abs(theta[nw + i]) > 1e-3}

    f = np.concatenate([field.features([texts[i] for i in kept[k : k + 250]])[0] for k in range(0, len(kept), 250)])
    t = np.array([float(y[i]) for i in kept])
    weight = np.where(t > 0, prior / n1, (1 - prior) / n0) * len(kept)
    curve = np.zeros(4)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(f @ curve, -30, 30)))
        g = f.T @ (weight * (q - t)) + 0.5 * curve * np.array([0, 1, 1, 1])
        h = (f * (weight * q * (1 - q))[:, None]).T @ f + np.diag([1e-6, 0.5, 0.5, 0.5])
        curve = curve - np.linalg.solve(h, g)
    field.curve = curve
    return field


def _score(field: Field, share: float, threshold: float):
    def score(record_batches):
        for batch in record_batches:
            for k in range(0, batch.num_rows, 500):
                f = batch.slice(k, 500)
                texts = [t or "" for t in f.column("text").to_pylist()]
                if field is None:
                    scores, spans = np.full(len(texts), share), [""] * len(texts)
                else:
                    x, p = field.features(texts)
                    scores = field.score(x)
                    spans = [_spans(t, q) if len(q) and q.max() >= 0.5 else "" for t, q in zip(texts, p, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [f.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, pa.string())], ["doc_id", "score", "predicted", "toxic_spans"]
                )

    return score


def _keep(field: Field, share: float, threshold: float):
    def keep(record_batches):
        for batch in record_batches:
            for k in range(0, batch.num_rows, 500):
                f = batch.slice(k, 500)
                texts = [t or "" for t in f.column("text").to_pylist()]
                scores = np.full(len(texts), share) if field is None else field.score(field.features(texts)[0])
                yield f.filter(pa.array(scores < threshold))

    return keep


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 1000, sample_bytes: int = 16_000_000) -> tuple[Field | None, float]:
    """A field from a bounded sample of the documents outside the held-out quarter, and the share of toxic labels."""
    spark = docs.sparkSession
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.where(~held_out(F.col("doc_id")))
    n = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None, n.get(1, 0) / max(1, sum(n.values()))
    share, order = n[1] / (n[0] + n[1]), F.xxhash64(F.col("doc_id"), F.lit(7))
    picked = [r for y in (0, 1) for r in own.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample).collect()]
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # first their sizes, a row per id, then the texts that fit
    what = F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
    sizes = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(what).alias("one")).select("doc_id", "one.*", order.alias("o")).orderBy("o", "doc_id").collect()
    fits, total = [], 0
    for r in sizes:
        if total + r.size <= sample_bytes:
            fits.append((r.doc_id, r.h))
            total += r.size
    wanted = F.broadcast(spark.createDataFrame(fits, "doc_id long, h long"))
    texts = rows.withColumn("h", F.xxhash64("text")).join(wanted, ["doc_id", "h"]).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    toxic = {r.doc_id: r.toxic for r in picked}
    place = {d: i for i, (d, _) in enumerate(fits)}
    texts.sort(key=lambda r: place[r.doc_id])
    labels_ = [toxic[r.doc_id] for r in texts]
    if len(set(labels_)) < 2:
        return None, share
    return fit([r.text for r in texts], labels_, share), share


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 1000, sample_bytes: int = 16_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, toxic_spans."""
    batches(docs.sparkSession)
    field, share = train(docs, labels, sample, sample_bytes)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(_score(field, share, threshold)), "doc_id long, score double, predicted int, toxic_spans string"
    )
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_spans")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 1000, sample_bytes: int = 16_000_000) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    batches(docs.sparkSession)
    field, share = train(docs, labels, sample, sample_bytes)
    return docs.mapInArrow(tidy(_keep(field, share, threshold)), docs.schema)
