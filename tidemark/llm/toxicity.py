"""Operator 2: toxicity by a string-subsequence-kernel SVM with Nystrom landmarks.

Kernel: Phi(w) counts the subsequences of four characters of a word (with a mark at
its start) that span at most six places, each weighted by ``DECAY`` for a skipped
place; K(a, b) = <Phi(a), Phi(b)> / (n(a) n(b)), where n is a norm that depends on
the length alone.  A word with an inserted character keeps most of its subsequences,
characters that aren't letters or digits are dropped before (``i.d-i*o.t``), and runs
of single letters (``i d i o t``) are read as a word.

Training, on the driver and on a bounded sample of labelled documents of the
learning folds (``MAX_TOXIC`` + ``MAX_CLEAN`` rows, texts of up to
``MAX_TRAIN_BYTES``): documents are cut into sentences; landmarks are words that
cover the discriminative n-grams of toxic documents, and frequent and similar words of
clean ones; a word's features are K_mm^(-1/2) k_m(word).  A sentence is as toxic as
its worst word, so a linear squared-hinge SVM is trained on the witness word of
each sentence, and witnesses are chosen anew (multiple-instance training).  Gapped
variants of witnesses are added as positive examples.

Scoring: as the decision is linear in Phi, landmarks and SVM collapse into one table
of weights by (hashed) subsequence; a batch's distinct words are scored once.  A
document's score is a logistic function, fitted on the same sample, of its three
largest margins, the number of positive ones and its number of words.  Whole texts
are scored; memory is bounded by a batch, and the model (4 MB) is the only broadcast.

Edge cases: null and empty texts have no words and get the score of that; very long
words are read in overlapping pieces; without both labels in the learning folds
every score is the share of toxic rows (0 if there are none); repeated rows get equal
scores, an empty table no rows; extra columns are kept by ``score_toxicity``, but for
those named like the two that it adds, which are put in their place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read, without

MAX_TOXIC, MAX_CLEAN, MAX_TRAIN_BYTES = 1000, 4000, 16_000
LANDMARKS = 64
DECAY = 0.7
THRESHOLD = 0.3
_PIECE = 24
_BITS = 20
_SINGLES = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
_JUNK = re.compile(r"[\W_]+")


class _Codes(dict):
    """Characters as codes 2 to 63; the start of a word is 1."""

    def __missing__(self, key: int) -> int:
        c = chr(key)
        code = 2 + ord(c) - 97 if "a" <= c <= "z" else 28 + ord(c) - 48 if "0" <= c <= "9" else 38 + zlib.crc32(c.encode("utf-8", "surrogatepass")) % 26
        self[key] = code
        return code


_CODES = _Codes()
_OFFSETS = [(a, b, c) for a, b, c in combinations(range(1, 6), 3)]
_PLANS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _plan(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (n, 4) and normalised weights of the subsequences of a word of that length."""
    if length not in _PLANS:
        places = [(i, i + a, i + b, i + c) for i in range(length) for a, b, c in _OFFSETS if i + c < length]
        weights = np.array([DECAY ** (p[3] - p[0] - 3) for p in places], np.float32)
        _PLANS[length] = np.array(places, np.int64).reshape(-1, 4), weights / max(1e-9, float(np.sqrt((weights**2).sum())))
    return _PLANS[length]


def clean(token: str) -> str:
    return _JUNK.sub("", token)


def tokens_of(text: str | None) -> set[str]:
    """The distinct lower-cased tokens of a text, spelled-out words included."""
    low = (text or "").lower()
    tokens = low.split()
    found = set(tokens)
    if sum(len(t) == 1 for t in tokens) >= 3:
        found |= {_JUNK.sub("", m[0]) for m in _SINGLES.finditer(low)}
    return found


def _pieces(word: str) -> list[str]:
    return [word] if len(word) <= _PIECE else [word[i : i + _PIECE] for i in range(0, len(word) - _PIECE // 2, _PIECE // 2)]


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices of words, hashed subsequences, weights) by length of piece; words without a subsequence are left out."""
    by: dict[int, tuple[list[int], list[str]]] = {}
    for i, w in enumerate(words):
        for p in _pieces(w):
            if len(p) >= 3:
                at, texts = by.setdefault(len(p), ([], []))
                at.append(i)
                texts.append(p)
    for length, (at, texts) in by.items():
        flat = np.frombuffer("".join(texts).translate(_CODES).encode("latin-1"), np.uint8).reshape(-1, length).astype(np.uint32)
        flat = np.concatenate([np.ones((len(flat), 1), np.uint32), flat], axis=1)
        places, weights = _plan(length + 1)
        for lo in range(0, len(flat), 20_000):
            part = flat[lo : lo + 20_000]
            code = np.zeros((len(part), len(places)), np.uint32)
            for k in range(4):
                code = code * np.uint32(64) + part[:, places[:, k]]
            yield np.array(at[lo : lo + 20_000]), (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS), weights


class Model:
    """Weights by subsequence, a bias, and the logistic function of a document."""

    def __init__(self, table: np.ndarray, bias: float, logistic: np.ndarray | None, base: float = 0.0):
        self.table, self.bias, self.logistic, self.base = table, bias, logistic, base
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias - 1.0, np.float64)
        out[:] = -2.0
        for at, code, weights in features(words):
            np.maximum.at(out, at, self.table[code] @ weights + self.bias)
        return np.clip(out, -2.0, 2.0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.logistic is None:
            return np.full(len(texts), self.base)
        sets = [tokens_of(t) for t in texts]
        new = sorted(set().union(*sets) - self.cache.keys()) if sets else []
        if len(self.cache) + len(new) > 400_000:
            self.cache.clear()
            new = sorted(set().union(*sets))
        self.cache.update(zip(new, self.margins([clean(w) for w in new]).tolist(), strict=True))
        cache = self.cache
        x = np.array([document_features([cache[w] for w in s]) for s in sets]).reshape(len(sets), -1)
        found = 1 / (1 + np.exp(-np.clip(x @ self.logistic, -30, 30)))
        return np.where([not s for s in sets], self.base, found)


def document_features(margins: list[float]) -> list[float]:
    top = sorted((m for m in margins if m > -0.9), reverse=True)
    head = [*top[:3], -1.0, -1.0, -1.0][:3]
    return [*head, min(8, sum(m > 0 for m in top)), np.log1p(len(margins)), 1.0]


def _svm(x: np.ndarray, y: np.ndarray, c: float, weights: np.ndarray) -> np.ndarray:
    """Squared-hinge SVM by Newton steps; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xs, cs = x[on], (c * weights)[on]
        grad = w - xs.T @ (cs * y[on] * slack[on])
        step = np.linalg.solve(np.eye(len(w)) + (xs * cs[:, None]).T @ xs, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weights * (p - y)) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """K(word, mark), over the subsequences that marks have."""
    rows = [(i, row, weights) for at, code, weights in features(marks) for i, row in zip(at.tolist(), code, strict=True)]
    used = np.unique(np.concatenate([r[1] for r in rows])) if rows else np.zeros(0, np.uint32)
    dense = np.zeros((len(used) + 1, len(marks)), np.float32)
    for i, row, weights in rows:
        np.add.at(dense[:, i], np.searchsorted(used, row) + 1, weights)
    small = np.zeros(1 << _BITS, np.int32)
    small[used] = np.arange(1, len(used) + 1)
    out = np.zeros((len(words), len(marks)), np.float32)
    for at, code, weights in features(words):
        for lo in range(0, len(at), 400):
            np.maximum.at(out, at[lo : lo + 400], np.einsum("ncm,c->nm", dense[small[code[lo : lo + 400]]], weights))
    return out


def _grams(word: str) -> set[str]:
    w = "^" + word[:48]
    return {w[i : i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1)}


def train(texts: list[str], toxic: list[int], base: float | None = None) -> Model:
    """A model; ``base`` is the share of toxic rows where the sample has another."""
    y = np.array(toxic, int)
    base = base if base is not None else float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << _BITS, np.float32), 0.0, None, base)
    # Words are numbers from here on: documents are arrays of arrays of them.
    number: dict[str, int] = {}
    docs = [[np.array([number.setdefault(w, len(number)) for w in map(clean, tokens_of(s)) if w], np.int32) for s in re.split(r"[.!?\n]+(?=\s|$)", t or "")] for t in texts]
    words_of = [np.unique(np.concatenate([np.zeros(0, np.int32), *s])) for s in docs]
    vocabulary = list(number)
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    # Documents of each label that hold a word, and n-grams of words that toxic documents hold.
    in_pos, in_neg = (np.bincount(np.concatenate([np.zeros(0, np.int32), *(w for t, w in zip(y, words_of, strict=True) if t == k)]), minlength=len(number)) for k in (1, 0))
    least = max(3, n_pos // 300)
    # Most n-grams are rare. They are counted by hash first, so that only what can be frequent is held as text.
    hashed = np.zeros(1 << 22, np.uint16)
    for i in np.flatnonzero(y):
        hashed[np.unique(np.fromiter((hash(g) & 0x3FFFFF for w in words_of[i].tolist() for g in _grams(vocabulary[w])), np.int64))] += 1
    pos: dict[str, int] = {}
    for i in np.flatnonzero(y):
        for g in {g for w in words_of[i].tolist() for g in _grams(vocabulary[w]) if hashed[hash(g) & 0x3FFFFF] >= least}:
            pos[g] = pos.get(g, 0) + 1
    del hashed
    pos = {g: p for g, p in pos.items() if p >= least}
    neg = dict.fromkeys(pos, 0)
    for i in np.flatnonzero(y == 0):
        for g in {g for w in words_of[i].tolist() for g in _grams(vocabulary[w]) if g in neg}:
            neg[g] += 1
    odds = {g: np.log((p + 0.5) / (n_pos + 1)) - np.log((neg[g] + 0.5) / (n_neg + 1)) for g, p in pos.items()}
    strong = {g for g, o in odds.items() if o > 1.8}
    del pos, neg
    hold: dict[str, set[int]] = {g: set() for g in strong}
    carrier: dict[str, dict[str, int]] = {g: {} for g in strong}
    for i in np.flatnonzero(y).tolist():
        for k in words_of[i].tolist():
            w = vocabulary[k]
            for g in _grams(w) & strong:
                hold[g].add(i)
                carrier[g][w] = carrier[g].get(w, 0) + 1
    marks: list[str] = []
    open_ = {i for i in range(len(y)) if y[i]}
    left = dict(hold)
    while left and len(marks) < LANDMARKS:
        g = max(left, key=lambda x: (len(left[x] & open_) * odds[x], odds[x], x))
        gain = len(left.pop(g) & open_)
        if gain < 2:
            if open_ == (full := {i for i in range(len(y)) if y[i]}) or not marks:
                break
            open_ = full  # another landmark for documents that have one already
            if len(marks) >= LANDMARKS // 2:
                break
            continue
        for w in sorted(carrier[g], key=lambda w: (-carrier[g][w], len(w), w))[:2]:
            if w not in marks:
                marks.append(w)
        open_ -= hold[g]
    if not marks:
        marks = [vocabulary[i] for i in sorted(np.flatnonzero(in_pos).tolist(), key=lambda i: (-in_pos[i], vocabulary[i]))[:8]]
    del carrier
    near = np.concatenate([_kernel(vocabulary[i : i + 20_000], marks).max(axis=1) for i in range(0, len(vocabulary), 20_000)])
    # Of clean documents, the words most like a landmark, and the most frequent.
    for rank in (near * np.minimum(3, in_neg), in_neg):
        best = sorted(np.argpartition(-rank, min(len(rank) - 1, LANDMARKS))[:LANDMARKS].tolist(), key=lambda i: (-rank[i], vocabulary[i]))
        marks += [vocabulary[i] for i in best[: LANDMARKS // 2] if in_neg[i]]
    marks = list(dict.fromkeys(marks))
    kmm = _kernel(marks, marks).astype(float)
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def mapped(words: list[str]) -> np.ndarray:
        return np.concatenate([_kernel(words, marks) @ root, np.ones((len(words), 1))], axis=1)

    def collapsed(w: np.ndarray) -> Model:
        alpha, table = root @ w[:-1], np.zeros(1 << _BITS, np.float32)
        for at, code, weights in features(marks):
            for i, row in zip(at, code, strict=True):
                np.add.at(table, row, (alpha[i] * weights).astype(np.float32))
        return Model(table, float(w[-1]), np.zeros(6))

    margin = np.array([max((odds[g] for g in _grams(w) & strong), default=0.0) for w in vocabulary])
    margin = np.minimum(margin / 3, 1.5) - 1
    model = None
    for _ in range(4):
        up: dict[int, int] = {}
        down: dict[int, int] = {}
        for t, sentences in zip(y, docs, strict=True):
            best = [(margin[s[k := int(np.argmax(margin[s]))]], int(s[k])) for s in sentences if len(s)]
            if t and best:
                best = [b for b in best if b[0] > 0] or ([max(best)] if model is None else [])
            for _, i in best:
                into = up if t else down
                into[i] = into.get(i, 0) + 1
        if not up or not down:
            break
        long = [vocabulary[i] for i in sorted(up) if 4 < len(vocabulary[i]) < _PIECE][:400]
        variants = sorted({v[:k] + "xq7"[k % 3] + v[k:] for v in long for k in range(2, len(v), 2)})
        x = mapped([vocabulary[i] for i in [*up, *down]] + variants)
        t = np.concatenate([np.ones(len(up)), -np.ones(len(down)), np.ones(len(variants))])
        many = np.concatenate([np.minimum(20, np.array([*up.values(), *down.values()], float)), np.full(len(variants), 1.0)])
        many[t > 0] *= min(1.0, many[t < 0].sum() / many[t > 0].sum())
        model = collapsed(_svm(x, t, 2.0, many))
        margin = model.margins(vocabulary)
    if model is None:
        return Model(np.zeros(1 << _BITS, np.float32), 0.0, None, base)
    x = np.array([document_features(margin[ws].tolist()) for ws in words_of])
    model.base, weights = base, np.where(y == 1, base / y.mean(), (1 - base) / (1 - y.mean()))
    model.logistic = _logistic(x, y.astype(float), weights)
    return model


def held_out(doc_id="doc_id"):
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled rows outside the held-out fold."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # At most MAX_TOXIC + MAX_CLEAN ids are broadcast, and as many texts of at most MAX_TRAIN_BYTES come back: of rows that share an id, the least text.
    sample = rows.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionAll(rows.where("toxic != 1").orderBy(*order).limit(MAX_CLEAN))
    found = docs.select("doc_id", "text").where(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    base = rows.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    got = sorted(zip(*(c.to_pylist() for c in found.toArrow().columns), strict=True), key=lambda r: (str(r[0]), r[1]))
    return train([r[1] for r in got], [int(r[2] == 1) for r in got], base)


def score_toxicity(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs``, score and predicted. No shuffle."""
    docs = without(docs, *names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        own = shared.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for lo in range(0, batch.num_rows, 500):
                scores[lo : lo + 500] = own.score(batch.column(at).slice(lo, 500).to_pylist())
            yield [*batch.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]

    return map_rows(docs, run, dict(zip(names, ("double", "int"), strict=True)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the learning folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
