"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import held_out, mix64, spans, text_batches

#: Names of the statistics, in the order of their columns.
FEATURES = ("log_bytes", "log_lines", "word_len", "long_words", "upper", "digit", "symbol", "space_run", "punct", "ascii_letters", "line_upper", "line_symbol", "line_bar", "word_symbol", "word_upper", "repeat_bytes", "short_lines", "vowels", "repeat_words", "repeat_near", "line_repeat")
#: Rows of a class to fit on, at most: those of least hash, alike whatever the input's size.
FIT_ROWS = 20_000
#: Bytes of text to look at together: bounds the memory of a task.
SLICE = 1 << 19

_UP, _LOW, _DIGIT, _SPACE, _PUNCT, _SYMBOL, _HIGH, _CTRL = range(8)
_CLASS = np.full(256, _CTRL, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = _UP
_CLASS[ord("a") : ord("z") + 1] = _LOW
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[32, *range(9, 14)]] = _SPACE
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = _PUNCT
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = _SYMBOL
_CLASS[128:] = _HIGH
_VOWEL = np.zeros(256, np.uint8)
_VOWEL[[ord(c) for c in "aeiouAEIOU"]] = 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text, from slices of whole texts of about SLICE bytes."""
    n, parts, i = len(offsets) - 1, [], 0
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1))
        parts.append(_statistics(data, offsets[i : j + 1]))
        i = j
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text: byte counts and worst lines, on whole texts at once.

    data and offsets are a string column's buffers. Every statistic is a share or a
    logarithm, so documents of any length compare. Empty texts give all zeros.
    """
    n = len(offsets) - 1
    data = data[offsets[0] : offsets[-1]]
    off = offsets - offsets[0]
    size = np.diff(off)
    # A line break after each text keeps lines and words from crossing texts, and texts from being empty.
    doc = np.repeat(np.arange(n), size)
    flat = np.full(len(data) + n, 10, np.uint8)
    flat[np.arange(len(data)) + doc] = data
    start = off[:-1] + np.arange(n)
    kind = _CLASS[flat]
    total = lambda mask, at=start: np.add.reduceat(mask, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    share = lambda a, b: a / np.maximum(b, 1)

    up, low, space, symbol = ((kind == k) for k in (_UP, _LOW, _SPACE, _SYMBOL))
    n_up, n_low, n_symbol, n_high = total(up), total(low), total(symbol), total(kind == _HIGH)
    letters = n_up + n_low + n_high
    # words
    first = ~space
    first[1:] &= space[:-1]
    at = np.flatnonzero(first)
    word_doc = np.searchsorted(start, at, "right") - 1
    per = lambda v: np.bincount(word_doc, v, n)
    n_words = np.bincount(word_doc, minlength=n)
    if len(at):
        length = total(~space, at)
        inside = np.flatnonzero(~space)
        place = (inside - np.repeat(at, length)).astype(np.uint64)
        h = np.add.reduceat((flat[inside].astype(np.uint64) + np.uint64(1)) * mix64(place + np.uint64(1)), np.concatenate([[0], np.cumsum(length)[:-1]]))
        again = np.zeros((2, len(at)), bool)
        again[0, 1:] = (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])
        again[1, 2:] = (h[2:] == h[:-2]) & (word_doc[2:] == word_doc[:-2])
        w_symbol, w_up, w_low = total(symbol, at) > 0, total(up, at), total(low, at)
    else:
        length = w_symbol = w_up = w_low = np.zeros(0, np.int64)
        again = np.zeros((2, 0), bool)
    # lines
    breaks = np.flatnonzero(flat == 10)
    begins = np.concatenate([[0], breaks[:-1] + 1]).astype(np.int64)
    line_doc = np.searchsorted(start, begins, "right") - 1
    if len(begins):
        l_all, l_up, l_low, l_symbol, l_bar = total(~space, begins), total(up, begins), total(low, begins), total(symbol, begins), total(flat == ord("|"), begins)
    else:
        l_all = l_up = l_low = l_symbol = l_bar = np.zeros(0, np.int64)

    def worst(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, line_doc, v)
        return out

    word_line = np.searchsorted(begins, at, "right") - 1
    l_words = np.bincount(word_line, minlength=len(begins))
    l_again = np.bincount(word_line, again[0], len(begins))
    some = np.minimum(l_all / 12.0, 1.0)  # a line of a few bytes says little
    same = np.zeros(len(flat), bool)
    same[1:] = (flat[1:] == flat[:-1]) & ~space[1:] & (kind[1:] != _LOW)
    gap = np.zeros(len(flat), bool)
    gap[1:] = space[1:] & space[:-1]
    gap[start] = False
    lines = np.bincount(line_doc, minlength=n)
    out = np.column_stack([
        np.log1p(size), np.log(np.maximum(lines, 1)), share(per(length), n_words), share(per(length > 14), n_words), share(n_up, letters), share(total(kind == _DIGIT), size), share(n_symbol, size), share(total(gap), size), share(total(kind == _PUNCT), size), share(n_low + n_up, letters),
        worst(share(l_up, l_up + l_low) * some), worst(share(l_symbol, l_all) * some), worst(share(l_bar, l_all) * some), share(per(w_symbol), n_words), share(per((w_up > 1) & (w_low == 0)), n_words), share(total(same), size), share(np.bincount(line_doc, (l_all > 0) & (l_all < 20), n), lines), share(total(_VOWEL[flat]), letters), share(per(again[0]), n_words), share(per(again[1] & ~again[0]), n_words), worst(share(l_again, l_words) * np.minimum(l_words / 6.0, 1.0)),
    ])
    out[size == 0] = 0
    return out


class QDA:
    """Two Gaussians with covariances shrunk towards their pooled and diagonal forms.

    Statistics are transformed by a signed square root or left as logarithms, then
    standardised. Score: logistic of scale * (log density difference + prior), the
    densities from Mahalanobis distances by cached Cholesky factors.
    """

    def __init__(self, mean: np.ndarray, std: np.ndarray, classes: list[tuple[np.ndarray, np.ndarray]], prior: float, scale: float = 1.0, shift: float = 0.0):
        self.mean, self.std, self.prior, self.scale, self.shift = mean, std, prior, scale, shift
        self.classes = classes
        self.parts = []
        for mu, cov in classes:
            chol = np.linalg.cholesky(cov)
            self.parts.append((mu, np.linalg.inv(chol), np.log(np.diag(chol)).sum()))

    @staticmethod
    def transform(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(x, 0))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, shrink: float = 0.1, ridge: float = 1e-2) -> QDA:
        x = cls.transform(x)
        mean, std = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        z = np.clip((x - mean) / std, -8, 8)
        k = z.shape[1] if len(x) else len(FEATURES)
        groups = [z[y == c] if len(x) else np.zeros((0, k)) for c in (0, 1)]
        covs = [np.cov(g.T, bias=True) if len(g) > 1 else np.eye(k) for g in groups]
        sizes = np.array([max(len(g), 1) for g in groups], float)
        pooled = (sizes[0] * covs[0] + sizes[1] * covs[1]) / sizes.sum()
        classes = []
        for g, c in zip(groups, covs, strict=True):
            s = shrink + (1 - shrink) * k / (k + max(len(g), 1))
            m = (1 - s) * c + s * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled)))
            classes.append((g.mean(0) if len(g) else np.zeros(k), m + ridge * np.eye(k)))
        model = cls(mean, std, classes, float(np.log(sizes[1] / sizes[0])) if len(x) else 0.0)
        if len(groups[0]) and len(groups[1]):
            model._calibrate(z, y)
        return model

    def margin(self, z: np.ndarray) -> np.ndarray:
        """Log density difference and prior, drawn together by asinh: tails of Gaussians say too much."""
        ll = [-0.5 * (((z - mu) @ inv.T) ** 2).sum(1) - det for mu, inv, det in self.parts]
        return np.arcsinh(ll[1] - ll[0] + self.prior)

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Platt's scale and shift by damped Newton steps on smoothed targets."""
        m = self.margin(z)
        t = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
        ridge = 1e-3 * len(y)

        def loss(w: np.ndarray) -> float:
            u = w[0] * m + w[1]
            return float((np.logaddexp(0, u) - t * u).sum() + 0.5 * ridge * (w[0] - 1) ** 2)

        w = np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-(w[0] * m + w[1])))
            q = p * (1 - p)
            g = np.array([((p - t) * m).sum() + ridge * (w[0] - 1), (p - t).sum()])
            h = np.array([[(q * m * m).sum() + ridge, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-9]])
            step = np.linalg.solve(h, g)
            rate, now = 1.0, loss(w)
            while rate > 1e-6 and loss(w - rate * step) > now:
                rate /= 2
            w = w - rate * step
            if np.abs(rate * step).max() < 1e-9:
                break
        self.scale, self.shift = max(float(w[0]), 1e-3), float(w[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.transform(x) - self.mean) / self.std, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(z) + self.shift, -40, 40)))

    def to_json(self) -> str:
        return json.dumps({"mean": self.mean.tolist(), "std": self.std.tolist(), "classes": [[m.tolist(), c.tolist()] for m, c in self.classes], "prior": self.prior, "scale": self.scale, "shift": self.shift})

    @classmethod
    def from_json(cls, s: str) -> QDA:
        d = json.loads(s)
        return cls(np.array(d["mean"]), np.array(d["std"]), [(np.array(m), np.array(c)) for m, c in d["classes"]], d["prior"], d["scale"], d["shift"])


def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """Adds the array of FEATURES of each whole text; null texts count as empty. A column of that name is replaced."""
    keep = [c for c in docs.columns if c != name]
    d = docs.select(*keep)
    i = keep.index(text)

    def run(batches):
        for batch in batches:
            x = statistics(*spans(batch.column(i)))
            col = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, col], names=[*keep, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    return text_batches(d).mapInArrow(run, f"{schema}, `{name}` array<double>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, held_mod: int = 4) -> QDA:
    """Fits on labelled rows that are not held out, at most fit_rows of them (of least hash).

    Rows with a null key, a null label or a label but 0 and 1 are left out; a key labelled
    twice counts twice. A key that several documents bear counts by the text of least hash alone, so
    the driver gets fit_rows rows at most. Without rows of a class the densities are standard and scores follow
    the prior.
    """
    y = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").where(~held_out("k", held_mod))
    y = y.orderBy(F.xxhash64("k"), "k", "y").limit(fit_rows)
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(y), "k")  # fit_rows small rows
    d = d.groupBy("k", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = with_statistics(d).select("y", "statistics").toPandas()
    x = np.array(rows["statistics"].tolist(), float).reshape(-1, len(FEATURES))
    return QDA.fit(x, rows["y"].to_numpy(int))


def score(docs: DataFrame, model: QDA, text: str = "text", name: str = "score") -> DataFrame:
    """Adds score, the calibrated probability of label 1, to all columns of docs (one of that name is replaced)."""
    keep = [c for c in docs.columns if c != name]
    d = docs.select(*keep)
    i, packed = keep.index(text), model.to_json()

    def run(batches):
        m = QDA.from_json(packed)
        for batch in batches:
            s = m.score(statistics(*spans(batch.column(i))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*keep, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    return text_batches(d).mapInArrow(run, f"{schema}, `{name}` double")
