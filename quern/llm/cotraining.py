"""A quality classifier by co-training of two views.

The text view sees a document's words (hashed, log counts) and rates of symbols, capitals, digits,
repeats and the like. The metadata view sees language, source and length, never the text. Both are
logistic regressions. Labelled rows are split in fitting and held-out ones. In every round each view
scores a pool of unlabelled documents and hands those it is surest of, of both classes in the labels'
proportion, to the other view as labelled; then both are fitted again. At the end each view is
calibrated on half of the held-out rows (Platt), and a logistic regression on the two calibrated
log-odds, fitted on the other half, combines them. All documents are scored.

Fitting takes at most ``max_labelled`` labelled and ``max_pool`` unlabelled documents, the first by
hash of the id; the ids' join is broadcast, as it has that bound. Scoring covers every row and shuffles
nothing.

Defined cases: a null text is empty; null metadata is a value of its own. Labels that are null are left
out; of several labels for an id the mean counts. Without labels of both classes, every score is 1.
Documents of a class too rare to be held out are scored without calibration. Other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import pieces, text_bytes, with_columns

_BUCKETS = 1 << 12
_SYMBOLS, _UPPER, _DIGITS, _MARKS = (re.compile(p) for p in (rb"[#*$%&|<>=_~^\\{}@]+", rb"[A-Z]+", rb"[0-9]+", rb"[.,;:!?'\"()-]+"))
Row = tuple[np.ndarray, np.ndarray]


def text_row(text: bytes) -> Row:
    """Feature places and values of the text view."""
    words = text.split()
    counts = Counter(words)
    n, size = max(1, len(words)), max(1, len(text))
    places = [crc32(w) % _BUCKETS for w in counts]
    values = [math.log1p(c) for c in counts.values()]
    norm = math.sqrt(sum(v * v for v in values)) or 1.0
    rate = lambda p: sum(map(len, p.findall(text))) / size
    lines = text.split(b"\n")
    dense = [
        10 * rate(_SYMBOLS), 5 * rate(_UPPER), 5 * rate(_DIGITS), 10 * rate(_MARKS), 0.1 * (sum(map(len, words)) / n), len(counts) / n, 1 - len(set(lines)) / len(lines),
        max(counts.values(), default=0) / n, 0.2 * math.log1p(n), float(n < 20), float(not words),
    ]
    return np.array(places + list(range(_BUCKETS, _BUCKETS + len(dense))), np.int64), np.array([v / norm for v in values] + dense)


def metadata_row(values: list) -> Row:
    """Feature places and values of the metadata view: categories hashed, numbers by size."""
    places, out = [], []
    for k, v in enumerate(values):
        if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)):
            size = math.log1p(abs(v))
            places += [_BUCKETS + 2 * (k % 8), _BUCKETS + 2 * (k % 8) + 1, crc32(f"{k}~{int(2 * size)}".encode()) % _BUCKETS]
            out += [0.1 * size, 0.01 * size * size, 1.0]
        else:
            places.append(crc32(f"{k}={v}".encode()) % _BUCKETS)
            out.append(1.0)
    return np.array(places, np.int64), np.array(out)


class Logistic:
    """Logistic regression on sparse rows, by Adam with a ridge, then Platt's sigmoid."""

    size = _BUCKETS + 16

    def __init__(self):
        self.w, self.bias, self.slope, self.shift = np.zeros(self.size), 0.0, 1.0, 0.0

    def fit(self, rows: list[Row], y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.1, l2: float = 1e-4) -> Logistic:
        at = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
        place, value = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows])
        w, m1, m2 = np.zeros(self.size + 1), np.zeros(self.size + 1), np.zeros(self.size + 1)
        weight = weight / weight.sum()
        for t in range(1, steps + 1):
            margin = np.bincount(at, w[place] * value, len(rows)) + w[-1]
            slope = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
            g = np.append(np.bincount(place, slope[at] * value, self.size) + l2 * w[:-1], slope.sum())
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        self.w, self.bias = w[:-1], float(w[-1])
        return self

    def margin(self, rows: list[Row]) -> np.ndarray:
        """Log-odds before calibration."""
        return np.array([float(self.w[p] @ v) + self.bias for p, v in rows])

    def calibrate(self, rows: list[Row], y: np.ndarray) -> None:
        self.slope, self.shift = platt(self.margin(rows)[:, None], y)

    def odds(self, rows: list[Row]) -> np.ndarray:
        """Calibrated log-odds."""
        return self.slope * self.margin(rows) + self.shift


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights and, last, bias of a small logistic regression, by Newton's method from weights of 1 / columns."""
    start = np.append(np.full(x.shape[1], 1 / x.shape[1]), 0.0)
    if len(y) < 8 or y.min() == y.max():
        return tuple(map(float, start))
    n1, w, a = y.sum(), start.copy(), np.column_stack([x, np.ones(len(y))])
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w)), a.T @ (t - p) - 0.05 * (w - start))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


class CoTrained:
    """Both views, their combination, and the pseudo-labels handed over in each round."""

    def __init__(self):
        self.views, self.mix, self.handed = None, (0.5, 0.5, 0.0), []

    def fit(self, labelled: list[tuple[Row, Row]], y: np.ndarray, pool: list[tuple[Row, Row]], rounds: int, share: float, sure: float) -> CoTrained:
        """``share`` of the pool may be handed over by a view in a round, if its probability is ``sure``."""
        if len(y) < 8 or y.min() == y.max():
            return self
        fold = np.empty(len(y), np.int64)
        for value in (0, 1):  # both classes in every part: a half for fitting, quarters for calibration and mixing
            own = np.flatnonzero(y == value)
            fold[own] = np.array([0, 1, 0, 2])[np.arange(len(own)) % 4]
        fitting, held, mixing = (np.flatnonzero(fold == k) for k in range(3))
        rows = [([labelled[i][v] for i in fitting], list(y[fitting])) for v in range(2)]
        left: list[set[int]] = [set(range(len(pool))) for _ in range(2)]  # what each view may still be given

        def fitted(v: int) -> Logistic:
            labels = np.array(rows[v][1])
            weight = np.where(np.arange(len(labels)) < len(fitting), 1.0, 0.5)
            return Logistic().fit(rows[v][0], labels, weight)

        for _ in range(rounds):
            views = [fitted(v) for v in range(2)]
            handed = []
            for v in range(2):
                other, ids = 1 - v, sorted(left[1 - v])
                if not ids:
                    handed.append(0)
                    continue
                p = 1 / (1 + np.exp(-np.clip(views[v].margin([pool[i][v] for i in ids]), -30, 30)))
                n = share * len(pool)
                chosen = [(ids[k], 1.0) for k in np.argsort(-p, kind="stable")[: math.ceil(n * y.mean())] if p[k] >= sure]
                chosen += [(ids[k], 0.0) for k in np.argsort(p, kind="stable")[: math.ceil(n * (1 - y.mean()))] if p[k] <= 1 - sure]
                for i, label in chosen:
                    rows[other][0].append(pool[i][other])
                    rows[other][1].append(label)
                    left[other].discard(i)
                handed.append(len(chosen))
            self.handed.append(tuple(handed))
            if not any(handed):
                break
        self.views = [fitted(v) for v in range(2)]
        for v in range(2):
            self.views[v].calibrate([labelled[i][v] for i in held], y[held])
        self.mix = platt(np.column_stack([self.views[v].odds([labelled[i][v] for i in mixing]) for v in range(2)]), y[mixing])
        return self

    def scores(self, rows: list[tuple[Row, Row]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by text, by metadata, and combined."""
        if self.views is None:
            return (np.ones(len(rows)),) * 3
        odds = [self.views[v].odds([r[v] for r in rows]) for v in range(2)]
        return tuple(1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (*odds, self.mix[0] * odds[0] + self.mix[1] * odds[1] + self.mix[2]))


def _rows(part: pa.RecordBatch, text: str, metadata: list[str]) -> list[tuple[Row, Row]]:
    columns = [part.column(c).to_pylist() for c in metadata]
    meta = [list(v) for v in zip(*columns, strict=True)] if columns else [[] for _ in range(part.num_rows)]
    return [(text_row(t), metadata_row(m)) for t, m in zip(text_bytes(part.column(text)), meta, strict=True)]


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("lang", "source", "n_chars"), label_col: str = "quality",
    max_labelled: int = 4000, max_pool: int = 4000, rounds: int = 4, share: float = 0.05, sure: float = 0.95,
) -> CoTrained:
    """Co-train on the labelled rows and a pool of others."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"m{k}") for k, c in enumerate(metadata)])
    names = [f"m{k}" for k in range(len(metadata))]
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("id").agg(F.avg("y").alias("y"))
    by_hash = lambda rows, n: rows.orderBy(F.xxhash64("id"), "id").limit(n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                made = [[x.astype(k).tobytes() for view in row for x, k in zip(view, ("<i4", "<f4"), strict=True)] for row in _rows(part, "text", names)]
                columns = [pa.array([m[j] for m in made], pa.binary()) for j in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), *columns], names=["id", "y", "a", "b", "c", "d"])

    def fetch(ids: DataFrame, limit: int) -> tuple[list[tuple[Row, Row]], np.ndarray]:
        kind = docs.schema["id"].dataType.simpleString()
        found = docs.join(F.broadcast(ids), "id").select("id", "y", "text", *names).mapInArrow(pack, f"id {kind}, y double, a binary, b binary, c binary, d binary")
        got = found.orderBy(F.xxhash64("id"), "id", "a").limit(limit).collect()
        read = lambda p, v: (np.frombuffer(p, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64))
        return [(read(r.a, r.b), read(r.c, r.d)) for r in got], np.array([0.0 if r.y is None else float(r.y >= 0.5) for r in got])

    labelled, y = fetch(by_hash(known, max_labelled), max_labelled)
    if not len(y) or y.min() == y.max():
        return CoTrained()
    others = docs.select("id").join(known.select("id"), "id", "left_anti")
    pool, _ = fetch(by_hash(others.distinct(), max_pool).withColumn("y", F.lit(None).cast("double")), max_pool)
    return CoTrained().fit(labelled, y, pool, rounds, share, sure)


def score_quality(docs: DataFrame, model: CoTrained, text_col: str = "text", metadata: tuple[str, ...] = ("lang", "source", "n_chars"), threshold: float = 0.5) -> DataFrame:
    """``docs`` with p_text, p_metadata, quality_score and keep; these win over columns of the same names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in pieces(batch, text_col):
                by_text, by_meta, both = shared.value.scores(_rows(part, text_col, list(metadata)))
                yield part, {"p_text": by_text.tolist(), "p_metadata": by_meta.tolist(), "quality_score": both.tolist(), "keep": (both >= threshold).tolist()}

    return with_columns(docs, [("p_text", "double"), ("p_metadata", "double"), ("quality_score", "double"), ("keep", "boolean")], run)


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select("doc_id", "text", "lang", "source", "n_chars"), model).select("doc_id", "p_text", "p_metadata", "quality_score", "keep")
