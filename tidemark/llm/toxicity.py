"""Toxicity by cumulative-link ordinal regression on sparse text features.

Method: P(grade <= k) = s(t_k - w . x) with one weight vector shared by all ordered thresholds
t_0 < t_1 < ...; x holds, for each distinct word of a text and for its first four, five and six
letters, whether they occur (hashed).  The weights are fitted with an L1 penalty by accelerated
proximal gradient, so few are not zero.  The output is the expected severity, the sum of
P(grade > k), and the most probable grade; a document is toxic from ``cut`` expected severity on.

Fitting uses a bounded sample: the ``sample`` labelled documents that come first in hash order of
their ids.  Everything else runs over all documents, whole texts, in tasks.

Labels may carry any number of ordered grades, and there is one threshold between each two of them;
labels of 0 and 1 give one threshold, and the expected severity is then the chance of being toxic.

Defined cases: null and empty texts have no features and the base rate's severity; null ids are
kept; null labels and labels of unknown documents are left out; without any toxic label nothing is
toxic (severity 0); repeated rows each get their own result row (and count once in the sample); texts
are read whole, and a task holds the distinct words of one; extra columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents fitted on, hashed feature space, least documents and z-score of a feature, penalty, iterations, decision.
SAMPLE, BITS, LEAST_DOCS, LEAST_Z, PENALTY, STEPS, CUT = 8_000, 24, 4, 5.0, 1e-4, 300, 0.4
_STRIP = ".,;:!?\"'()[]{}*$%&#|<>-_/\\"


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of one lower-case word."""
    forms = {"=" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)}
    return tuple(sorted(xxhash.xxh32_intdigest(f) & ((1 << BITS) - 1) for f in forms))


def words_of(text: str | None) -> set[str]:
    return {w.strip(_STRIP) for w in set((text or "").lower().split())} - {""}


def _sample_features(batches):
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            ids = {f for w in words_of(text) for f in word_features(w)}
            out.append(np.array(sorted(ids), "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["id", "grade", "features"])


class OrdinalModel:
    """Sparse weights, thresholds and the fit."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def fit(features: list[np.ndarray], grades: np.ndarray, penalty: float = PENALTY, steps: int = STEPS, least_docs: int = LEAST_DOCS) -> OrdinalModel:
        levels = int(grades.max(initial=0))
        if levels == 0:
            return OrdinalModel({}, [])
        flat = np.concatenate(features) if features else np.empty(0, np.uint32)
        names, codes, docs = np.unique(flat, return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
        # only features that go with a grade: z-score of the documents above grade 0 among those with the feature
        share = (grades > 0).mean()
        z = (np.bincount(codes, grades[rows] > 0, minlength=len(names)) - docs * share) / np.sqrt(docs * share * (1 - share) + 1e-9)
        keep = (docs >= least_docs) & (np.abs(z) >= LEAST_Z)
        index = np.where(keep, np.cumsum(keep) - 1, -1)
        names = names[keep]
        codes = index[codes]
        rows, codes = rows[codes >= 0], codes[codes >= 0]
        n, m = len(features), len(names)
        lengths = np.bincount(rows, minlength=n)
        counts = np.array([(grades <= k).sum() for k in range(levels)])
        theta = np.log((counts + 0.5) / (n - counts + 0.5))
        bounds = np.arange(levels)

        def gradient(w, theta):
            z = np.bincount(rows, w[codes], minlength=n) if m else np.zeros(n)
            cum = 1 / (1 + np.exp(-np.clip(theta[None, :] - z[:, None], -35, 35)))  # P(grade <= k)
            full = np.concatenate([np.zeros((n, 1)), cum, np.ones((n, 1))], axis=1)
            p = np.maximum(full[np.arange(n), grades + 1] - full[np.arange(n), grades], 1e-12)
            slope = np.concatenate([np.zeros((n, 1)), cum * (1 - cum), np.zeros((n, 1))], axis=1)
            upper, lower = slope[np.arange(n), grades + 1] / p, slope[np.arange(n), grades] / p
            dz = (upper - lower) / n  # of the negative log-likelihood by z
            dt = np.array([-(upper[grades == k].sum() - lower[grades == k + 1].sum()) / n for k in bounds])
            return (np.bincount(codes, np.repeat(dz, lengths), minlength=m) if m else np.zeros(0)), dt, -np.log(p).mean()

        w = np.zeros(m)
        at, at_theta, speed, pace = w, theta, 1.0, 1.0
        for _ in range(steps):
            dw, dt, loss = gradient(at, at_theta)
            for _ in range(30):
                new = at - pace * dw
                new = np.sign(new) * np.maximum(np.abs(new) - pace * penalty, 0)
                new_theta = np.maximum.accumulate(at_theta - pace * dt + bounds * 1e-6)
                step, step_theta = new - at, new_theta - at_theta
                bound = loss + dw @ step + dt @ step_theta + (step @ step + step_theta @ step_theta) / (2 * pace)
                if gradient(new, new_theta)[2] <= bound + 1e-12:
                    break
                pace /= 2
            nxt = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
            at, at_theta = new + (speed - 1) / nxt * (new - w), new_theta + (speed - 1) / nxt * (new_theta - theta)
            at_theta = np.maximum.accumulate(at_theta)
            w, theta, speed, pace = new, new_theta, nxt, pace * 1.5
        hit = np.flatnonzero(w)
        return OrdinalModel({int(names[k]): float(w[k]) for k in hit}, theta.tolist())

    def severity(self, features: set[int]) -> tuple[float, int]:
        """Expected severity and most probable grade."""
        if not self.thresholds:
            return 0.0, 0
        z = sum(self.weights.get(f, 0.0) for f in sorted(features))
        above = [1 / (1 + np.exp(np.clip(t - z, -35, 35))) for t in self.thresholds]
        chance = -np.diff([1.0, *above, 0.0])
        return float(sum(above)), int(np.argmax(chance))


def fit_model(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic") -> OrdinalModel:
    """Model of the ``sample`` labelled documents first in hash order of id (a bounded number of rows comes to the driver)."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("long").alias("grade")).where("id is not null and grade is not null")
    chosen = marked.groupBy("id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    found = texts.join(F.broadcast(chosen), "id").select("id", "text", "grade").mapInArrow(_sample_features, "id long, grade long, features binary")
    rows = found.groupBy("id").agg(F.first("grade").alias("grade"), F.min("features").alias("features")).toArrow()
    order = np.argsort(rows.column("id").to_numpy())
    features = [np.frombuffer(rows.column("features")[int(k)].as_py(), "<u4") for k in order]
    grades = rows.column("grade").to_numpy()[order].astype(np.int64) if len(order) else np.zeros(0, np.int64)
    grades = np.maximum(grades, 0)
    return OrdinalModel.fit(features, grades)


def _score(model: OrdinalModel, cut: float):
    def run(batches):
        known: dict[str, tuple[int, ...]] = {}
        base = model.severity(set())
        for batch in batches:
            severities, grades = [], []
            for text in batch.column(1).to_pylist():
                hit: set[int] = set()
                for raw in set((text or "").lower().split()):
                    got = known.get(raw)
                    if got is None:
                        if len(known) > 300_000:
                            known = {}
                        word = raw.strip(_STRIP)
                        got = known[raw] = tuple(f for f in word_features(word) if f in model.weights) if word else ()
                    if got:
                        hit.update(got)
                severity, grade = model.severity(hit) if hit else base
                severities.append(severity)
                grades.append(grade)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severities, pa.float64()), pa.array(grades, pa.int32()), pa.array([s >= cut for s in severities], pa.bool_())], ["id", "severity", "grade", "toxic"])

    return run


def scored(docs: DataFrame, model: OrdinalModel, *, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, severity (expected), grade, toxic, kept (not toxic)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_score(model, cut), "id long, severity double, grade int, toxic boolean")
    return found.select(F.col("id").alias(id_col), "severity", "grade", "toxic", (~F.col("toxic")).alias("kept"))


def toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic") -> DataFrame:
    """The model fitted on the labels and applied to all documents; rows as in ``scored``."""
    model = fit_model(docs, labels, sample=sample, id_col=id_col, text_col=text_col, grade_col=grade_col)
    return scored(docs, model, cut=cut, id_col=id_col, text_col=text_col)
