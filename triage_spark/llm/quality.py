"""Text quality by compression with dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage_spark.llm.common import bounded_sample

CHUNK = 2048  # bytes compressed on their own, so that the dictionary counts all along a long text
DICT_BYTES = 64 << 10
LEVEL = 3


def chunks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


def dictionary(texts: list[str]) -> bytes:
    """A trained zstandard dictionary; with too little text to train on, the text itself (its last bytes)."""
    parts = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICT_BYTES:]


class CompressionClassifier:
    def __init__(self, good: bytes, bad: bytes, slope: float = 1.0, bias: float = 0.0):
        self.good, self.bad, self.slope, self.bias = good, bad, slope, bias
        self._ready: list | None = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def difference(self, text: str | None) -> float:
        """(size with the bad dictionary - size with the good one) / their sum; empty: 0."""
        if self._ready is None:
            self._ready = []
            for d in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(d)
                known.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))
        g = b = 0
        for part in chunks(text or ""):
            g += len(self._ready[0].compress(part))
            b += len(self._ready[1].compress(part))
        return (b - g) / (b + g) if g + b else 0.0

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.bias, -40, 40))))


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the logistic curve of y on x: Newton steps with a light ridge; one class: its share."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 600, calibration: int = 3000, key: str = "doc_id", text: str = "text", label: str = "quality") -> CompressionClassifier:
    """Learn from labelled rows: per_class texts of each label for the dictionaries, `calibration` others for the curve.

    Both numbers bound what the driver holds. The rows are those of least key hash among the labelled ones;
    conflicting labels of one key count by the least. Without labels of both kinds scores are a constant.
    """
    marked = labels.select(key, label).dropna().groupBy(key).agg(F.min(label).alias(label))
    ids = bounded_sample(marked, key, calibration + 2 * per_class)
    scarce = bounded_sample(marked.filter(F.col(label) == 0), key, per_class)
    common = bounded_sample(marked.filter(F.col(label) == 1), key, per_class)
    wanted = ids.unionByName(scarce).unionByName(common).distinct()
    least = docs.select(key, text).join(F.broadcast(wanted), key).groupBy(key, label).agg(F.min(text).alias(text))
    rows = sorted(least.collect(), key=lambda r: r[key])
    train = {r[key] for part in (scarce, common) for r in part.collect()}
    base = {r[key] for r in ids.collect()}
    good = [r[text] or "" for r in rows if r[key] in train and r[label] == 1]
    bad = [r[text] or "" for r in rows if r[key] in train and r[label] == 0]
    if not good or not bad:
        return CompressionClassifier(b"none", b"none", 0.0, 40.0 if good else -40.0 if bad else 0.0)
    model = CompressionClassifier(dictionary(good), dictionary(bad))
    held = [r for r in rows if r[key] in base and r[key] not in train]
    if len({r[label] for r in held}) < 2:
        held = rows  # too few labels to keep some apart
    model.slope, model.bias = platt(np.array([model.difference(r[text]) for r in held]), np.array([float(r[label]) for r in held]))
    return model


def score(docs: DataFrame, model: CompressionClassifier, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1, higher: good likelier) and predicted (1 if score >= threshold) for every whole text.

    A null or empty text scores as a text without any difference. Long texts are compressed chunk by chunk.
    Columns of those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(shared.value.score, na_action=None).astype(float)

    return docs.withColumn("score", ask(F.coalesce(F.col(text), F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
