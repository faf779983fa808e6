"""Quality scores by compression with dictionaries of good and bad text (operator 5).

Two zstandard dictionaries are trained, on texts labelled 1 and 0.  A text compresses better with the dictionary of the
kind it resembles: with g and b its compressed sizes and n its bytes, (b - g) / n is the normalised difference, and
g / n tells repetition, which either dictionary compresses.  A logistic curve fitted on other labelled rows makes a
probability of label 1 of them.

Fitting takes a bounded sample of labelled rows, chosen by a hash of their ids: ``PER_CLASS`` rows of either label for
the dictionaries and ``CALIBRATION`` rows of any label for the curve, none over ``SAMPLE_BYTES``.  Scoring compresses
every whole text and shuffles nothing.

Defined results: null and empty texts count as the most repetitive text (both terms 0); without rows of both labels
every text scores the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS, CALIBRATION, SAMPLE_BYTES = 2000, 4000, 32_768
DICTIONARY_BYTES, LEVEL = 112 * 1024, 3
GOOD_FROM = 0.3


class Model:
    """Both dictionaries as bytes and the curve; small enough to send with a task."""

    def __init__(self, good: bytes, bad: bytes, share: float):
        self.good, self.bad = good, bad
        self.mean, self.scale = np.zeros(2), np.ones(2)
        # Without a curve, the share of label 1.
        share = min(max(share, 1e-6), 1 - 1e-6)
        self.weights = np.array([0.0, 0.0, np.log(share / (1 - share))])

    def features(self, texts: list[str | None]) -> np.ndarray:
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        packers = []
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=d, **options))
        frame = [len(p.compress(b"")) for p in packers]
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            if text:
                data = text.encode("utf-8", "surrogatepass")
                g, b = (len(p.compress(data)) - f for p, f in zip(packers, frame, strict=True))
                out[i] = (b - g) / len(data), g / len(data)
        return out

    def fit(self, texts: list[str], labels: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        x = self.features(texts)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        a = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        w = np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hessian = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 1e-2 * np.eye(3)
            step = np.linalg.solve(hessian, a.T @ (labels - p) - 1e-2 * w)
            w = w + step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        self.weights = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        a = (self.features(texts) - self.mean) / self.scale if self.good else np.zeros((len(texts), 2))
        return 1 / (1 + np.exp(-np.clip(a @ self.weights[:2] + self.weights[2], -30, 30)))


def _dictionary(texts: list[str]) -> bytes:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, data).as_bytes()
    except zstandard.ZstdError:
        # Too few texts to train on: their plain content primes the compressor.
        return b"\n".join(data)[:DICTIONARY_BYTES].ljust(8, b"\n")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality of 0 or 1); other labels are passed over.

    Of texts that share a doc_id the smallest counts, so the sample is bounded in rows too.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(
        "doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    small = docs.filter(F.col("text").isNotNull() & F.octet_length("text").between(1, SAMPLE_BYTES)).select("doc_id").distinct()
    usable = known.join(small, "doc_id").withColumn("order", F.xxhash64("doc_id", F.lit(5)))
    # The two uses draw from different rows.
    use = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))
    dictionary, calibration = usable.filter(use != 0), usable.filter(use == 0)

    def chosen(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy("order", "doc_id", "quality").limit(n).select("doc_id", "quality")

    spark = docs.sparkSession
    picked = [(r["doc_id"], r["quality"], kind) for kind, rows in (
        ("g", chosen(dictionary.filter("quality = 1"), PER_CLASS)), ("b", chosen(dictionary.filter("quality = 0"), PER_CLASS)),
        ("c", chosen(calibration, CALIBRATION))) for r in rows.collect()]
    if not picked:
        return Model(b"", b"", 0.5)
    sample = spark.createDataFrame(picked, "doc_id long, quality int, kind string")
    # At most 2 * PER_CLASS + CALIBRATION rows.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter(
        F.octet_length("text").between(1, SAMPLE_BYTES)).groupBy("doc_id", "quality", "kind").agg(F.min("text").alias("text")).collect()
    texts.sort(key=lambda r: (r["doc_id"], r["text"]))
    parts = {k: [r["text"] for r in texts if r["kind"] == k] for k in "gbc"}
    rows = [r for r in texts if r["kind"] == "c"] or texts
    found = np.array([r["quality"] for r in rows], dtype=float)
    if not parts["g"] or not parts["b"]:
        return Model(b"", b"", float(np.mean([r["quality"] for r in texts])))
    model = Model(_dictionary(parts["g"]), _dictionary(parts["b"]), float(found.mean()))
    model.fit([r["text"] for r in rows], found)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``GOOD_FROM`` on); columns of these names are replaced."""
    result = docs.drop("score", "predicted").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    text_at = result.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(batch.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(scores, pa.float64()), pa.array((scores >= GOOD_FROM).astype(np.int32))],
                names=batch.schema.names)

    return result.mapInArrow(run, result.schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
