"""Quality scores by compression against two dictionaries.

A zstandard dictionary is built from good and one from bad labelled text. A whole
text is cut into blocks of ``BLOCK`` bytes; the blocks' sizes compressed with either
dictionary are summed, and their difference, normalised by the text's own size, says
which class the text is closer to. A logistic curve of this one number, fitted on
labelled texts that the dictionaries have not seen, turns it into a calibrated
probability of being good.

The fit uses a bounded sample: at most ``per_class`` labelled documents of each class,
taken in the order of a hash of their id while their texts together are at most
``class_bytes`` (a text that does not fit any more is passed over). Every document is
scored, over its whole text, a block at a time. Label, language, source and id never
enter a score.

Empty and null texts score ``EMPTY_SCORE``. Documents without label, with a null label
or with conflicting labels (the majority counts, good on a tie) never stop the fit;
if one class has no labelled text, every score is the share of good labels (1 if
there are none). Repeated rows are scored alike; an empty table gives no rows; extra
columns pass, but columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Bytes that are compressed at once, and of one piece that a dictionary is trained on.
BLOCK = 512
LEVEL = 3
EMPTY_SCORE = 0.5
DICTIONARY_BYTES = 112 << 10
#: Keeps the weights near 1, so that the ridge hardly binds them.
SCALE = 10.0


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the weights of the logistic curve."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


class Compressed:
    """Compressed sizes of texts with either dictionary of a model."""

    def __init__(self, good: bytes, bad: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.each = []
        for content in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(dict_data=dictionary, **options))

    def difference(self, text: str) -> float:
        """How much smaller the text gets with the good dictionary than with the bad one, a byte of it."""
        data = text.encode("utf-8", "replace")
        good, bad = (sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in self.each)
        return (bad - good) / len(data)


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train, the text itself."""
    blocks = [s[i : i + BLOCK] for s in samples for i in range(0, len(s), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1]), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(good: list[str], bad: list[str]) -> Model:
    """Dictionaries from the first half of each class, the curve from the other half."""
    good, bad = [t for t in good if t], [t for t in bad if t]
    if not good or not bad:
        share = (len(good) + 0.5) / (len(good) + len(bad) + 0.5) if good or bad else 1.0
        return Model(b"", b"", (float(np.log(share / max(1e-9, 1 - share))),))
    halves = [(c[: (len(c) + 1) // 2], c[(len(c) + 1) // 2 :] or c) for c in (good, bad)]
    dictionaries = [dictionary_of([t.encode("utf-8", "replace") for t in c]) for c, _ in halves]
    sizes = Compressed(*dictionaries)
    x = np.array([(1.0, SCALE * sizes.difference(t)) for _, c in halves for t in c])
    y = np.array([label for label, (_, c) in zip((1.0, 0.0), halves, strict=True) for _ in c])
    return Model(*dictionaries, tuple(logistic(x, y).tolist()))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2000, class_bytes: int = 16 << 20) -> Model:
    """Fit on a bounded sample of the labelled documents for which ``learn`` holds.

    The curve is shifted from the sample's share of good labels to that of all labels,
    which keeps it calibrated. The driver holds at most ``2 * per_class`` ids and
    ``2 * class_bytes`` bytes of text.
    """
    voted = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    # At most 2 x per_class ids: small whatever the size of the tables.
    chosen = voted.where("good").orderBy(*order).limit(per_class).unionByName(voted.where("NOT good").orderBy(*order).limit(per_class))
    found = docs.select("doc_id", "text").where("text IS NOT NULL AND text <> ''").join(F.broadcast(chosen), "doc_id")
    sizes = found.groupBy("doc_id", "good").agg(F.max(F.octet_length("text")).alias("n"), F.min(F.xxhash64("doc_id")).alias("place")).collect()
    left, taken = {True: class_bytes, False: class_bytes}, []
    for r in sorted(sizes, key=lambda r: (r["place"], r["doc_id"])):
        if r["n"] <= left[r["good"]]:
            left[r["good"]] -= r["n"]
            taken.append((r["doc_id"], r["good"]))
    if not taken:
        return fit([], [])
    ids = docs.sparkSession.createDataFrame(taken, "doc_id long, good boolean")
    rows = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text")).collect()
    text_of = {r["doc_id"]: r["text"] for r in rows}
    model = fit([text_of[d] for d, good in taken if good], [text_of[d] for d, good in taken if not good])
    n = {r["good"]: r["count"] for r in voted.groupBy("good").count().collect()}
    if len(model.weights) == 1 or len(n) < 2:
        return model
    sampled = sum(good for _, good in taken)
    shift = np.log(n[True] / n[False]) - np.log(sampled / (len(taken) - sampled))
    return replace(model, weights=(model.weights[0] + float(shift), *model.weights[1:]))


def scorer(spark: SparkSession, model: Model):
    """A column function from text to score."""
    held = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        w = np.array(m.weights)
        sizes = Compressed(m.good, m.bad) if len(w) > 1 else None

        def one(text: str | None) -> float:
            if not text:
                return EMPTY_SCORE
            z = float(w[0] + w[1] * SCALE * sizes.difference(text)) if sizes else float(w[0])
            return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return score


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    return docs.withColumn("score", scorer(docs.sparkSession, model)(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
