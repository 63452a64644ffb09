"""Quality classifier: supervised subword embeddings.

Hashed word, word-pair and character n-gram vectors are averaged over a document, and a softmax layer gives the
class probabilities. Vectors and layer are learned together by numpy stochastic gradient descent on a bounded
sample of labelled documents (``max_rows``). Averaging and the layer are both linear, so for scoring each bucket's
vector is folded into one number, its part in the difference of the two class scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.ngrams import features, grouped
from vesselspark.tables import write_table

BITS = 17
SIZES = (3, 4)
MAX_ROWS = 6000
MAX_CHARS = 16_000_000


@dataclass
class QualityModel:
    """``weights[b]``: what bucket b adds to the log-odds of label 1; a document's score is their mean plus ``bias``."""

    weights: np.ndarray
    bias: float


def _sparse(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: its buckets and their shares of the text's features."""
    for group in grouped(texts):
        kinds = list(features(group, BITS, SIZES))
        bucket = np.concatenate([b for b, _ in kinds]) if kinds else np.empty(0, np.int32)
        owner = np.concatenate([o for _, o in kinds]) if kinds else np.empty(0, np.int64)
        keys, counts = np.unique((owner.astype(np.int64) << BITS) | bucket, return_counts=True)
        cut = np.searchsorted(keys >> BITS, np.arange(len(group) + 1))
        for k in range(len(group)):
            part = slice(cut[k], cut[k + 1])
            yield (keys[part] & (1 << BITS) - 1).astype(np.int32), (counts[part] / max(1, counts[part].sum())).astype(np.float32)


def _sparse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) -> (id, label, chars, bucket, share)."""
    names = ["id", "label", "chars", "bucket", "share"]
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for k, (bucket, share) in enumerate(_sparse(texts)):
            made = [pa.array([len(texts[k] or "")], pa.int64()), pa.array([bucket.tobytes()]), pa.array([share.tobytes()])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *made], names)


def learn(data: list[tuple[int, np.ndarray, np.ndarray]], dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, layer, bias) by stochastic gradient descent on documents as (label, buckets, shares)."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(data)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            label, bucket, share = data[k]
            pace = rate * (1 - done / steps)
            done += 1
            hidden = share @ table[bucket]
            logits = layer @ hidden + bias
            slope = np.exp(logits - logits.max())
            slope /= slope.sum()
            slope[label] -= 1
            back = slope @ layer
            layer -= pace * np.outer(slope, hidden)
            bias -= pace * 0.1 * slope
            # shares are small: their root keeps rare and frequent features moving alike
            table[bucket] -= (pace * 8) * np.sqrt(share)[:, None] * back
    return table, layer, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 17) -> QualityModel:
    """Fit on at most ``max_rows`` labelled rows, the first by a hash of the id, and on no more of these once they have
    ``max_chars`` characters. Rows with a null id, or a label other than 0 and 1, are not used; of documents that share an
    id the least text is. Without a usable row every text scores 0.5."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    chosen = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # at most max_rows ids and labels
    kind = texts.schema["id"].dataType.simpleString()
    rows = write_table(joined.mapInArrow(_sparse_batches, f"id {kind}, label int, chars long, bucket binary, share binary"))
    total, kept = 0, []
    for row in rows.orderBy(F.xxhash64("id"), "id", "label").select("id", "label", "chars").collect():
        if total < max_chars:
            kept.append((row.id, row.label))
        total += row.chars
    if total > max_chars:
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(kept, f"id {kind}, label int")), ["id", "label"])
    data = sorted((r.label, bytes(r.bucket), bytes(r.share)) for r in rows.select("label", "bucket", "share").collect())
    data = [(y, np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for y, b, s in data]
    table, layer, bias = learn(data, dim, epochs, rate, seed)
    return QualityModel((table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(model: QualityModel, texts: list[str | None]) -> np.ndarray:
    parts = []
    for group in grouped(texts):
        total, count = np.zeros(len(group)), np.zeros(len(group))
        for bucket, owner in features(group, BITS, SIZES):
            total += np.bincount(owner, model.weights[bucket], len(group))
            count += np.bincount(owner, minlength=len(group))
        parts.append(1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + model.bias, -60, 60))))
    return np.concatenate(parts) if parts else np.empty(0)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row's whole text: the probability of label 1. Null and empty texts get the score of
    the bias alone; ids are passed through, null or repeated. A text of any length is read whole, in groups of bounded
    size; an empty table gives none. Other columns are not read."""
    fixed = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(fixed.value, batch.column(1).to_pylist()))], ["id", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "id long, score double")
