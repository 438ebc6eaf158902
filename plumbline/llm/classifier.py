"""Quality by votes of the nearest labelled documents in a latent-semantic space.

Texts become counts of hashed byte trigrams and a few shares of the text; the
counts of a bounded sample of labelled rows give the latent directions (their
leading singular vectors). The sample's unit vectors are broadcast, every
document's cosine with all of them is computed in blocks, and the labels of
the nearest vote with weights that grow with the cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rows import map_batches, texts, utf8

#: Labelled rows that the model is fitted on and votes with, at most.
MOST_LABELLED = 6000
TRIGRAM_BITS = 11
DIMENSIONS = 64
NEIGHBOURS = 25
#: A neighbour's weight is its cosine to this power.
SHARPNESS = 8
CUTOFF = 0.7
#: How much each share of the text counts beside the trigrams, whose vector has length 1.
SHARE_WEIGHT = 0.7
BLOCK_ROWS = 512

TRIGRAMS = 1 << TRIGRAM_BITS
UPPER, LOWER, DIGIT, SYMBOL, SPACE, REST = range(6)


def _classes() -> np.ndarray:
    kinds = np.full(256, REST, np.uint8)
    for b in range(256):
        c = chr(b)
        if b < 128:
            kinds[b] = UPPER if c.isupper() else LOWER if c.islower() else DIGIT if c.isdigit() else SPACE if c.isspace() else SYMBOL
    return kinds


KINDS = _classes()


def features(texts_utf8: list[bytes]) -> np.ndarray:
    """One row a text: square roots of hashed trigram counts, scaled to length 1, and the shares. An empty text has a row of zeros but one."""
    out = np.zeros((len(texts_utf8), TRIGRAMS + 9), np.float32)
    for row, raw in zip(out, texts_utf8):
        b = np.frombuffer(raw, np.uint8)
        if len(b) >= 3:
            v = b.astype(np.uint32)
            grams = (v[:-2] << 16 | v[1:-1] << 8 | v[2:]) * np.uint32(2654435761) >> np.uint32(32 - TRIGRAM_BITS)
            row[:TRIGRAMS] = np.sqrt(np.bincount(grams, minlength=TRIGRAMS))
            row[:TRIGRAMS] /= np.linalg.norm(row[:TRIGRAMS])
        kinds = np.bincount(KINDS[b], minlength=6) / max(1, len(b))
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        row[TRIGRAMS:] = SHARE_WEIGHT * np.array([
            kinds[UPPER], kinds[DIGIT], 2 * kinds[SYMBOL], kinds[SPACE],
            1 - len(set(words)) / len(words) if words else 0,
            1 - len({*zip(words, words[1:], words[2:])}) / (len(words) - 2) if len(words) > 2 else 0,
            1 - len(set(lines)) / len(lines) if lines else 0,
            len(words) < 50,
            not words,
        ])
    return out


@dataclass
class Voters:
    """The fitted model: its size is bounded by the sample's."""

    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.directions
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours' weights; the prior where no neighbour has a weight."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cosine = self.project(x) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1)
        return np.clip(np.where(total > 0, vote / np.maximum(total, 1e-300), self.prior), 0, 1)


def fit(x: np.ndarray, y: np.ndarray) -> Voters:
    """Leading directions of the sample's feature rows (not centred), and the rows' unit vectors in them."""
    if not len(y):
        return Voters(np.zeros((x.shape[1], 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    _, vectors = np.linalg.eigh(x.T @ x)
    model = Voters(np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32), np.zeros((0, 0), np.float32), y.astype(np.float64), float(y.mean()))
    model.vectors = model.project(x)
    return model


def is_held_out(column: str) -> Column:
    """Rows that no label is learnt from. A null id is not held out, nor learnt from: no label has one."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELLED) -> DataFrame:
    """(text, label) of at most ``most`` documents with labels that are not held out, chosen by hash of the id.

    Null labels, and labels without a document, are left out; of several labels
    of a document the lowest counts, of several texts the first in order.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~is_held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label_col).cast("double").alias("label"))
    )
    # Ids meet before texts are read: as many are chosen as there are documents for.
    chosen = docs.select("doc_id").join(marked, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` rows are broadcast.
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELLED) -> Voters:
    """Fits the model; what reaches the driver is bounded by ``most``."""

    def make():
        def step(batch):
            values, marks = utf8(batch.column("text")), batch.column("label").to_numpy()
            for at in range(0, len(values), BLOCK_ROWS):
                x = features(values[at : at + BLOCK_ROWS]).astype(np.float16)
                yield {"x": pa.array([row.tobytes() for row in x], pa.binary()), "label": pa.array(marks[at : at + BLOCK_ROWS], pa.float64())}

        return step

    rows = map_batches(labelled_sample(docs, labels, label_col, most), make, "x binary, label double").toPandas()
    x = np.frombuffer(b"".join(rows.x), np.float16).reshape(len(rows), TRIGRAMS + 9).astype(np.float32)
    return fit(x, rows.label.to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): how likely label 1 is, for every row of ``docs``.

    Only the text is used. Null and empty texts are scored like any other;
    rows that repeat are scored each, alike; without labels every score is 0.5.
    """
    plain = texts(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(learn(plain, labels, label_col, most))

    def make():
        voters = model.value

        def step(batch):
            ids, values = batch.column("doc_id"), utf8(batch.column("text"))
            score = np.concatenate([voters.score(features(values[at : at + BLOCK_ROWS])) for at in range(0, len(values), BLOCK_ROWS)])
            yield {"doc_id": ids, "score": pa.array(score, pa.float64())}

        return step

    return map_batches(plain, make, "doc_id long, score double")
