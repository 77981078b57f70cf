"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are the words of a text, and how it is written: runs of character classes (case, digits, white space, each sign) up to four long, how much of it repeats, how
long it is. Their TF-IDF matrix over labelled documents gives the latent space by its singular vectors; the model with the labelled vectors is broadcast, every
document's cosines to all of them are exact, computed in blocks, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.llm.common import SAMPLE_CHARS, RollingHash, held_out, mix64, read_table, sample_texts, text_blocks, word_bounds

LABELLED_ROWS = 2000
NEIGHBOURS = 15
LATENT = 64
THRESHOLD = 0.7
_TERMS = 2048
_EXTRA = 64
_WORDS = 2048
#: Part of the words in a text's squared length; the rest is how it is written.
WORD_SHARE = 0.25
_ORDERS = 4
#: Texts in a block: the counts of a block take 4,160 floats a text.
_BLOCK_ROWS = 1024


def _classes() -> np.ndarray:
    """Class of a byte: 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end; other signs keep classes of their own."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 1, 2, 3
    table[[9, 11, 12, 32]], table[[10, 13]], table[0x80:] = 4, 5, 1
    return table


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.isin(_CLASS, (4, 5))
_LETTER = np.isin(_CLASS, (1, 2, 3))


def term_counts(texts: list[str | None]) -> np.ndarray:
    """A row for each text: how often it has each hashed run of classes, 64 columns of steps of repetition and of length, and how often it has each hashed word (letters
    and digits, A-Z as a-z). Null counts as empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    out = np.zeros((len(texts), _TERMS + _EXTRA + _WORDS), np.float32)

    kind = _CLASS[data].astype(np.uint64)
    # the upper-case letters of Latin-1 are C3 80 to C3 9E
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] < 0x9F))
    kind[lead], kind[lead + 1] = 2, 2
    text = np.repeat(np.arange(len(texts)), sizes)
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] > 5) | (text[1:] != text[:-1])
    kind, text = kind[new], text[new]
    code = np.zeros(len(kind), np.uint64)
    for order in range(_ORDERS):
        n = len(kind) - order
        code = code[:n] * np.uint64(257) + kind[order:]
        same = text[:n] == text[order:]
        term = (mix64(code + np.uint64(order << 40)) % np.uint64(_TERMS)).astype(np.int64)
        out[:, :_TERMS] += np.bincount((text[:n] * _TERMS + term)[same], minlength=len(texts) * _TERMS).reshape(len(texts), _TERMS)

    start, end = word_bounds(~_BLANK[data] & (data != 0))
    of = np.searchsorted(ends, start, side="right")
    hashes = RollingHash(_LOWER[data])
    word = hashes.of(start, end)
    words = np.bincount(of, minlength=len(texts))
    for k, gap in enumerate((1, 2)):  # pairs of neighbours, and of next neighbours, that the text has had before
        pair, at = mix64(word[:-gap] * np.uint64(3) + word[gap:]), of[:-gap]
        pair, at = pair[at == of[gap:]], at[at == of[gap:]]
        order = np.lexsort((pair, at))
        pair, at = pair[order], at[order]
        old = np.zeros(len(pair), bool)
        old[1:] = (pair[1:] == pair[:-1]) & (at[1:] == at[:-1])
        share = np.bincount(at, weights=old, minlength=len(texts)) / np.maximum(1, np.bincount(at, minlength=len(texts)))
        total = out[:, :_TERMS].sum(1)
        out[np.arange(len(texts)), _TERMS + 16 * k + np.minimum(15, (share * 16).astype(int))] = total / 8 + 1
    out[np.arange(len(texts)), _TERMS + 32 + np.minimum(31, 2 * np.log2(words + 1)).astype(int)] = out[:, :_TERMS].sum(1) / 64 + 1

    start, end = word_bounds(_LETTER[data])
    of, term = np.searchsorted(ends, start, side="right"), (mix64(hashes.of(start, end)) % np.uint64(_WORDS)).astype(np.int64)
    out[:, _TERMS + _EXTRA :] = np.bincount(of * _WORDS + term, minlength=len(texts) * _WORDS).reshape(len(texts), _WORDS)
    return out


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (a text without words: shorter): both kinds of terms by the root of their frequency and by idf, each scaled to its part."""
    style = _TERMS + _EXTRA
    for part, share in ((slice(0, style), 1 - WORD_SHARE), (slice(style, None), WORD_SHARE)):
        x[:, part] = np.sqrt(x[:, part]) * idf[part]
        x[:, part] *= np.sqrt(share) / np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-12)
    return x


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, texts: list[str | None]) -> np.ndarray:
        z = _weighted(term_counts(texts), self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of the nearest neighbours' weight that lies on label 1; the labels' mean if no neighbour is similar at all."""
        cosine = self.latent(texts) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0).astype(np.float64) ** 4
        total = weight.sum(1)
        return np.clip(np.where(total > 0, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-300), self.labels.mean()), 0, 1)


def fitted(texts: list[str], labels: list[int], latent: int = LATENT) -> Model | None:
    """The latent axes are the first right singular vectors of the labelled texts' term matrix, taken from the products of its rows: there are fewer texts than terms."""
    if not texts:
        return None
    x = np.concatenate([term_counts(texts[lo:hi]) for lo, hi in text_blocks(texts, rows=_BLOCK_ROWS)])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x = _weighted(x, idf)
    power, rows = np.linalg.eigh((x @ x.T).astype(np.float64))
    power, rows = power[::-1][:latent], rows[:, ::-1][:, :latent]
    real = power > 1e-6 * power[0]
    axes = (x.T @ rows[:, real]) / np.sqrt(power[real])
    model = Model(idf, axes.astype(np.float32), np.zeros((0, 0)), np.asarray(labels, np.float64))
    model.vectors = np.concatenate([model.latent(texts[lo:hi]) for lo, hi in text_blocks(texts, rows=_BLOCK_ROWS)]).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, most_chars: int = SAMPLE_CHARS) -> Model | None:
    """Learns from at most ``most`` labelled ids by hash of the id, never a held-out one, and ``most_chars`` characters. Of labels that disagree on an id the smaller
    counts, and of its texts one."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = {r["doc_id"]: r["quality"] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}
    rows = sorted(sample_texts(docs, list(marks), most_chars))
    return fitted([t for _, t in rows], [int(marks[i] == 1) for i, _ in rows])


def scored(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; nothing but the text enters a score.

    Null and empty texts are scored by their terms of length and repetition; null ids and repeated rows are rows like others (a null id is not held out: it has no
    remainder, so held_out is null). Without any labelled row scores are 0.5. An empty table gives no rows. A narrow step in blocks of whole texts. The model is
    broadcast: 4,160 rows of axes and as many vectors as labelled rows, ``LABELLED_ROWS`` at most unless ``train`` is told otherwise, each of ``LATENT`` numbers: 2 MB.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in text_blocks(texts, rows=_BLOCK_ROWS):
                score = model.scores(texts[lo:hi]) if model else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(score.astype(np.float64))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_lsa_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, train(docs, read_table(spark, sf_dir, "labels")))
