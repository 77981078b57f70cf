"""Language identification of words and documents by a linear-chain conditional random field.

Each word has a score for each language from its affixes, its byte trigrams and a hashed lexicon of whole words; learned transitions tie neighbours. Forward-backward
gives the probability of every language at every word of code-switched text; a document has the language with the highest mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cerulea.llm.common import SAMPLE_CHARS, RollingHash, held_out, read_table, sample_texts, text_blocks, word_bounds

ROWS_PER_LANGUAGE = 150
MOST_LANGUAGES = 200
EPOCHS = 12
SPAN = 20
SEQUENCE = 100
PIECE = 64
#: Languages up to which chains are cut into pieces.
FEW = 16
UNKNOWN = "und"
_SIZES = {"trigram": 1 << 15, "affix": 1 << 14, "lexicon": 1 << 16}
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[0x80:] = True


@dataclass
class Words:
    """Words of some texts: the text each belongs to, and its features as indices into the weight tables; trigrams lie one after the other."""

    text: np.ndarray
    trigram: np.ndarray
    begin: np.ndarray
    affix: np.ndarray
    lexicon: np.ndarray


def features(texts: list[str | None]) -> Words:
    """A word is a run of letters of lower-cased text, as bytes: a-z and everything outside ASCII."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b"    ", np.uint8)
    inside = _IN_WORD[data]
    data = np.where(inside, data, np.uint8(0x20))
    start, end = word_bounds(inside)
    text = np.searchsorted(np.cumsum([1, *(len(r) + 1 for r in raw)]), start, side="right") - 1
    code = data.astype(np.uint32)
    three = (code[:-2] << np.uint32(16)) | (code[1:-1] << np.uint32(8)) | code[2:]
    at = np.flatnonzero(inside[1:-1])
    index = lambda x, n, salt: ((x * np.uint32(0x9E3779B1) + np.uint32(salt)) ^ (x >> np.uint32(7))) & np.uint32(n - 1)
    length = end - start
    affix = np.stack([index(three[start], _SIZES["affix"] // 2, 1), index(three[np.maximum(end - 3, 0)], _SIZES["affix"] // 2, 2) + np.uint32(_SIZES["affix"] // 2)], 1)
    lexicon = (RollingHash(data).of(start, end) & np.uint64(_SIZES["lexicon"] - 1)).astype(np.uint32)
    return Words(text, index(three[at], _SIZES["trigram"], 0), np.cumsum(length) - length, affix, lexicon)


@dataclass
class Model:
    languages: list[str]
    trigram: np.ndarray
    affix: np.ndarray
    lexicon: np.ndarray
    transition: np.ndarray

    def potentials(self, w: Words) -> np.ndarray:
        """exp of each word's scores, the largest of a word being 1."""
        scores = np.add.reduceat(self.trigram[w.trigram], w.begin, axis=0) + self.affix[w.affix].sum(1) + self.lexicon[w.lexicon]
        return np.exp(scores - scores.max(1, keepdims=True))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def forward_backward(emit: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward messages, and the probability of each language, at each word, for chains that begin at ``first``; exact, for chains of any length.

    Chains are cut into pieces of 64 words. The product of a piece's transfer matrices carries messages across it, so all pieces advance together. Such a product takes
    the cube of the number of languages a word and a piece holds their square, so beyond ``FEW`` languages chains stay whole and advance side by side.
    """
    n, k = emit.shape
    count = np.diff(np.append(first, n))
    piece = PIECE if k <= FEW else int(count.max(initial=1))
    pieces = -(-count // piece)
    chain = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[chain] + nth * piece
    length = np.minimum(piece, count[chain] - nth * piece)
    if pieces.max(initial=0) > 1:
        across = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
        for t in range(piece):
            on = np.flatnonzero(length > t)
            if not len(on):
                break
            moved = (across[on] @ step) * emit[begin[on] + t][:, None, :]
            across[on] = moved / moved.sum((1, 2), keepdims=True)
    ahead, behind = np.full((len(chain), k), 1 / k), np.full((len(chain), k), 1 / k)
    for j in range(1, int(pieces.max(initial=0))):
        p = np.flatnonzero(nth == j)
        ahead[p] = _unit((ahead[p - 1][:, None, :] @ across[p - 1])[:, 0])
    for j in range(int(pieces.max(initial=0)) - 1, 0, -1):
        p = np.flatnonzero(nth == j)
        behind[p - 1] = _unit((across[p] @ behind[p][:, :, None])[:, :, 0])
    out = np.empty_like(emit)
    for t in range(piece):
        on = np.flatnonzero(length > t)
        if not len(on):
            break
        ahead[on] = out[begin[on] + t] = _unit((ahead[on] @ step) * emit[begin[on] + t])
    forward = out.copy()
    for t in range(piece - 1, -1, -1):
        on = np.flatnonzero(length > t)
        at = begin[on] + t
        out[at] *= behind[on]
        behind[on] = _unit((behind[on] * emit[at]) @ step.T)
    return forward, _unit(out)


def fitted(texts: list[str], labels: list[str], epochs: int = EPOCHS) -> Model | None:
    """The field that maximises the likelihood of the words' languages, by adaptive gradient steps.

    Code-switched text is made from the documents: spans of 20 words of different documents are strung together in sequences of 100, so transitions are learned too.
    """
    languages = sorted(set(labels))
    w = features(texts)
    if not len(w.text):
        return None
    k, rng = len(languages), np.random.default_rng(3)
    truth = np.array([languages.index(x) for x in labels])[w.text]
    spans = np.arange(-(-len(truth) // SPAN))
    rng.shuffle(spans)
    order = (spans[:, None] * SPAN + np.arange(SPAN)).ravel()
    order = order[order < len(truth)]
    first, back = np.arange(0, len(order), SEQUENCE), np.argsort(order)
    word = np.repeat(np.arange(len(truth)), np.diff(np.append(w.begin, len(w.trigram))))
    parts = {"trigram": (w.trigram, word), "affix": (w.affix.ravel(), np.repeat(np.arange(len(truth)), 2)), "lexicon": (w.lexicon, np.arange(len(truth)))}
    model = Model(languages, *(np.zeros((n, k), np.float64) for n in _SIZES.values()), np.zeros((k, k)))
    seen = {name: np.full(getattr(model, name).shape, 1e-6) for name in (*parts, "transition")}
    pairs = np.flatnonzero(np.arange(1, len(order)) % SEQUENCE != 0)
    observed = np.bincount(truth[order][pairs] * k + truth[order][pairs + 1], minlength=k * k).reshape(k, k)
    for _ in range(epochs):
        emit, step = model.potentials(w)[order], np.exp(model.transition)
        forward, p = forward_backward(emit, step, first)
        # a pair of neighbours is i, j with probability forward(i) step(i, j) p(j) / sum over i of forward(i) step(i, j)
        expected = step * (forward[pairs].T @ (p[pairs + 1] / (forward[pairs] @ step)))
        error = np.eye(k)[truth] - p[back]
        grads = {name: np.stack([np.bincount(at, weights=error[of, c], minlength=_SIZES[name]) for c in range(k)], 1) for name, (at, of) in parts.items()} | {"transition": observed - expected}
        for name, g in grads.items():
            seen[name] += g * g
            setattr(model, name, getattr(model, name) + 0.5 * g / np.sqrt(seen[name]))
    for name in parts:
        setattr(model, name, getattr(model, name).astype(np.float32))
    return model


def training_rows(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, most_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(text, lang) to learn from: of the ``most_languages`` values of lang with most rows, at most ``per_language`` ids by hash of the id, never a held-out one, and
    each language's part of ``most_chars`` characters (of 16 parts in as many as there are languages, beyond 16). Only ids are ranked, not texts; of an id that repeats within a language one text counts."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return []
    most_chars = most_chars * 16 // max(16, len(counts))  # a word has a number for each language
    # the smallest hashes of a language are sought, so ids far above them are not ranked at all
    far = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, -(2**63) + min(2**64 - 1, 2**64 * 20 * per_language // n))])
    near = known.where(F.xxhash64("doc_id") <= F.try_element_at(far, F.col("lang"))).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = near.withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id", "lang").collect()
    named: dict = {}
    for r in sorted(ids):
        named.setdefault(r["doc_id"], r["lang"])
    one = known.join(F.broadcast(docs.sparkSession.createDataFrame(list(named.items()), known.select("doc_id", "lang").schema)), ["doc_id", "lang"])  # most_languages * per_language rows at most
    share, used, out = most_chars // len(counts), dict.fromkeys(counts, 0), []
    for i, text in sorted(sample_texts(one, list(named), most_chars)):
        used[named[i]] += len(text)
        if used[named[i]] <= share:
            out.append((text, named[i]))
    return out


def train(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, most_chars: int = SAMPLE_CHARS) -> Model | None:
    """The field learned from ``training_rows``; None where there is none to learn from, or none with a word."""
    rows = training_rows(docs, per_language, most_languages, most_chars)
    return fitted([t for t, _ in rows], [x for _, x in rows]) if rows else None


def predicted(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the highest mean over its words of the probability of a language."""
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    w = features(texts)
    if model is None or not len(w.text):
        return names, score
    n = np.bincount(w.text, minlength=len(texts))
    some = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[some]
    mean = np.add.reduceat(forward_backward(model.potentials(w), np.exp(model.transition), first)[1], first, axis=0) / n[some, None]
    for i, m in zip(some, mean, strict=True):
        if any(c.isalpha() for c in texts[i]):
            names[i], score[i] = model.languages[int(m.argmax())], min(1.0, float(m.max()))
    return names, score


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` named doc_id, text and whatever else, and lang_pred, score: a narrow step, no shuffle.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learned. Null ids and repeated rows are rows like others; an empty table gives
    no rows; columns of ``docs`` named lang_pred or lang_score are replaced. Texts of any length are read whole, in blocks of whole texts.
    """
    fields = [f for f in docs.schema if f.name not in ("lang_pred", "lang_score")]
    docs = docs.select(*[f.name for f in fields])
    k = len(model.languages) if model else 1
    size = (1 << 21) * 16 // max(16, k)  # a word has a number for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in text_blocks(texts, size):
                names, score = predicted(model, texts[lo:hi])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, StructType(fields).add("lang_pred", "string").add("lang_score", "double"))


def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = identified(docs.select("doc_id", "text"), train(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
