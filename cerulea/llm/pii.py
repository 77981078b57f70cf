"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give base spans, which stay. The field labels every token that holds a digit or an @ (all others are outside by definition): neighbours in the text share a
potential, and so do a token and the next ones of the document with the same characters or of a similar form, however far away. Base spans are observed, so loopy message
passing carries what the patterns are sure of to the mentions that they reject: a card with a digit wrong beside the right one, a phone number without its plus.

Weights are learned by pseudo-likelihood from a bounded sample of documents, whose labels are the base spans, and from further mentions put behind them: a base span of
the document in its own surroundings, broken so that the pattern no longer takes it (a digit changed, the plus dropped, the dots of the domain or a part of 256 or more),
with its label kept. Without those the field could only learn to repeat the patterns.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.llm.common import SAMPLE_CHARS, read_table, sample_texts, text_blocks

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
TRAINING_ROWS = 1500
ROUNDS = 8
CONFIDENCE = 0.5
_FEATURES = 1 << 14
_STEPS = 60
_EDGES = 3
_SURE = 50.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[A-Za-z0-9@._%+()\[\]/:-]++")
_CORE = re.compile(r"[0-9@]")


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them from the left, but with each character looked at once: around every @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base spans, in that order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def broken(kind: int, span: str, turn: int) -> str:
    """A base span as someone might have mistyped it, so that its pattern takes it no more; ``turn`` picks the way."""
    if kind == 0:
        local, domain = span.rsplit("@", 1)
        return f"{local}@{domain.split('.')[0] if turn % 2 else domain.replace('.', '')}"
    if kind == 1:
        parts = span.split(".")
        parts[turn % 4] = str(256 + turn % 744)
        return ".".join(parts)
    if kind == 2:
        places = [i for i, c in enumerate(span) if c.isdigit()][1:]
        at = places[turn % len(places)]
        return span[:at] + str((int(span[at]) + 1 + turn % 9) % 10) + span[at + 1 :]
    return span[1:]


def with_broken(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A training text with its labelled spans: the base spans, and behind the text one broken mention of each kind that it has.

    A broken card also makes a text of its own, where it is labelled as nothing: what tells it from any other number is the card that stands elsewhere.
    """
    spans, alone = base_spans(text), []
    out, labelled, size = [text], list(spans), len(text)
    for kind in sorted({k for _, k, _ in spans}):
        mine = [(s, e) for s, k, e in spans if k == kind]
        turn = zlib.crc32(text[mine[0][0] : mine[0][1]].encode("utf-8", "surrogatepass"))
        s, e = mine[turn % len(mine)]
        before, after = text[max(0, s - 24) : s].split()[-1:], text[e : e + 24].split()[:1]
        lead, mention = "\n" + "".join(f"{w} " for w in before), broken(kind, text[s:e], turn)
        out += [lead, mention, "".join(f" {w}" for w in after)]
        labelled.append((size + len(lead), kind, size + len(lead) + len(mention)))
        size += sum(map(len, out[-3:]))
        if kind == 2:
            alone.append(("".join(out[-3:]), []))
    return [("".join(out), labelled), *alone]


def similar(core: str, shape: str) -> list[str]:
    """What tokens that are alike have in common; none for short numbers and the like, of which a text has many for no common reason.

    Numbers of twelve digits and more are alike if they share their first or their second half, as they do with a digit wrong; two cards that only look alike are not.
    """
    if "@" in core.strip("@"):
        return ["@"]
    if shape.count(".") == 3:
        return [re.sub("0+", "0", shape)]
    digits = _digits(core)
    if len(digits) >= 12:
        half = len(digits) // 2
        return [f"{digits[:half]} {len(digits)}", f"{len(digits)} {digits[half:]}"]
    return [shape.lstrip("+")] if len(digits) >= 5 or core.startswith("(") else []


@dataclass
class Graph:
    """Tokens of some texts, and the edges between them: (token, later token, sort)."""

    text: list[int]
    start: list[int]
    end: list[int]
    features: np.ndarray
    edges: np.ndarray


def graph(texts: list[str]) -> Graph:
    text, start, end, rows, edges = [], [], [], [], []
    hashed = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % _FEATURES
    for n, whole in enumerate(texts):
        twin: dict[tuple[int, str], int] = {}
        for m in _RUN.finditer(whole):
            run = m[0]
            if not _CORE.search(run):
                continue
            core = run.strip(".:/-%")
            s = m.start() + len(run) - len(run.lstrip(".:/-%"))
            e, i = s + len(core), len(start)
            shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "0", core))[:40]
            size = len(_digits(core))
            before, after = whole[max(0, s - 24) : s].split()[-1:], whole[e : e + 24].split()[:1]
            rows.append([hashed(f) for f in ("bias", f"shape {shape.lstrip('+')}", f"digits {min(size, 24)}", f"runs {re.sub('0+', '0', shape).lstrip('+')}", f"at {'@' in core} {core.count('.')}", f"part {size * 4 // max(1, len(core))}", f"before {''.join(before).lower()}", f"after {''.join(after).lower()}")])
            if i and text[-1] == n and s - end[-1] <= 2 and not whole[end[-1] : s].strip(" ()-."):
                edges.append((i - 1, i, 0))
            same, alike = twin.get((1, core)), similar(core, shape)
            edges += [(same, i, 1)] if same is not None else []
            edges += [(old, i, 2) for old in {twin[2, key]: None for key in alike if (2, key) in twin} if old != same]
            twin[1, core] = i
            twin |= dict.fromkeys(((2, key) for key in alike), i)
            text.append(n)
            start.append(s)
            end.append(e)
    return Graph(text, start, end, np.array(rows, np.int64).reshape(len(rows), 8), np.array(edges, np.int64).reshape(len(edges), 3))


def silver(g: Graph, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """The number of the label of the first span (sorted by start) that a token touches, 0 if none; tokens and spans are gone through together."""
    out, at, text = np.zeros(len(g.start), np.int64), 0, -1
    for i, (n, s, e) in enumerate(zip(g.text, g.start, g.end, strict=True)):
        at, text = (at, text) if n == text else (0, n)
        mine = spans[n]
        while at < len(mine) and mine[at][2] <= s:
            at += 1
        k = at
        while k < len(mine) and mine[k][0] < e and mine[k][2] <= s:
            k += 1
        out[i] = mine[k][1] + 1 if k < len(mine) and mine[k][0] < e else 0
    return out


@dataclass
class Model:
    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, g: Graph, rounds: int = ROUNDS, observed: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product with damping, all documents of a block at once: a row for each token, a column for each label. Where ``observed`` is not 0 it is the label."""
        own = self.unary[g.features].sum(1)
        if observed is not None:
            own = np.where((observed > 0)[:, None], np.where(np.eye(len(LABELS), dtype=bool)[observed], 0.0, -_SURE), own)
        a, b, sort = g.edges.T
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        table = np.concatenate([self.pair[sort], self.pair[sort].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(rounds if len(source) else 0):
            belief = own.copy()
            np.add.at(belief, target, message)
            sent = (belief[source] - message[back])[:, :, None] + table
            top = sent.max(1)
            new = top + np.log(np.exp(sent - top[:, None, :]).sum(1))
            message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        belief = own.copy()
        np.add.at(belief, target, message)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)


def fitted(texts: list[str]) -> Model:
    """Weights that maximise the pseudo-likelihood of the labels of base spans and of broken mentions: each token given the labels of those it shares an edge with."""
    told = [x for t in texts for x in with_broken(t)]
    g = graph([t for t, _ in told])
    k, truth = len(LABELS), silver(g, [spans for _, spans in told])
    model = Model(np.zeros((_FEATURES, k)), np.zeros((_EDGES, k, k)))
    seen_u, seen_p = np.full(model.unary.shape, 1e-6), np.full(model.pair.shape, 1e-6)
    # a token that the patterns reject though one like it is theirs is what the field is to decide, so it is no example of either
    a, b, sort = g.edges.T
    known = np.ones(len(truth), bool)
    for one, other in ((a, b), (b, a)):
        known[one[(sort > 0) & (truth[one] == 0) & (truth[other] > 0)]] = False
    a, b, sort = g.edges[known[a] & known[b]].T
    for _ in range(_STEPS if len(truth) else 0):
        logit = model.unary[g.features].sum(1)
        np.add.at(logit, a, model.pair[sort, :, truth[b]])
        np.add.at(logit, b, model.pair[sort, truth[a], :])
        p = np.exp(logit - logit.max(1, keepdims=True))
        error = (np.eye(k)[truth] - p / p.sum(1, keepdims=True)) * known[:, None]
        du = np.stack([np.bincount(g.features.ravel(), weights=np.repeat(error[:, c], g.features.shape[1]), minlength=_FEATURES) for c in range(k)], 1) - 0.01 * model.unary
        dp = -0.01 * model.pair
        np.add.at(dp, (sort, slice(None), truth[b]), error[a])
        np.add.at(dp, (sort, truth[a], slice(None)), error[b])
        seen_u += du * du
        seen_p += dp * dp
        model.unary += 0.3 * du / np.sqrt(seen_u)
        model.pair += 0.3 * dp / np.sqrt(seen_p)
    return model


def possible(kind: int, span: str) -> bool:
    """Whether a span might be meant as its kind: an @ between two parts, four numbers, or up to two digits more or less than the pattern wants."""
    n = len(_digits(span))
    return (bool(span.strip("@").count("@")), span.count(".") == 3 and n >= 4, 12 <= n <= 21, 8 <= n <= 17)[kind]


def added_spans(model: Model, texts: list[str], base: list[list[tuple[int, int, int]]], confidence: float = CONFIDENCE) -> list[list[tuple[int, int, int]]]:
    """Spans of the field that touch no base span and are possible as their kind; neighbours with one label make one span. Base spans are observed."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    g = graph(texts)
    if not g.start:
        return out
    p = model.marginals(g, observed=silver(g, base))
    label = np.where(p.max(1) >= confidence, p.argmax(1), 0)
    joined = {(a, b) for a, b, sort in g.edges.tolist() if sort == 0}
    for i, k in enumerate(label.tolist()):
        if not k:
            continue
        n = g.text[i]
        if out[n] and (i - 1, i) in joined and label[i - 1] == k and out[n][-1][2] == g.end[i - 1]:
            out[n][-1] = (out[n][-1][0], k - 1, g.end[i])
        else:
            out[n].append((g.start[i], k - 1, g.end[i]))
    for n, spans in enumerate(out):
        taken, clear, at = sorted((s, e) for s, _, e in base[n]), [], 0
        for s, k, e in spans:
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if possible(k, texts[n][s:e]) and not any(x < e and s < y for x, y in taken[max(0, at - 1) : at + 4]):
                clear.append((s, k, e))
        out[n] = clear
    return out


def train(docs: DataFrame, most: int = TRAINING_ROWS, most_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from at most ``most`` documents that hold a digit or an @, by hash of the id, and ``most_chars`` characters; of an id that repeats from one text."""
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return fitted([t for _, t in sorted(sample_texts(docs.where(F.col("text").rlike("[0-9@]")), [r["doc_id"] for r in ids], most_chars))])


def marked(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every document, read whole: counts are of base spans, spans are all.

    Null texts count as empty, null ids and repeated rows are rows like others, an empty table gives no rows; offsets are code points, ends exclusive. Texts without a digit or an @ hold nothing by definition and never leave the JVM. Narrow: no shuffle.
    """
    fields = [pa.field("doc_id", pa.int64()), *(pa.field(f"n_{k}", pa.int64()) for k in KINDS), pa.field("base_sha256", pa.string()), pa.field("spans", pa.string()), pa.field("n_added", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in text_blocks(texts):
                part = texts[lo:hi]
                base = [base_spans(t) if t else [] for t in part]
                added = added_spans(model, part, base)
                counts = np.zeros((len(KINDS), len(part)), np.int64)
                for n, spans in enumerate(base):
                    for _, k, _ in spans:
                        counts[k, n] += 1
                digest = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
                spans = [written(sorted(b + a)) for b, a in zip(base, added, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *map(pa.array, counts), pa.array(digest), pa.array(spans, pa.string()), pa.array([len(a) for a in added], pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike("[0-9@]"), F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return marked(docs, train(docs))
