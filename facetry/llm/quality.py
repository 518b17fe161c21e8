"""A quality classifier: random-indexing word vectors pooled per document, a two-layer network and calibrated probabilities."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.texts import bucket_of, id_type, keyed, map_rows

DIM = 64
#: Nonzero components of a word's index vector, and how many neighbours on each side add theirs.
NONZERO, REACH = 6, 2
#: Bounds of the vocabulary, and of the labelled rows that the classifier is fitted on (in expectation).
WORDS, SHAPES, SAMPLE = 20_000, 2_000, 16_000
_SHAPE = bytes.maketrans(bytes(range(128, 256)) + b"bcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"a" * 128 + b"a" * 25 + b"A" * 26 + b"0" * 9)
_REPEATS = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    """The word with letters, capitals and digits made alike and repeats made one: ``b"A!"`` for ``b"WORD!!"``."""
    return b"\x00" + _REPEATS.sub(rb"\1", word.translate(_SHAPE))[:12]


class Forms:
    """Numbers words: a known word its own, another that of its shape, the rest 0."""

    def __init__(self, vocabulary: list[bytes]):
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.seen: dict[bytes, int] = dict(self.number)

    def __len__(self) -> int:
        return len(self.number) + 1

    def ids(self, text: bytes) -> np.ndarray:
        words, seen = text.split(), self.seen
        if len(seen) > 600_000:
            seen = self.seen = dict(self.number)
        for w in set(words):
            if w not in seen:
                seen[w] = self.number.get(shape(w), 0)
        return np.fromiter(map(seen.__getitem__, words), np.int32, len(words))


def index_vectors(n: int, seed: int = 11) -> np.ndarray:
    """A sparse vector of +1 and -1 for each word number."""
    random = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(n), random.integers(DIM, size=n)] = random.choice(np.array([-1, 1], np.float32), n)
    return out


def vocabulary(sample: DataFrame) -> list[bytes]:
    """The most frequent words of the sample, and the most frequent shapes of its words; ties by bytes."""

    def make():
        def each(batch):
            words = Counter(w for x in batch["text"].to_pylist() if x for w in x.split())
            shapes: Counter = Counter()
            for w, n in words.items():
                shapes[shape(w)] += n
            return {"form": [*words, *shapes], "n": [*words.values(), *shapes.values()]}

        return each

    forms = map_rows(sample, make, "form binary, n long").groupBy("form").agg(F.sum("n").alias("n")).where("n >= 3")
    shaped = F.substring("form", 1, 1) == F.lit(b"\x00")
    top = lambda kind, most: [bytes(r.form) for r in forms.where(kind).orderBy(F.desc("n"), "form").limit(most).collect()]
    return top(~shaped, WORDS) + top(shaped, SHAPES)


def context_sums(ids: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Adds to each word's row the index vectors of its neighbours."""
    for k in range(1, REACH + 1):
        if len(ids) > k:
            pair, n = np.unique(ids[:-k].astype(np.int64) * len(index) + ids[k:], return_counts=True)
            left, right = pair // len(index), pair % len(index)
            for a, b in ((left, right), (right, left)):
                order = np.argsort(a, kind="stable")
                a, rows = a[order], index[b[order]] * n[order, None].astype(np.float32)
                first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                total[a[first]] += np.add.reduceat(rows, first)


def word_vectors(sample: DataFrame, words: list[bytes]) -> np.ndarray:
    """Random-indexing vectors: the summed index vectors of neighbours, at unit length, plus the word's own index vector."""
    shared = sample.sparkSession.sparkContext.broadcast(words)  # WORDS + SHAPES entries at most

    def make():
        forms = Forms(shared.value)
        index, total = index_vectors(len(forms)), np.zeros((len(forms), DIM), np.float32)

        def each(batch):
            for x in batch["text"].to_pylist():
                if x:
                    context_sums(forms.ids(x), index, total)

        each.finish = lambda: {"part": list(range(len(range(0, len(total), 1000)))), "rows": [total[i : i + 1000].tobytes() for i in range(0, len(total), 1000)]}
        return each

    def summed(key, table):
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([np.sum([np.frombuffer(x, np.float32) for x in table["rows"].to_pylist()], axis=0, dtype=np.float64).astype(np.float32).tobytes()], pa.binary())})

    kind = "part int, rows binary"
    index = index_vectors(len(words) + 1)
    out = np.zeros_like(index)
    for r in map_rows(sample, make, kind).groupBy("part").applyInArrow(summed, kind).collect():
        rows = np.frombuffer(r.rows, np.float32).reshape(-1, DIM)
        out[r.part * 1000 : r.part * 1000 + len(rows)] = rows
    out = np.round(out)  # the sums are whole numbers
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (np.divide(out, length, out=np.zeros_like(out), where=length > 0) + index / np.sqrt(NONZERO)).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean word vector, and the logarithm of the number of words."""
    if not len(ids):
        return np.zeros(DIM + 1, np.float32)
    if len(ids) > 100_000:
        ids, n = np.unique(ids, return_counts=True)
        return np.append((vectors[ids] * n[:, None]).sum(axis=0) / n.sum(), np.log1p(n.sum()) / 10).astype(np.float32)
    return np.append(vectors[ids].mean(axis=0), np.log1p(len(ids)) / 10).astype(np.float32)


@dataclass
class Network:
    """One hidden layer of tanh units and a logistic output, divided by a temperature fitted on rows kept aside."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 5) -> Network:
    """Adam on the log loss; every fifth row sets the temperature. With no rows, or rows of one class, the score is their share."""
    random = np.random.default_rng(seed)
    if not len(y) or len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    aside = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    tx, ty = x[~aside].astype(np.float64), y[~aside].astype(np.float64)
    mean, scale = tx.mean(axis=0), tx.std(axis=0) + 1e-3
    p = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v, step, z = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, (tx - mean) / scale
    for _ in range(epochs):
        order = random.permutation(len(ty))
        for i in range(0, len(ty), 128):
            rows = order[i : i + 128]
            a, t = z[rows], ty[rows]
            h = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - t) / len(rows)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    if aside.any():
        logit, t = net.logit(x[aside].astype(np.float64)), y[aside]
        loss = lambda k: np.logaddexp(0, np.where(t > 0, -logit, logit) / k).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the identifier as text, modulo 3, is not 1; a null identifier is not learned from."""
    return F.coalesce(bucket_of(F.col(f"`{id_col}`"), 3) != 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Texts with their label, by a hash of the identifier about ``most`` of the labelled rows; rows that repeat an identifier take the majority, 1 in a tie."""
    known = labels.where(F.col("quality").isNotNull() & learnable()).groupBy("doc_id").agg(F.avg("quality").alias("q"))
    share = min(1.0, most / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(share * 1_000_000)).select("doc_id", (F.col("q") >= 0.5).cast("int").alias("label"))
    return keyed(docs, "doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "label")  # about ``most`` identifiers


@dataclass
class QualityModel:
    words: list[bytes]
    vectors: np.ndarray
    network: Network


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> QualityModel:
    """Vocabulary, word vectors and network from a bounded sample of labelled rows; neither language, source nor identifier enters a score."""
    sample = training_sample(docs, labels, most)
    words = vocabulary(sample)
    vectors = word_vectors(sample, words)
    shared = docs.sparkSession.sparkContext.broadcast((words, vectors))

    def make():
        forms, own = Forms(shared.value[0]), shared.value[1]

        def each(batch):
            return {"doc_id": batch["doc_id"], "label": batch["label"], "x": [pooled(forms.ids(t or b""), own).tobytes() for t in batch["text"].to_pylist()]}

        return each

    rows = map_rows(sample, make, f"doc_id {id_type(docs, 'doc_id')}, label int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(-1, DIM + 1)
    return QualityModel(words, vectors, fit_network(x, np.array([r.label for r in rows])))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``score`` of each row, the calibrated probability of good quality; null and empty texts are scored as a text of no words.

    ``carry`` names columns of the documents that come along unchanged, as row_0, row_1 and so on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS + SHAPES vectors of DIM components at most

    def make():
        forms, own = Forms(shared.value.words), shared.value

        def each(batch):
            x = np.array([pooled(forms.ids(t or b""), own.vectors) for t in batch["text"].to_pylist()])
            return {"doc_id": batch["doc_id"], "score": own.network.score(x)} | {f"row_{i}": batch[f"row_{i}"] for i in range(len(carry))}

        return each

    more = {f"row_{i}": F.col(f"`{c}`") for i, c in enumerate(carry)}
    kinds = "".join(f", row_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return map_rows(keyed(docs, id_col, text_col, **more), make, f"doc_id {id_type(docs, id_col)}, score double{kinds}")


def high_quality(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The documents, all their columns, that score at least ``least``."""
    scored = score_quality(docs, model, carry=tuple(docs.columns))
    return scored.where(F.col("score") >= least).select(*(F.col(f"row_{i}").alias(c) for i, c in enumerate(docs.columns)))
