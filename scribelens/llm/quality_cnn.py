"""Quality classification by a byte-level convolutional network in numpy.

A document is cut into overlapping chunks of bytes that cover all of it. Bytes are embedded,
learned filters slide over each chunk, and each filter's largest response in the chunk is
kept (max pooling). A linear layer makes one logit per chunk; the mean, largest and smallest
logit over all chunks are combined into the document's probability.

The network is fitted on the driver on a bounded sample of labelled rows, drawn by a seeded
hash: ``sample`` rows at most, and no more than fill ``budget`` bytes. All chunks of the
sampled rows take part, whatever their texts' length. Scoring covers every byte of every
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bytes_of, flat, pieces, temporary

CHUNK, STEP = 256, 192
WIDTH, STRIDE = 8, 2
EMBEDDING, FILTERS = 8, 24
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (in ``data``) of each chunk, and where each text's chunks begin; an empty text has one empty chunk."""
    lengths = np.diff(at)
    n = np.maximum(1, -(-(lengths - CHUNK) // STEP) + 1)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    begin = at[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * STEP
    return begin, np.minimum(begin + CHUNK, at[1:][text]), first


def gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The chunks' bytes; zeros after the text's end."""
    where = begin[:, None] + np.arange(CHUNK)
    inside = where < end[:, None]
    if not len(data):
        return np.zeros(where.shape, np.uint8)
    return data[np.minimum(where, len(data) - 1)] * inside


class Network:
    """Embedding, filters, the chunk's linear layer and the document's."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embedding = r.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = r.normal(0, (2 / (WIDTH * EMBEDDING)) ** 0.5, (WIDTH * EMBEDDING, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.weights = r.normal(0, 0.3, FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.document = np.array([1.0, 0.0, 0.0, 0.0])

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        rows = self.embedding[chunks].reshape(len(chunks), CHUNK * EMBEDDING)
        step = STRIDE * EMBEDDING * 4
        return np.lib.stride_tricks.as_strided(rows, (len(chunks), PLACES, WIDTH * EMBEDDING), (rows.strides[0], step, 4)).reshape(-1, WIDTH * EMBEDDING)

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        pooled = (self._windows(chunks) @ self.filters).reshape(len(chunks), PLACES, FILTERS).max(axis=1)
        return np.maximum(pooled + self.offset, 0) @ self.weights + self.bias[0]

    def all_logits(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, together: int = 96) -> np.ndarray:
        out = [self.logits(gathered(data, begin[i : i + together], end[i : i + together])) for i in range(0, len(begin), together)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def fit_filters(self, chunks: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 8) -> None:
        """Adam on the chunks' weighted logistic loss; only the places that won the pooling pass gradients down."""
        r = np.random.default_rng(seed)
        names = ("embedding", "filters", "offset", "weights", "bias")
        moments = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in names}
        t, size = 0, 128
        for epoch in range(epochs):
            order = r.permutation(len(chunks))
            for i in range(0, len(order), size):
                batch = order[i : i + size]
                x = chunks[batch]
                windows = self._windows(x)
                response = (windows @ self.filters).reshape(len(batch), PLACES, FILTERS)
                won = response.argmax(axis=1)
                pooled = np.take_along_axis(response, won[:, None], 1)[:, 0] + self.offset
                active = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ self.weights + self.bias[0], -30, 30)))
                slope = ((p - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
                down = slope[:, None] * self.weights * (pooled > 0)
                winners = windows.reshape(len(batch), PLACES, -1)[np.arange(len(batch))[:, None], won]
                gradient = {"bias": np.array([slope.sum()]), "weights": active.T @ slope + 1e-4 * self.weights, "offset": down.sum(0), "filters": np.einsum("bf,bfk->kf", down, winners) + 1e-4 * self.filters}
                into = np.einsum("bf,kf->bfk", down, self.filters).reshape(len(batch), FILTERS, WIDTH, EMBEDDING)
                seen = x[np.arange(len(batch))[:, None, None], won[:, :, None] * STRIDE + np.arange(WIDTH)]
                gradient["embedding"] = np.zeros_like(self.embedding)
                np.add.at(gradient["embedding"], seen.ravel(), into.reshape(-1, EMBEDDING))
                t += 1
                for k in names:
                    m, v = moments[k]
                    m += 0.1 * (gradient[k] - m)
                    v += 0.001 * (gradient[k] ** 2 - v)
                    setattr(self, k, (getattr(self, k) - rate * (0.5 if epoch > epochs // 2 else 1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32))

    def features(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each text's mean, largest and smallest chunk logit, and 1."""
        begin, end, first = chunks_of(data, at)
        logits = np.clip(self.all_logits(data, begin, end).astype(np.float64), -20, 20)
        if not len(at) - 1:
            return np.zeros((0, 4))
        cut = first[:-1]
        return np.stack([np.add.reduceat(logits, cut) / np.diff(first), np.maximum.reduceat(logits, cut), np.minimum.reduceat(logits, cut), np.ones(len(cut))], axis=1)

    def fit_document(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Newton's method on the documents' weighted logistic loss with a small penalty."""
        b = np.array([1.0, 0.0, 0.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4)
            b = b - np.linalg.solve(hessian, x.T @ (weight * (p - y)) + 0.5 * (b - [1, 0, 0, 0]))
        self.document = b

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(data, at) @ self.document, -30, 30)))


def fitted(texts: list[bytes], labels: np.ndarray, *, seed: int = 7) -> Network:
    """A network fitted to texts and their labels (1 or 0). Both classes weigh the same; with one class or none, its share is all there is."""
    net = Network(seed)
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        net.weights[:] = 0
        net.document = np.array([0.0, 0.0, 0.0, 0.0 if not len(y) else (4.0 if y[0] else -4.0)])
        return net
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    begin, end, first = chunks_of(data, at)
    text = np.repeat(np.arange(len(y)), np.diff(first))
    own = y[text]
    weight = np.where(own == 1, 0.5 / own.mean(), 0.5 / (1 - own.mean()))
    net.fit_filters(gathered(data, begin, end), own.astype(np.float32), weight.astype(np.float32))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    net.fit_document(net.features(data, at), y, weight)
    return net


def trained(documents: DataFrame, labels: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample: int = 1500, budget: int = 1 << 25, seed: int = 7) -> Network:
    """A network fitted on at most ``sample`` labelled rows for whose id (column id) ``allowed`` holds.

    Rows are taken in the order of a hash of id and text until one would exceed ``budget``
    bytes of text; the first is taken whatever its length. Rows without an id, label or text
    are left out; an id labelled more than once counts as good if all its labels are.
    """
    named = labels.where(F.col(label_id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    named = named.where(allowed).groupBy("id").agg(F.min("label").alias("label"))
    n = named.count()
    chosen = named.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 0.9 * sample / max(n, 1)))))
    wanted = F.broadcast(chosen.limit(sample))  # at most ``sample`` ids
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    order = F.xxhash64(F.lit(seed), "id", "text")
    drawn = rows.join(wanted, "id").select(order.alias("h"), "label", F.octet_length("text").alias("size"), "text")
    sizes = [r["size"] for r in drawn.select("h", "size").orderBy("h", "size").limit(sample).collect()]
    fits = max(1, int(np.searchsorted(np.cumsum(sizes), budget, "right")))
    found = drawn.orderBy("h", "size").limit(fits).toArrow()  # at most ``sample`` rows of ``budget`` bytes together
    return fitted(found["text"].to_pylist(), found["label"].to_numpy(), seed=seed)


def scorer(documents: DataFrame, network: Network):
    """A column function: text bytes to the probability of label 1."""
    shared = documents.sparkSession.sparkContext.broadcast(network)  # some 10,000 numbers

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        for batch in batches:
            found = [pa.array(net.scores(*flat(texts)), pa.float64()) for texts in pieces(batch, 1 << 20)]
            yield pa.concat_arrays(found) if found else pa.array([], pa.float64())

    return run


def scored(documents: DataFrame, network: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1, from the text alone.

    Null and empty texts are one chunk of nothing and get the score of that; very long ones
    are scored chunk by chunk. Repeated rows and ties are scored alike, no rows give no rows,
    other columns are ignored.
    """
    return documents.select(F.col(id_col).alias("id"), scorer(documents, network)(bytes_of(F.col(text_col))).alias("score"))


def accepted(documents: DataFrame, network: Network, *, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``documents`` whose score is at least ``least``, with all their columns."""
    (score,) = temporary(documents, "score")
    marked = documents.withColumn(score, scorer(documents, network)(bytes_of(F.col(text_col))))
    return marked.where(F.col(score) >= F.lit(least)).drop(score)
