"""Quality classifier: a byte-level convolutional network in numpy.

Each of the 256 bytes has a learned row of numbers.  Learned filters run over the whole text; their maxima are taken in
cells of 64 bytes, and overlapping chunks of four cells, two apart, cover the document.  A hidden layer reads each chunk; its mean and its maximum over all chunks give
one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, crc_bucket, map_arrow
from .labelled import bounded_sample

CELL, CHUNK_CELLS, CHUNK_STEP = 64, 4, 2
#: Bytes that a filter sees, bytes from one place of it to the next, numbers that stand for a byte, filters, hidden units.
TAPS, STEP, WIDTH, FILTERS, HIDDEN = 16, 2, 8, 24, 16
#: Bytes that go through the filters at once.
BLOCK = 1 << 16
#: The bounded sample that the network is trained on: documents, characters of each (in PIECES runs over the whole of a longer one).
MAX_DOCS, MAX_CHARS, PIECES, EPOCHS = 3000, 1024, 4, 12
THRESHOLD = 0.7


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in cells, each followed by an empty cell, and how many cells each has."""
    cells = np.array([max(1, -(-len(t) // CELL)) for t in texts])
    out = np.zeros((cells.sum() + len(texts)) * CELL, np.uint8)
    at = 0
    for t, n in zip(texts, cells):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += (n + 1) * CELL
    return out, cells


def _windows(table: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Windows (one row each) of TAPS bytes, each byte as its row of ``table``; ``part`` has TAPS bytes after the last."""
    x = np.empty((len(part), WIDTH), np.float32)
    np.take(table, part, axis=0, out=x, mode="clip")
    return np.lib.stride_tricks.as_strided(x, ((len(part) - TAPS) // STEP, TAPS * WIDTH), (STEP * WIDTH * 4, 4))


def _blocks(stream: np.ndarray) -> Iterator[np.ndarray]:
    padded = np.concatenate((stream, np.zeros(TAPS, np.uint8)))
    for i in range(0, len(stream), BLOCK):
        yield padded[i : min(i + BLOCK, len(stream)) + TAPS]


def _chunks(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first cell, last cell + 1, first chunk of each text) of the overlapping chunks, in stream cells."""
    starts = np.concatenate(([0], np.cumsum(cells + 1)[:-1]))
    count = np.maximum(1, -(-(cells - CHUNK_CELLS) // CHUNK_STEP) + 1)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    within = np.arange(count.sum()) - np.repeat(first, count)
    a = np.repeat(starts, count) + within * CHUNK_STEP
    return a, np.minimum(a + CHUNK_CELLS, np.repeat(starts + cells, count)), first


class ByteConvNet:
    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": 16 * draw(256, WIDTH), "w": draw(TAPS * WIDTH, FILTERS), "b": np.zeros(FILTERS, np.float32), "v": draw(FILTERS, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "u": draw(2 * HIDDEN), "d": np.zeros(1, np.float32)}
        self.p["e"][0] = 0  # what stands outside of a text

    def _cells(self, stream: np.ndarray) -> np.ndarray:
        per = CELL // STEP
        return np.concatenate([(_windows(self.p["e"], part) @ self.p["w"]).reshape(-1, per, FILTERS).max(1) for part in _blocks(stream)])

    def _head(self, cell_max: np.ndarray, cells: np.ndarray) -> dict[str, np.ndarray]:
        a, b, first = _chunks(cells)
        at = np.minimum(a[:, None] + np.arange(CHUNK_CELLS), b[:, None] - 1)
        which = cell_max[at].argmax(1)
        pooled = np.maximum(np.take_along_axis(cell_max[at], which[:, None], 1)[:, 0] + self.p["b"], 0)
        hidden = np.maximum(pooled @ self.p["v"] + self.p["c"], 0)
        count = np.diff(np.append(first, len(a)))
        mean = np.add.reduceat(hidden, first) / count[:, None]
        top = np.maximum.reduceat(hidden, first)
        z = np.hstack((mean, top)) @ self.p["u"] + self.p["d"]
        return {"at": at, "which": which, "pooled": pooled, "hidden": hidden, "first": first, "count": count, "mean": mean, "top": top, "p": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        stream, cells = _stream(texts)
        return self._head(self._cells(stream), cells)["p"].astype(float)

    def _gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        stream, cells = _stream(texts)
        padded = np.concatenate((stream, np.zeros(TAPS, np.uint8)))
        x = _windows(self.p["e"], padded)
        per = CELL // STEP
        out = (x @ self.p["w"]).reshape(-1, per, FILTERS)
        arg = out.argmax(1)
        h = self._head(np.take_along_axis(out, arg[:, None], 1)[:, 0], cells)
        dz = ((h["p"] - y) / len(y)).astype(np.float32)
        both = np.hstack((h["mean"], h["top"]))
        g = {"u": both.T @ dz, "d": dz.sum(keepdims=True)}
        dboth = dz[:, None] * self.p["u"]
        text = np.repeat(np.arange(len(cells)), h["count"])
        dh = (dboth[:, :HIDDEN] / h["count"][:, None])[text]
        is_top = h["hidden"] == h["top"][text]
        dh = (dh + is_top * dboth[:, HIDDEN:][text]) * (h["hidden"] > 0)
        g |= {"v": h["pooled"].T @ dh, "c": dh.sum(0)}
        dp = (dh @ self.p["v"].T) * (h["pooled"] > 0)
        g["b"] = dp.sum(0)
        dcell = np.zeros((len(arg), FILTERS), np.float32)
        cell = np.take_along_axis(h["at"], h["which"], 1)
        np.add.at(dcell, (cell, np.arange(FILTERS)), dp)
        dout = np.zeros((len(arg), per, FILTERS), np.float32)
        np.put_along_axis(dout, arg[:, None], dcell[:, None], 1)
        # Only windows that were some filter's maximum have a part in it.
        dout = dout.reshape(-1, FILTERS)
        rows = np.flatnonzero(dout.any(1))
        dout = dout[rows]
        g["w"] = x[rows].T @ dout
        seen = padded[rows[:, None] * STEP + np.arange(TAPS)].ravel()
        dx = (dout @ self.p["w"].T).reshape(-1, WIDTH)
        g["e"] = np.stack([np.bincount(seen, dx[:, i], 256) for i in range(WIDTH)], 1).astype(np.float32)
        g["e"][0] = 0
        return g

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, batch: int = 32, rate: float = 6e-3, seed: int = 3) -> ByteConvNet:
        """Adam on the log loss, in random order."""
        y = np.array(labels, np.float32)
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.p["d"][:] = np.log(share / (1 - share))
        if len(set(labels)) < 2:
            self.p["u"][:] = 0
            return self
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, t = np.random.default_rng(seed), 0
        steps = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                t += 1
                now = rate * (1 - t / (steps + 1))
                for k, g in self._gradients([texts[j] for j in some], y[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> ByteConvNet:
    """Trained on at most ``max_docs`` labelled documents whose crc32 bucket of 4 isn't 2.

    Of a text beyond ``max_chars`` runs over the whole of it are learned from.  Without labels, or with one value only, all
    texts get that share as their score.
    """
    sample = bounded_sample(docs, labels, F.col("quality").cast("int"), crc_bucket(F.col(id_col), 4) != 2, max_docs, max_chars, id_col, text_col, pieces=PIECES)
    return ByteConvNet().fit([t.encode() for t, _ in sample], [int(y > 0) for _, y in sample])


def score_quality(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row: whole texts, null as empty; a null id isn't held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_texts(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(texts))], ["doc_id", "score"])

    scored = map_arrow(rows, run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: ByteConvNet, text_col: str = "text") -> DataFrame:
    """The rows whose text scores THRESHOLD or more, with their columns; they stay in their tasks.

    Null text is scored as empty.  Each row is judged by its text alone, so null and repeated ids make no difference, and rows
    that agree in all columns stay or go together.  Other columns may be of any type and name.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["i", "t"])
            scores = [net.score(texts) for _, texts in batches_of_texts(iter([pair]), 1 << 20)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= THRESHOLD))

    return map_arrow(docs, run, schema)
