"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network labels every byte of a text with a language; a document's probabilities are pooled from those of all its
bytes.  Texts are run in segments side by side, so long and short ones share the same array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, crc_bucket, map_arrow
from .labelled import bounded_sample

HIDDEN, CONTEXT = 8, 12
#: Bytes of a segment that it labels; it reads CONTEXT more on either side.
SEGMENT = 244
#: Segments run side by side.
BATCH = 1024
#: The bounded sample that the network is trained on, and how it is trained.
MAX_DOCS, MAX_CHARS, PIECES, TRAIN_BYTES, STEPS, TRAIN_BATCH = 2000, 600, 4, 64, 500, 96
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.add(x, 1, out=x)
    np.multiply(x, 0.5, out=x)
    return x


class Direction:
    """One gated recurrent layer.  ``table`` has each byte's input to the three gates (reset, update, new)."""

    def __init__(self, rng: np.random.Generator) -> None:
        h = HIDDEN
        self.p = {"table": (rng.standard_normal((257, 3 * h)) * 0.4).astype(np.float32), "u": (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32)}

    def states(self, x: np.ndarray) -> np.ndarray:
        """Hidden states (time, batch, HIDDEN) for bytes (time, batch); 256 is the outside of a text and keeps the state zero."""
        h2 = 2 * HIDDEN
        out = np.empty((*x.shape, HIDDEN), np.float32)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        inside = (x < 256).astype(np.float32)[:, :, None]
        table, u = self.p["table"], self.p["u"]
        for t in range(len(x)):
            g = table.take(x[t], axis=0)
            r = h @ u
            gates = _sigmoid(g[:, :h2] + r[:, :h2])
            new = np.tanh(g[:, h2:] + gates[:, :HIDDEN] * r[:, h2:])
            h = new + gates[:, HIDDEN:] * (h - new)
            h *= inside[t]
            out[t] = h
        return out

    def backward(self, x: np.ndarray, hs: np.ndarray, dhs: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters by backpropagation through time, given those of the states."""
        h2 = 2 * HIDDEN
        table, u = self.p["table"], self.p["u"]
        dtable, du = np.zeros_like(table), np.zeros_like(u)
        dh = np.zeros_like(hs[0])
        for t in range(len(x) - 1, -1, -1):
            before = hs[t - 1] if t else np.zeros_like(hs[0])
            g, r = table[x[t]], before @ u
            gates = _sigmoid(g[:, :h2] + r[:, :h2])
            reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(g[:, h2:] + reset * r[:, h2:])
            dh = (dh + dhs[t]) * (x[t] < 256)[:, None]
            dnew = dh * (1 - update) * (1 - new * new)
            dupdate = dh * (before - new) * update * (1 - update)
            dreset = dnew * r[:, h2:] * reset * (1 - reset)
            dg = np.hstack((dreset, dupdate, dnew))
            dr = np.hstack((dreset, dupdate, dnew * reset))
            np.add.at(dtable, x[t], dg)
            du += before.T @ dr
            dh = dh * update + dr @ u.T
        return {"table": dtable, "u": du}


class ByteLanguageNet:
    def __init__(self, languages: list[str], seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.back = Direction(rng), Direction(rng)
        self.p = {"w": (rng.standard_normal((2 * HIDDEN, len(languages))) * 0.3).astype(np.float32), "b": np.zeros(len(languages), np.float32)}

    def _positions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities (time, batch, language) of each byte, and both directions' states."""
        f, b = self.forward.states(x), self.back.states(x[::-1])[::-1]
        z = (f.reshape(-1, HIDDEN) @ self.p["w"][:HIDDEN]).reshape(*x.shape, -1)
        z += (b.reshape(-1, HIDDEN) @ self.p["w"][HIDDEN:]).reshape(z.shape)
        z += self.p["b"]
        np.clip(z, -40, 40, out=z)  # states are within (-1, 1), so that this rarely matters
        flat = z.reshape(-1, z.shape[2])
        flat -= np.log(np.exp(flat) @ np.ones((z.shape[2], 1), np.float32))
        return z, f, b

    def fit(self, texts: list[bytes], labels: list[str], steps: int = STEPS, rate: float = 0.02, seed: int = 19) -> ByteLanguageNet:
        """Adam on the log loss of every byte's label, over random windows of TRAIN_BYTES."""
        long = [(t, self.languages.index(y)) for t, y in zip(texts, labels) if t.strip()]
        if len(self.languages) < 2 or not long:
            return self
        rng = np.random.default_rng(seed)
        weights = 1 / np.bincount([y for _, y in long], minlength=len(self.languages))[[y for _, y in long]]
        weights = np.sqrt(weights) / np.sqrt(weights).sum()
        parts = {"f": self.forward.p, "k": self.back.p, "o": self.p}
        m = {(a, k): np.zeros_like(v) for a, p in parts.items() for k, v in p.items()}
        s = {key: np.zeros_like(v) for key, v in m.items()}
        for step in range(1, steps + 1):
            x = np.full((TRAIN_BYTES, TRAIN_BATCH), 256, np.int64)
            y = np.empty(TRAIN_BATCH, np.int64)
            for j, i in enumerate(rng.choice(len(long), TRAIN_BATCH, p=weights)):
                text, y[j] = long[i]
                at = rng.integers(0, max(1, len(text) - TRAIN_BYTES + 1))
                window = np.frombuffer(text[at : at + TRAIN_BYTES], np.uint8)
                x[: len(window), j] = window
            p, f, b = self._positions(x)
            inside = (x < 256)[:, :, None]
            dz = np.exp(p)
            dz[:, np.arange(TRAIN_BATCH), y] -= 1
            dz = (dz * inside / inside.sum()).astype(np.float32)
            flat = dz.reshape(-1, dz.shape[2])
            grads = {("o", "w"): np.vstack((f.reshape(-1, HIDDEN).T @ flat, b.reshape(-1, HIDDEN).T @ flat)), ("o", "b"): flat.sum(0)}
            grads |= {("f", k): g for k, g in self.forward.backward(x, f, dz @ self.p["w"][:HIDDEN].T).items()}
            grads |= {("k", k): g for k, g in self.back.backward(x[::-1], b[::-1], (dz @ self.p["w"][HIDDEN:].T)[::-1]).items()}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - step / (steps + 1)) * min(1.0, 1.0 / (norm + 1e-9)) if norm > 1 else rate * (1 - step / (steps + 1))
            for key, g in grads.items():
                m[key] = 0.9 * m[key] + 0.1 * g
                s[key] = 0.99 * s[key] + 0.01 * g * g
                parts[key[0]][key[1]] -= now * (m[key] / (1 - 0.9**step)) / (np.sqrt(s[key] / (1 - 0.99**step)) + 1e-6)
        return self

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): pooled log probabilities of all bytes, as probabilities; uniform for an empty text."""
        n = len(self.languages)
        totals, counts = np.zeros((len(texts), n)), np.zeros(len(texts))
        owner: list[int] = []
        windows: list[bytes] = []
        lead: list[int] = []

        def run() -> None:
            x = np.full((SEGMENT + 2 * CONTEXT, len(windows)), 256, np.int64)
            own = np.zeros(x.shape, np.float32)
            for j, w in enumerate(windows):
                start = CONTEXT - lead[j]
                x[start : start + len(w), j] = np.frombuffer(w, np.uint8)
                own[CONTEXT : min(CONTEXT + SEGMENT, start + len(w)), j] = 1
            logs = np.einsum("tbl,tb->bl", np.maximum(self._positions(x)[0], -14), own)
            np.add.at(totals, owner, logs)
            np.add.at(counts, owner, own.sum(0))

        for i, text in enumerate(texts):
            for a in range(0, len(text), SEGMENT):
                first = max(0, a - CONTEXT)
                windows.append(text[first : a + SEGMENT + CONTEXT])
                lead.append(a - first)
                owner.append(i)
                if len(windows) == BATCH:
                    run()
                    windows, lead, owner = [], [], []
        if windows:
            run()
        # Bytes near each other say much the same: a text counts as the square root of its length.
        z = totals / np.sqrt(np.maximum(counts, 1))[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> ByteLanguageNet:
    """Trained on at most ``max_docs`` documents with a language whose crc32 bucket of 4 isn't 2.

    Each language has an equal share of these, so that a rare one is learned too.  Of a text beyond ``max_chars`` runs over the
    whole of it are learned from; training reads windows of TRAIN_BYTES of them in any case.
    """
    lang = F.col(lang_col).cast("string")
    keep = (crc_bucket(F.col(id_col), 4) != 2) & F.col(text_col).isNotNull()
    sample = bounded_sample(docs, docs, lang, keep, max_docs, max_chars, id_col, text_col, pieces=PIECES, per_label=True)
    languages = sorted({y for _, y in sample})
    return ByteLanguageNet(languages).fit([t.encode() for t, _ in sample], [y for _, y in sample])


def predict_languages(docs: DataFrame, net: ByteLanguageNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row: whole texts; ``und`` with score 0 if there is no letter.

    A null id isn't held out.  If no language could be learned, all is ``und``.  Bytes that aren't UTF-8 are read as they are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_texts(batches, 4 << 20):
            lettered = np.array([any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts]) & bool(net.languages)
            langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            some = np.flatnonzero(lettered)
            if len(some):
                p = net.probabilities([texts[i] for i in some])
                langs[some], scores[some] = np.array(net.languages, object)[p.argmax(1)], p.max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    found = map_arrow(rows, run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
