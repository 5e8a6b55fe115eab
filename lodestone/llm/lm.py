"""Language-model scores from an Elias-Fano n-gram trie in memory-mapped levels.

The first level has the words, the second each context's successors: contexts are a monotone sequence, a context's rank
points to its run of successors, and successors are coded relative to that rank.  Both are Elias-Fano coded, and each
pair has a quantised smoothed log probability.  Tasks count the n-grams of their own documents and send sorted runs to
the level's shards; each shard is coded and written to the shared folder.  Scoring maps the files and looks up
all pairs of a batch of documents at once.
"""

from __future__ import annotations

import gc
import json
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, map_arrow, work_dir

#: The weight of a word's own estimate against its context's, in counts.
PRIOR = 50.0
#: A context's successors are coded by spans of 2**SPAN word ids, so that a very common context has several shards.
SPAN = 20
#: Text per shard of a level, text per batch of documents, keys that a task holds before it sends them.
SHARD_BYTES, BATCH_BYTES, HELD_KEYS = 48 << 20, 12 << 20, 6_000_000
#: Bytes of levels that a worker holds where the shared folder isn't mounted and files are read as a whole.
HELD_BYTES = 512 << 20
#: What stands for the end; no word has a space.
END = b" "
_LEVELS = 255
_U = np.uint64


# Elias-Fano coding ------------------------------------------------------------------------------------------------------


def _pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value, one after the other, in uint64 words."""
    out = [np.zeros(0, _U)]
    for i in range(0, len(values) if bits else 0, 1 << 18):
        part = values[i : i + (1 << 18)].astype("<u8")
        flat = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel()
        flat = np.concatenate((flat, np.zeros(-len(flat) % 64, np.uint8)))
        out.append(np.packbits(flat, bitorder="little").view("<u8"))
    return np.concatenate((*out, np.zeros(2, _U)))


def _select_bit(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit number ``rank`` (from 0) of each word."""
    at = np.zeros(len(words), np.int64)
    rank = rank.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count((words >> at.astype(_U)) & _U((1 << width) - 1)).astype(np.int64)
        right = rank >= below
        at += right * width
        rank -= right * below
    return at


class EliasFano:
    """A sorted array of distinct uint64 keys: low bits packed, high bits in unary, zeros counted per 512 bits."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def of(cls, keys: np.ndarray) -> EliasFano:
        n = len(keys)
        bits = max(0, (int(keys[-1]) // n).bit_length() - 1) if n else 0
        upper = (keys >> _U(bits)).astype(np.int64)
        size = n + (int(upper[-1]) if n else 0) + 1
        blocks = size // 512 + 1
        high = np.zeros(blocks * 8 + 1, _U)
        place = upper + np.arange(n)
        word = place >> 6
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if n else np.zeros(0, np.int64)
        if n:
            high[word[first]] = np.bitwise_or.reduceat(_U(1) << (place & 63).astype(_U), first)
        per_block = 512 - np.bitwise_count(high[:-1]).reshape(blocks, 8).sum(1, dtype=np.int64)
        low = _pack_bits(keys & _U((1 << bits) - 1), bits)
        return cls(n, bits, low, high, np.concatenate(([0], np.cumsum(per_block))))

    def _zero(self, number: np.ndarray) -> np.ndarray:
        """The place of the zero ``number`` (from 0)."""
        block = np.searchsorted(self.zeros, number, "right") - 1
        rank = number - self.zeros[block]
        words = ~self.high[block[:, None] * 8 + np.arange(8)]
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        which = (upto <= rank[:, None]).sum(1)
        row = np.arange(len(number))
        rank = rank - np.where(which > 0, upto[row, np.maximum(which - 1, 0)], 0)
        return block * 512 + which * 64 + _select_bit(words[row, which], rank)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(_U)
        over = (self.low[word + 1] << (_U(63) - shift)) << _U(1)
        return ((self.low[word] >> shift) | over) & _U((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 where there is none: its bucket by its high bits, then a search in the bucket by its low ones."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        upper = (keys >> _U(self.bits)).astype(np.int64)
        there = np.flatnonzero((upper < self.zeros[-1]) & (upper >= 0))
        upper = upper[there]
        place = np.where(upper > 0, self._zero(np.maximum(upper - 1, 0)), -1) + 1
        lo = place - upper
        word, shift = place >> 6, (place & 63).astype(_U)
        window = (self.high[word] >> shift) | ((self.high[np.minimum(word + 1, len(self.high) - 1)] << (_U(63) - shift)) << _U(1))
        # The bucket's keys are the ones up to its zero.
        run = np.where(window == ~_U(0), 64, np.bitwise_count(window & (window ^ (window + _U(1)))).astype(np.int64))
        long = np.flatnonzero(run == 64)
        hi = lo + run
        if len(long):
            hi[long] = self._zero(upper[long]) - upper[long]
        hi = np.minimum(hi, self.n)
        low = keys[there] & _U((1 << self.bits) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            got = self._low(mid)
            same = got == low[live]
            out[there[live[same]]] = mid[same]
            less = got < low[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[~same]
            live = live[lo[live] < hi[live]]
        return out

    @classmethod
    def mapped(cls, name: str, meta: dict, arrays: dict[str, np.ndarray]) -> EliasFano:
        n, bits = meta["coded"][name]
        return cls(n, bits, *(arrays[f"{name}.{k}"] for k in ("low", "high", "zeros")))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "zeros": self.zeros}


# Files ------------------------------------------------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_arrays(path: str, meta: dict, arrays: dict[str, np.ndarray]) -> None:
    """One file: the header's length, a JSON header, then the arrays, each at a multiple of 64 bytes."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"meta": meta, "arrays": places}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    fs, base = _filesystem(path)
    with fs.open_output_stream(base, compression=None) as out:
        out.write(struct.pack("<Q", len(head)) + head)
        for a in arrays.values():
            out.write(memoryview(np.ascontiguousarray(a)).cast("B") if a.nbytes else b"")
            out.write(b"\0" * (-a.nbytes % 64))


def map_arrays(path: str) -> tuple[dict, dict[str, np.ndarray]]:
    """Memory-mapped where the shared folder is mounted; read as a whole from other stores."""
    fs, base = _filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        data = np.memmap(base, np.uint8, "r")
    else:
        with fs.open_input_file(base) as f:
            data = np.frombuffer(f.read(), np.uint8)
    size = struct.unpack("<Q", data[:8].tobytes())[0]
    head = json.loads(data[8 : 8 + size].tobytes())
    out = {}
    for name, (kind, n, at) in head["arrays"].items():
        dtype = np.dtype(kind)
        start = 8 + size + at
        out[name] = data[start : start + n * dtype.itemsize].view(dtype)
    return head["meta"], out


def _quantise(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(codes, least, step): eight bits per value."""
    least, most = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (most - least) / _LEVELS or 1.0
    return np.round((x - least) / step).astype(np.uint8), least, step


# Model ------------------------------------------------------------------------------------------------------------------


@dataclass
class NgramModel:
    """Paths and sizes of the levels; files are mapped by each worker when first used."""

    words: list[str]
    first_id: list[int]
    total: int
    vocabulary: int
    texts: int
    discount: float
    prior: float
    pairs: list[str] = field(default_factory=list)
    loaded: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"loaded": {}}

    def _level(self, path: str) -> tuple[dict, dict[str, EliasFano], dict[str, np.ndarray]]:
        if path not in self.loaded:
            meta, a = map_arrays(path)
            self.loaded[path] = meta, {k: EliasFano.mapped(k, meta, a) for k in meta["coded"]}, a
            # Mapped files are the system's to page out; files that had to be read are let go, the oldest first.
            held = {p: sum(x.nbytes for x in own.values()) for p, (_, _, own) in self.loaded.items() if not all(isinstance(x.base, np.memmap) for x in own.values())}
            while sum(held.values()) > HELD_BYTES and len(held) > 1:
                oldest = next(iter(held))
                del held[oldest], self.loaded[oldest]
        return self.loaded[path]

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of words given as hashes; id -1 and count 0 where a word wasn't learned."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bits = (len(self.words) - 1).bit_length()
        for shard, at in _by_shard(_leading(hashes, bits), len(self.words)):
            _, coded, a = self._level(self.words[shard])
            found = coded["word"].find(hashes[at] & _below(64 - bits))
            good = found >= 0
            ids[at[good]] = found[good] + self.first_id[shard]
            counts[at[good]] = a["counts"][found[good]]
        return ids, counts

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of known ids, and of the begin of a text (id ``vocabulary``)."""
        out = np.full(len(ids), self.texts, np.int64)
        shard = np.searchsorted(self.first_id, ids, "right") - 1
        shard[ids >= self.vocabulary] = -1
        for s, at in _by_shard(shard, len(self.words)):
            out[at] = self._level(self.words[s])[2]["counts"][ids[at] - self.first_id[s]]
        return out

    def word_log(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of a word with this count; 0: any word that wasn't learned, together."""
        share = np.where(counts > 0, counts - self.discount, self.discount * self.vocabulary) / max(self.total, 1)
        return np.log10(np.maximum(share, 1e-12))

    def keys(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """context and word in one number; its bits above SPAN are the context and the word's span."""
        return context.astype(_U) * _U(self.width) + word.astype(_U)

    @property
    def width(self) -> int:
        return ((self.vocabulary >> SPAN) + 1) << SPAN

    def pair_log(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each learned pair, nan for others.

        A context is looked up first; its successors are numbers relative to its rank, among which the word is searched.
        """
        out = np.full(len(keys), np.nan)
        for shard, at in _by_shard(_spread(keys, len(self.pairs)), len(self.pairs)):
            meta, coded, a = self._level(self.pairs[shard])
            contexts, back = np.unique(keys[at] >> _U(SPAN), return_inverse=True)
            rank = coded["context"].find(contexts)[back]
            known = np.flatnonzero(rank >= 0)
            found = coded["successor"].find((rank[known].astype(_U) << _U(SPAN)) | (keys[at[known]] & _below(SPAN)))
            good = found >= 0
            out[at[known[good]]] = meta["least"] + meta["step"] * a["log"][found[good]]
        return out

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score and score."""
        words, counts = tokens(texts)
        hashes, number = _numbered(words)
        ids, seen = (x[number] for x in self.word_ids(hashes))
        context = _contexts(ids, counts, self.vocabulary)
        alone = self.word_log(seen)
        held = np.zeros(len(ids))
        known = np.flatnonzero(context >= 0)
        distinct, back = np.unique(context[known], return_inverse=True)
        held[known] = self.word_counts(distinct)[back]
        log = alone + np.where(context >= 0, np.log10(self.prior / (held + self.prior)), 0.0)
        both = np.flatnonzero((context >= 0) & (ids >= 0))
        pairs, back = np.unique(self.keys(context[both], ids[both]), return_inverse=True)
        found = self.pair_log(pairs)[back]
        log[both] = np.where(np.isnan(found), log[both], found)
        at = np.cumsum(counts) - counts
        base = np.log10((seen + 1) / (self.total + self.vocabulary + 1))
        return {"n_tokens": counts, "n_known": np.add.reduceat((seen > 0).astype(np.int64), at), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(log, at)}


def _below(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def _leading(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _spread(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair's context and span."""
    x = (keys >> _U(SPAN)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    return ((x * _U(0xBF58476D1CE4E5B9)) >> _U(32)).astype(np.int64) % shards


def _contexts(ids: np.ndarray, counts: np.ndarray, begin: int) -> np.ndarray:
    """The id before each token, ``begin`` at a text's first."""
    out = np.concatenate(([begin], ids[:-1]))
    out[np.cumsum(counts) - counts] = begin
    return out


def _by_shard(of: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of each shard that occurs; negative shards are left out."""
    if shards == 1:
        at = np.flatnonzero(of == 0)
        if len(at):
            yield 0, at
        return
    order = np.argsort(of.astype(np.int32), kind="stable")
    ends = np.searchsorted(of[order], np.arange(shards + 1))
    for s in range(shards):
        if ends[s] < ends[s + 1]:
            yield s, order[ends[s] : ends[s + 1]]


def tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words, each text's followed by END, and how many each text has."""
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.lower().split()
        counts[i] = len(own) + 1
        words += own
        words.append(END)
    return words, counts


def _numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each distinct word, number of each word's hash)."""
    distinct = dict.fromkeys(words)
    h = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(h, distinct), _U, len(distinct))
    number = dict(zip(distinct, range(len(distinct))))
    return hashes, np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts, from sorted runs."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _run_bytes(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run by differences, byte planes apart, so that empty planes compress to nothing."""
    gaps = np.diff(keys, prepend=_U(0)).astype("<u8")
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _run_arrays(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    planes = np.frombuffer(data, np.uint8).reshape(12, n)
    gaps = np.ascontiguousarray(planes[:8].T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=_U), np.ascontiguousarray(planes[8:].T).view("<u4").ravel().astype(np.int64)


class _Counter:
    """Counts keys; sends sorted runs, one row per shard, when it holds many."""

    def __init__(self, shards: int, shard_of) -> None:
        self.shards, self.shard_of = shards, shard_of
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        return self.held > HELD_KEYS

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        keys, counts = _merged(self.keys, self.counts)
        self.keys, self.counts, self.held = [], [], 0
        for shard, at in _by_shard(self.shard_of(keys), self.shards):
            at.sort()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_run_bytes(keys[at], counts[at])], pa.large_binary()).cast(pa.binary())], ["shard", "run"])


def _counted(docs: DataFrame, shards: int, shard_of, keys_of) -> DataFrame:
    """(shard, run) rows of the keys that ``keys_of`` makes of batches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # long lists of words, but no cycles
        counter = _Counter(shards, shard_of)
        for _, texts in batches_of_texts(batches, BATCH_BYTES):
            if counter.add(*keys_of(texts)):
                yield from counter.send()
        yield from counter.send()

    return map_arrow(docs, run, "shard int, run binary")


def _written(runs: DataFrame, shards: int, write, schema: str) -> DataFrame:
    """Merges each shard's runs and gives them to ``write``, which returns a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([write(now, *_merged(*held))])

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now is not None and shard != now:
                    yield done()
                    held = ([], [])
                now = shard
                keys, counts = _run_arrays(data.as_py())
                held[0].append(keys)
                held[1].append(counts)
                if sum(map(len, held[0])) > 4 * HELD_KEYS:
                    held = tuple([x] for x in _merged(*held))
        if now is not None:
            yield done()

    return map_arrow(runs.repartitionById(shards, "shard").sortWithinPartitions("shard"), run, schema)


def _save(folder: str, name: str, coded: dict[str, np.ndarray], meta: dict, arrays: dict[str, np.ndarray]) -> str:
    """Codes and writes one shard of a level, under a name of this attempt's own."""
    context = TaskContext.get()
    path = posixpath.join(folder, f"{name}-{context.taskAttemptId() if context else 'none'}.ef")
    sets = {k: EliasFano.of(v) for k, v in coded.items()}
    write_arrays(path, meta | {"coded": {k: [ef.n, ef.bits] for k, ef in sets.items()}}, arrays | {f"{k}.{n}": a for k, ef in sets.items() for n, a in ef.arrays().items()})
    return path


def fit(docs: DataFrame, keep: Column, text_col: str = "text", prior: float = PRIOR) -> NgramModel:
    """Learns from all rows that ``keep`` allows; null text counts as empty.

    A word's share is discounted by D = n1 / (n1 + 2 n2) counts, and what is taken goes to words that weren't learned.
    A pair's estimate is (count + prior * the word's estimate) / (the context's count + prior).
    """
    spark = docs.sparkSession
    train = docs.filter(keep).select(F.lit(0).alias("i"), F.col(text_col).cast("string").cast("binary").alias("text"))
    size = train.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    folder = work_dir(spark, "lm")
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    none = np.zeros(0, _U)
    bits = int(size // SHARD_BYTES).bit_length()

    def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes, number = _numbered(tokens(texts)[0])
        order = np.argsort(hashes)
        return hashes[order], np.bincount(number, minlength=len(hashes))[order]

    def write_words(shard: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        path = _save(folder, f"words-{shard:06d}", {"word": keys & _below(64 - bits)}, {}, {"counts": counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8")})
        return {"shard": shard, "path": path, "n": len(keys), "total": int(counts.sum()), "n1": int((counts == 1).sum()), "n2": int((counts == 2).sum())}

    rows = _written(_counted(train, 1 << bits, lambda k: _leading(k, bits), words_of), 1 << bits, write_words, "shard long, path string, n long, total long, n1 long, n2 long").collect()
    by = {r["shard"]: r.asDict() for r in rows}
    for shard in set(range(1 << bits)) - set(by):
        by[shard] = write_words(shard, none, np.zeros(0, np.int64))
    every = [by[s] for s in range(1 << bits)]
    total, sizes, n1, n2 = sum(r["total"] for r in every), [r["n"] for r in every], sum(r["n1"] for r in every), sum(r["n2"] for r in every)
    model = NgramModel([r["path"] for r in every], np.cumsum([0, *sizes[:-1]]).tolist(), total, sum(sizes), 0, n1 / (n1 + 2 * n2) if n1 else 0.5, prior)
    model.texts = int(model.word_ids(_numbered([END])[0])[1][0])
    model.loaded = {}
    shards = max(1, -(-size // SHARD_BYTES))

    def pairs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, counts = tokens(texts)
        hashes, number = _numbered(words)
        ids = model.word_ids(hashes)[0][number]
        return np.unique(model.keys(_contexts(ids, counts, model.vocabulary), ids), return_counts=True)

    def write_pairs(shard: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        context, word = (x.astype(np.int64) for x in np.divmod(keys, _U(model.width)))
        held, alone = model.word_counts(context), 10 ** model.word_log(model.word_counts(word))
        codes, least, step = _quantise(np.log10((counts + model.prior * alone) / (held + model.prior)))
        groups, rank = np.unique(keys >> _U(SPAN), return_inverse=True)
        successors = (rank.astype(_U) << _U(SPAN)) | (keys & _below(SPAN))
        return {"shard": shard, "path": _save(folder, f"pairs-{shard:06d}", {"context": groups, "successor": successors}, {"least": least, "step": step}, {"log": codes})}

    spread = lambda keys: _spread(keys, shards)
    rows = _written(_counted(train, shards, spread, pairs_of), shards, write_pairs, "shard long, path string").collect()
    paths = {r["shard"]: r["path"] for r in rows}
    model.pairs = [paths.get(s) or write_pairs(s, none, np.zeros(0, np.int64))["path"] for s in range(shards)]
    return model


def score_texts(docs: DataFrame, model: NgramModel, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row: whole texts, null as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch, texts in batches_of_texts(batches, BATCH_BYTES):
            got = model.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[k]) for k in ("n_tokens", "n_known", "base_score", "score"))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = map_arrow(rows, run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
