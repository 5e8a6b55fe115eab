"""Packing token sequences into fixed lengths by the sum-of-squares rule.

Documents are tokenised and cut into pieces where they are read; only (id, piece, length) rows are dealt out, by a
hash of the id, to packers of some tens of thousands of pieces.  Token ids never leave the task that makes them.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of_texts, cut, map_arrow, sent, text_slices

CAPACITY = 2048
#: Pieces that one packer takes on average: enough that its last open sequences hardly count.
PACKER_PIECES = 50_000
#: Bytes of text that a worker encodes at once; it needs some thirty times as much.
SLICE_BYTES = 3 << 20
#: Documents in order that are packed together, about as many as a packer takes pieces.
RUN_DOCS = 40_000
#: A sequence's number: its window, its packer within it, its number within that.
_PACKER_BITS, _BIN_BITS = 21, 20
#: Words whose ids a worker keeps, in each of two generations.
CACHE_WORDS = 150_000

_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_LENGTHS = "doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Token ids of whole texts, as little-endian uint32 bytes, with the ids of words kept.

    For tokenizers whose pre-tokeniser drops white space: no token spans a space or line feed, so words between
    them can be encoded alone and looked up when they come again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> None:
        """Encodes words in one text; each token belongs to the word in which it starts."""
        coded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(coded.ids, "<u4").tobytes()
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.ids))
        last = 0
        for word, end in zip(words, (4 * np.searchsorted(starts, ends)).tolist()):
            self.young[word] = ids[last:end]
            last = end

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of ``words`` into the younger generation."""
        old = self.old
        self.young.update([(w, old[w]) for w in words if w in old])
        new = [w for w in words if w not in old]
        for i in range(0, len(new), 5000):
            self._encode_words(new[i : i + 5000])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text begins and the last ends."""
        plain = pc.replace_substring(texts.cast(pa.large_string()), "\n", " ")
        if not pc.any(pc.match_substring_regex(plain, r"<\||[A-Z]\p{M}")).as_py():
            # Case and marks after a letter make no difference to the tokens, but to how many words there are.  Not so
            # for special tokens, which begin with <|, and for capitals that only compose with an accent once small.
            plain = pc.replace_substring_regex(pc.ascii_lower(plain), "([a-z])([.,!%$&*#]+)", r"\1 \2")
        split = pc.split_pattern(plain, " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        coded = list(map(self.young.get, distinct))
        missing = [w for w, c in zip(distinct, coded) if c is None]
        if missing:
            self._learn(missing)
            coded = list(map(self.young.get, distinct))
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {"": b""}, self.young
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        known, first = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(size) - size
        number = words.indices.to_numpy(zero_copy_only=False)
        count = size[number]
        ends = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(first[number] - ends[:-1], count) + np.arange(ends[-1])
        offsets = split.offsets.to_numpy()
        return known[at], ends[offsets - offsets[0]]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, window: Column | None = None) -> DataFrame:
    """(window, doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut at ``capacity``.

    Null text counts as empty: one piece with the end id alone.  ``window``: the number, from 0, of what is packed together,
    see ``pack``; all documents without it.
    """
    within = (F.lit(0) if window is None else window).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), within.alias("window"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        gc.disable()  # long lists of words, but no cycles
        for batch in text_slices(batches, SLICE_BYTES):
            ids, at = encoder.encode_array(pc.fill_null(batch.column(1), b"").cast(pa.large_string()))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, within, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                coded = ids[a:b].tobytes() + end
                for k in range(0, len(coded), 4 * capacity):
                    part = coded[k : k + 4 * capacity]
                    for column, value in zip(out, (within, doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 2 else pa.int64()) for i, x in enumerate(out)], ["window", *_NAMES])

    return map_arrow(rows, run, "window long, " + _LENGTHS)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first, by the sum-of-squares rule.

    A piece goes to the open bin by which the sum over gaps of squared counts of open bins becomes least, among
    equal choices to the smallest gap; a new bin is opened where no open one has room.  Full bins aren't counted.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, s in zip(order.tolist(), lengths[order].tolist()):
        gap = capacity
        if s < capacity:
            here, after = count[s:capacity], count[: capacity - s].copy()
            after[0] = 0
            # The change of the sum: a bin leaves gap g and, unless full, comes to gap g - s.
            change = 2 * (after - here) + 2
            change[0] -= 1
            change[here == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if here[best]:
                gap = best + s
        if gap == capacity:
            b, at = made, 0
            made += 1
        else:
            b, at = open_bins[gap].pop(), capacity - gap
            count[gap] -= 1
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
        bins[i], offsets[i] = b, at
    return bins, offsets


def _pack_batches(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Packs rows of (group, doc_id, piece, start, length, ids_crc32), sorted by group, group by group."""
    held: list[pa.RecordBatch] = []

    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group = rows.column(0)[0].as_py()
        bins, offsets = sum_of_squares(rows.column(4).to_numpy(), capacity)
        if len(bins) and bins.max() >= 1 << _BIN_BITS:
            raise ValueError("too many sequences in one packer")
        numbers = (np.int64(group) << np.int64(_BIN_BITS)) + bins
        yield from pa.table([*rows.columns[1:], pa.array(numbers), pa.array(offsets)], [*_NAMES, "sequence_id", "offset"]).to_batches()

    for batch in batches:
        groups = batch.column(0).to_numpy()
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(groups[1:] != groups[:-1]) + 1):
            if not len(part):
                continue
            if held and held[0].column(0)[0].as_py() != groups[part[0]]:
                yield from packed(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(part[0], len(part)))
    if held:
        yield from packed(pa.Table.from_batches(held))


def pack(rows: DataFrame, capacity: int = CAPACITY, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """``pieces`` rows with sequence_id and offset; each sequence is gapless from 0.

    Pieces of one window are packed together, and numbers of sequences ascend with the window.  A window of many pieces is
    dealt to packers by a hash of id and piece, so a packer's memory doesn't grow with the table.  Ties between equal
    lengths go by id, so that a lost task's second run makes the same sequences.
    """
    rows = cut(rows)
    sizes = cut(rows.groupBy("window").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / packer_pieces).cast("long")).alias("_p")))
    packers = sizes.agg(F.sum("_p")).first()[0] or 1
    packer = F.pmod(F.xxhash64("doc_id", "piece"), F.col("_p"))
    group = F.shiftleft(F.col("window"), _PACKER_BITS).bitwiseOR(packer)
    dealt = rows.join(sent(sizes), "window").select(group.alias("_group"), *_NAMES)
    tasks = max(packers, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(dealt.repartition(tasks, "_group").sortWithinPartitions("_group", *_NAMES), lambda b: _pack_batches(b, capacity), _LENGTHS + ", sequence_id long, offset long")


def in_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_docs: int = RUN_DOCS) -> DataFrame:
    """(id, text, window) of documents in files: the number of a document's run of ``run_docs`` rows in the order of the files.

    Files follow each other by name, as a sorted table is written, so windows don't depend on how files are dealt to tasks.
    A table that isn't read from Parquet files has no such order and is one window.
    """
    try:
        placed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
        placed.schema  # noqa: B018 (resolves the columns)
    except AnalysisException:
        return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("window"))
    counts = placed.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    before = cut(counts.select("_f", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b")))
    return placed.join(sent(before), "_f").select("doc_id", "text", F.expr(f"(_b + _i) div {run_docs}").alias("window"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, window: Column | None = None) -> DataFrame:
    """Every piece of every document and its place: see ``pieces`` and ``pack``.

    An empty table gives no rows; documents that repeat an id are packed each for itself; a null id stays null.
    """
    return pack(pieces(docs, tokenizer, id_col, text_col, capacity, window=window), capacity)


def sequences(docs: DataFrame, placements: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the token ids themselves, in order of offset, for ids that occur once in ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        for batch, texts in batches_of_texts(batches):
            ids = [np.append(np.frombuffer(x, "<u4"), 0).astype(np.int32) for x in encoder.encode([t.decode("utf-8", "replace") for t in texts])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    coded = map_arrow(rows, run, "doc_id long, ids array<int>")
    placed = placements.join(coded, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
