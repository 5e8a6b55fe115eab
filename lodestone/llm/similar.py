"""Near duplicates by five-word Jaccard similarity: fingerprint links first, what they miss after them, all checked exactly.

Documents are sets of shingle hashes.  The trie self-join of their SimHash fingerprints links the closest.  A fingerprint of
64 bits can't reach down to a similarity of 0.8, where sets differ in ten bits on average, so documents also meet under the
least of their shingles in KEYS random orders: sets of that similarity agree in each with a chance of 0.8, and miss all
with 0.2 ** KEYS (4e-9).  Whichever way a pair was found, it counts only if the whole sets are similar.  Two filters, whose
chance of losing such a pair is 1e-7 each, spare most others that comparison.

A group of copies is linked by a pair or two a member: under each key, members are compared with one of them, and what that
leaves in different components is compared by its pairs that both filters pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, cut, fresh_key, map_arrow, release, row_mark, sent, without_repeats
from .components import connected_components
from .simhash import fingerprint_links, majority_bits, shingle_hashes

#: Similarity from which documents are near duplicates, as a fraction.
SIMILAR = (4, 5)
#: Random orders under whose least shingle documents meet.
KEYS = 12
#: Bits in which fingerprints of similar sets differ at most: more than 26 of 64, of 10 on average, have a chance of 1e-7.
WIDE_BUDGET = 26
#: Sets of fewer shingles give too few votes for a bit; their fingerprints don't rule a pair out.
FEW_SHINGLES = 32
#: Partners of one document that a task compares it with.
HUB_ROWS = 200
#: Bytes of a shingle's hash that are compared.
HASH_BYTES = 5

#: Random orders whose least elements, a byte of each, tell how similar two sets may be; at a similarity of 0.8 fewer than
#: AGREEING of them agree with a chance of 1e-7.
SIGNATURE, AGREEING = 128, 78
#: Members of a group that a task compares at once; larger groups are dealt out by pairs of parts.
GROUP_ROWS = 1000
#: Shingles of a part of a group, whose sets a task holds.
GROUP_SHINGLES = 2_000_000

_ODD, _ODD_2 = np.random.default_rng(31).integers(0, 1 << 63, (2, SIGNATURE), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles; a text of fewer words is one shingle, none give an empty set."""
    return np.unique(shingle_hashes(text, words))


def _packed(text: bytes, words: int) -> bytes:
    """A text's shingle set, HASH_BYTES of each hash."""
    short = np.unique(shingle_set(text, words) >> np.uint64(64 - 8 * HASH_BYTES))
    return short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def least_keys(s: np.ndarray) -> np.ndarray:
    """The least value of the set in each of SIGNATURE random orders."""

    def least(odd: np.ndarray, odd_2: np.ndarray) -> np.ndarray:
        y = s * odd[:, None]
        y ^= y >> np.uint64(32)
        y *= odd_2[:, None]
        return y.min(1)

    step = max(1, min(SIGNATURE, (1 << 18) // len(s)))
    return np.concatenate([least(_ODD[i : i + step], _ODD_2[i : i + step]) for i in range(0, SIGNATURE, step)])


def _prints(base: DataFrame, words: int, id_type: str) -> DataFrame:
    """(_id, _mark, sid, n, fp, keys, sig) of each row: sid is a hash of the whole set, keys are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_texts(batches):
            sets = [shingle_set(t, words) for t in texts]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.array([majority_bits(s) for s in sets], np.uint64).view(np.int64)
            least = [least_keys(s) if len(s) else None for s in sets]
            keys = pa.array([None if x is None else x[:KEYS].view(np.int64) for x in least], pa.list_(pa.int64()))
            sig = pa.array([None if x is None else (x >> np.uint64(24)).astype(np.uint8).tobytes() for x in least], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sid), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp), keys, sig], ["_id", "_mark", "sid", "n", "fp", "keys", "sig"])

    return map_arrow(base.select("_id", "_t", "_mark"), run, f"_id {id_type}, _mark long, sid long, n int, fp long, keys array<long>, sig binary")


def _may_be_similar(n: Column, m: Column, fp: Column, other: Column) -> Column:
    """By size, and by the fingerprints' differing bits where the sets aren't small."""
    a, b = SIMILAR
    near = (F.bit_count(fp.bitwiseXOR(other)) <= WIDE_BUDGET) | (F.least(n, m) < FEW_SHINGLES)
    return (a * F.greatest(n, m) <= b * F.least(n, m)) & near


def _similar(pairs: DataFrame, base: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose whole sets are similar.

    The shingles of each v go to the task of its u, those of a u to as many tasks as its partners need.
    """
    pairs = cut(pairs.select("u", "v").distinct())
    many = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("_g")).filter("_g > 1").select(fresh_key(F.col("u")).alias("_k"), "_g")
    part = F.pmod(F.xxhash64("v", F.lit("part")), F.coalesce("_g", F.lit(1)))
    dealt = pairs.withColumn("_k", fresh_key(F.col("u"))).join(many, "_k", "left").select("u", "v", F.xxhash64("u", part).alias("t"))
    roles = dealt.select(F.col("v").alias("sid"), "t", F.lit(1).alias("kind")).union(dealt.select(F.col("u").alias("sid"), "t", F.lit(0).alias("kind")).distinct())
    one = reps.select(fresh_key(F.col("sid")).alias("_s"), fresh_key(F.col("one._id"), F.col("one._mark")).alias("_k"))
    roles = cut(roles.withColumn("_s", fresh_key(F.col("sid"))).join(one, "_s").select("_k", "sid", "t", "kind"))
    wanted = base.select(fresh_key(F.col("_id"), F.col("_mark")).alias("_k"), "_t").join(sent(roles), "_k").select("sid", "_t", "t", "kind")
    a, b = SIMILAR

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_texts(batches):
            bits = [_packed(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(0), pa.array(bits, pa.binary())], ["t", "kind", "sid", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = hub = own = None
        for batch in batches:
            u, v = [], []
            for t, kind, sid, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if t != task:
                        task, hub, own = t, sid, _unpacked(data)
                    continue
                other = _unpacked(data)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if b * both >= a * (len(own) + len(other) - both):
                    u.append(hub)
                    v.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = map_arrow(wanted, sets, "t long, kind int, sid long, s binary")
    found = cut(map_arrow(packed.repartition(parts, "t").sortWithinPartitions("t", "kind"), compare, "u long, v long").distinct())
    release(base.sparkSession)
    return found


def _open_groups(cells: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows (g, i, sid, n, fp, c) of the groups whose members lie in several components c."""
    if found is None:
        placed = cells.select("g", "i", "sid", "n", "fp", F.col("sid").alias("c"))
    else:
        comp = found.select(fresh_key(F.col("node")).alias("_k"), "component")
        placed = cells.withColumn("_k", fresh_key(F.col("sid"))).join(comp, "_k", "left").select("g", "i", "sid", "n", "fp", F.coalesce("component", "sid").alias("c"))
    split = placed.groupBy("g").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a != b").select(fresh_key(F.col("g")).alias("_k"))
    return cut(placed.withColumn("_k", fresh_key(F.col("g"))).join(split, "_k", "left_semi").drop("_k"))


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """(u, v): for each sid v the member that leads most of its groups, if the two may be similar."""
    lead = F.min(F.struct(F.xxhash64("sid").alias("o"), F.col("sid").alias("u"), F.col("n").alias("un"), F.col("fp").alias("ufp"), F.col("c").alias("uc")))
    hubs = rows.groupBy("g").agg(lead.alias("x")).select(fresh_key(F.col("g")).alias("_k"), "x.*")
    met = rows.withColumn("_k", fresh_key(F.col("g"))).join(hubs, "_k").filter((F.col("c") != F.col("uc")) & _may_be_similar(F.col("n"), F.col("un"), F.col("fp"), F.col("ufp")))
    times = met.groupBy("sid", "u").agg(F.count(F.lit(1)).alias("times"))
    return times.groupBy("sid").agg(F.max(F.struct("times", "u"))["u"].alias("u")).select("u", F.col("sid").alias("v"))


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task t, from batches sorted by t, their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        for own in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
            if not len(own):
                continue
            if held and held[0].column(0)[0].as_py() != key[own[0]]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(own[0], len(own)))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, mask over all rows) of blocks of a group's rows: which pairs of them may be similar.

    Members of one component aren't a pair, nor are members that meet in the group of another key before, nor, where a task
    holds two parts of a group, members of one part.
    """
    a, b = SIMILAR
    sid, n, c, part = (t.column(k).to_numpy() for k in ("sid", "n", "c", "part"))
    key = t.column("i")[0].as_py()
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, KEYS)
    fp = t.column("fp").to_numpy().view(np.uint64)
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
    across = (part != part[0]).any()
    for i in range(0, len(sid), 256):
        x = slice(i, i + 256)
        least, most = np.minimum(n[x, None], n), np.maximum(n[x, None], n)
        near = (sid[x, None] < sid) & (c[x, None] != c) & (a * most <= b * least)
        near &= (np.bitwise_count(fp[x, None] ^ fp) <= WIDE_BUDGET) | (least < FEW_SHINGLES)
        if across:
            near &= part[x, None] != part
        u, v = np.nonzero(near)
        for k in range(0, len(u), 1 << 16):
            p, q = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
            near[p, q] = ((sig[p + i] == sig[q]).sum(1) >= AGREEING) & ((keys[p + i] == keys[q]).argmax(1) == key)
        yield i, near


def _spanning_links(t: pa.Table) -> tuple[list[int], list[int]]:
    """Links between rows of a group whose whole sets are similar, as many as join what they can join and no more.

    One row's set is held against all its candidates' at once; those that a link has joined to it since are no candidates.
    """
    a, b = SIMILAR
    sid = t.column("sid").to_numpy()
    root = np.unique(t.column("c").to_numpy(), return_inverse=True)[1]
    data = t.column("s").to_pylist()
    size = np.array([len(x) // HASH_BYTES for x in data])
    start = np.cumsum(size) - size
    code = np.unique(_unpacked(b"".join(data)), return_inverse=True)[1].astype(np.int32)
    own = np.zeros(code.max() + 1, bool)
    us, vs = [], []
    for i, near in _candidates(t):
        for u in np.flatnonzero(near.any(1)):
            v = np.flatnonzero(near[u] & (root != root[u + i]))
            if not len(v):
                continue
            mine = code[start[u + i] : start[u + i] + size[u + i]]
            own[mine] = True
            first = np.cumsum(size[v]) - size[v]
            both = np.add.reduceat(own[code[np.repeat(start[v] - first, size[v]) + np.arange(size[v].sum())]], first, dtype=np.int64)
            own[mine] = False
            for w in v[b * both >= a * (len(mine) + size[v] - both)]:
                if root[w] != root[u + i]:
                    us.append(sid[u + i])
                    vs.append(sid[w])
                    root[root == root[w]] = root[u + i]
    return us, vs


def _group_links(rows: DataFrame, reps: DataFrame, base: DataFrame, words: int) -> DataFrame:
    """(u, v): links that join all members of a group which are similar and lie in different components.

    A task first finds the members with a candidate by fingerprints and signatures; only their sets are sent to a second one.  A
    group of more than GROUP_ROWS members or GROUP_SHINGLES shingles is dealt out by pairs of its parts.  Neither task returns
    pairs: the first gives members, the second a spanning forest.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    more = reps.select(fresh_key(F.col("sid")).alias("_k"), "sig", "keys")
    need = F.greatest(F.count(F.lit(1)) / GROUP_ROWS, F.sum(F.col("n").cast("long")) / GROUP_SHINGLES)
    sizes = rows.groupBy("g").agg(F.ceil(need).cast("int").alias("p")).filter("p > 1").select(fresh_key(F.col("g")).alias("_k"), "p")
    sized = rows.withColumn("_k", fresh_key(F.col("g"))).join(sizes, "_k", "left").drop("_k")
    sized = sized.withColumn("part", F.coalesce(F.pmod(F.xxhash64("sid", F.lit("part")), F.col("p")).cast("int"), F.lit(0)))
    tasks = F.when(F.col("p").isNull(), F.array(F.lit(-1))).otherwise(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.least(j, F.col("part")) * F.col("p") + F.greatest(j, F.col("part"))))
    columns = ["i", "sid", "n", "fp", "c", "part", "sig", "keys"]
    dealt = sized.withColumn("_k", fresh_key(F.col("sid"))).join(more, "_k").select(F.explode(tasks).alias("j"), "g", *columns).select(F.xxhash64("g", "j").alias("t"), *columns)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_task(batches):
            some = np.zeros(len(t), bool)
            for i, near in _candidates(t):
                some[i : i + len(near)] |= near.any(1)
                some |= near.any(0)
            yield from t.filter(pa.array(some)).to_batches()

    wanted = cut(map_arrow(dealt.repartition(parts, "t").sortWithinPartitions("t"), members, dealt.schema))
    release(spark)
    one = reps.select(fresh_key(F.col("sid")).alias("_s"), "sid", fresh_key(F.col("one._id"), F.col("one._mark")).alias("_k"))
    seen = cut(wanted.select(fresh_key(F.col("sid")).alias("_s")).distinct().join(one, "_s").select("_k", "sid"))
    texts = base.select(fresh_key(F.col("_id"), F.col("_mark")).alias("_k"), "_t").join(sent(seen), "_k").select("sid", "_t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, whole in batches_of_texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(t, words) for t in whole], pa.binary())], ["sid", "s"])

    # Rows that agree in id and mark are one text, several times.
    held = map_arrow(texts, sets, "sid long, s binary").groupBy("sid").agg(F.first("s").alias("s")).select(fresh_key(F.col("sid")).alias("_k"), "s")
    whole = wanted.withColumn("_k", fresh_key(F.col("sid"))).join(held, "_k").select("t", *columns, "s")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_task(batches):
            u, v = _spanning_links(t)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    found = cut(map_arrow(whole.repartition(parts, "t").sortWithinPartitions("t"), links, "u long, v long"))
    release(spark)
    return found


def similar_components(base: DataFrame, words: int, id_type: str, budget: int = 4) -> tuple[DataFrame, DataFrame]:
    """(prints, components of sids over all similar pairs).  ``base``: _id, _mark, _t."""
    prints = cut(_prints(base, words, id_type))
    reps = cut(prints.filter("n > 0").groupBy("sid").agg(F.min(F.struct("_id", "_mark")).alias("one"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sig").alias("sig")))
    # Equal fingerprints, and fingerprints within the trie's budget.
    firsts = reps.groupBy("fp").agg(F.min("sid").alias("rep"))
    same = reps.withColumn("_k", fresh_key(F.col("fp"))).join(firsts.select(fresh_key(F.col("fp")).alias("_k"), "rep"), "_k").filter("sid != rep").select(F.col("rep").alias("u"), F.col("sid").alias("v"))
    close = same.union(fingerprint_links(cut(firsts), budget))
    # Groups of sets with a least shingle in common.
    cells = reps.select("sid", "n", "fp", F.posexplode("keys").alias("i", "key")).select(F.xxhash64("i", "key").alias("g"), "i", "sid", "n", "fp")
    cells = _open_groups(cells, None).drop("c")
    alone = cells.withColumn("c", F.col("sid"))
    near = _similar(close.union(_hub_pairs(alone)), base, reps, words)
    rest = _open_groups(cells, connected_components(near))
    return prints, connected_components(near.union(_group_links(rest, reps, base, words)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, budget: int = 4) -> DataFrame:
    """``docs`` with one row of each component of documents whose shingles have Jaccard similarity 0.8 or more.

    The row with the least id stays; a null id loses to any other, and among equal or null ids the least hash of the whole
    row stays.  Rows that repeat an id with different texts are looked at each for itself.  Null text counts as empty, and
    texts without words are one group.  An empty table gives no rows.  Columns are unchanged.
    """
    base = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), row_mark(docs).alias("_mark"), F.col(text_col).cast("string").cast("binary").alias("_t"))
    prints, comp = similar_components(base, words, docs.schema[id_col].dataType.simpleString(), budget)
    comp = comp.select(fresh_key(F.col("node")).alias("_k"), "component")
    placed = prints.select("_id", "_mark", "sid", fresh_key(F.col("sid")).alias("_k")).join(comp, "_k", "left").select("_id", "_mark", F.coalesce("component", "sid").alias("_g"))
    return without_repeats(base, placed, F.struct(F.col("_id").isNull(), "_id", "_mark"), docs.columns)
