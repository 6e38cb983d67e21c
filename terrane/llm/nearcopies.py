"""Near copies by Jaccard similarity of word shingles, found by ball hashing of SimHash fingerprints, verified on the shingles.

Texts of a similarity of 0.8 differ in some 15 % of a SimHash's bits, far beyond any ball that can be emitted for 64
bits. So a text has many short fingerprints, each a choice of bits from one pool of 1,024, and each with a ball of radius
1: texts meet where any fingerprint of theirs differs in at most 2 bits. How wide the fingerprints are follows from the
number of texts, so that chance meetings stay rare; how many they are follows from the width, so that a pair at the
threshold meets with the same probability at every size. What meets is compared on further bits, and only what has the
similarity on the exact shingle sets is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from terrane.functions.scratch import materialize
from terrane.llm.components import connected_components
from terrane.llm.simhash import BITS, _forest, shingle_hashes
from terrane.llm.textmap import give_back, map_texts

#: 64-bit words of a signature, and the distance within which a short fingerprint's balls of radius 1 meet.
WORDS, NEAR = 16, 2
#: Share of pairs at the threshold that meet; texts that a variant of one fingerprint holds by chance, at most.
RECALL, CHANCE = 0.97, 1 / 4
#: Rows of one fingerprint and leading pattern, on average, and variants that a task expands at once.
PER_BUCKET, EXPANDED = 1 << 18, 1 << 22
#: Members of a variant up to which all pairs are compared at once; more belong to a crowd.
SMALL = 4
#: Members of a crowd that one task compares with each other; of more, it compares two blocks of half as many.
BLOCK = 1 << 11


def signature(raw: bytes | None, shingle: int, words: int = WORDS) -> tuple[bytes, int, int]:
    """``words`` independent fingerprints of the set of shingles, 8 bytes each; the set's size and its hash."""
    hashes = np.unique(shingle_hashes(raw, shingle))
    count = np.zeros((words, BITS), np.int64)
    steps = np.arange(words, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        part = _mixed(hashes[None, at : at + 255] + steps)
        bits = np.unpackbits(part.view(np.uint8).reshape(words, -1, 8), axis=2, bitorder="little")
        count += np.add.reduce(bits, axis=1, dtype=np.uint8)
    sig = np.packbits(2 * count > len(hashes), axis=1, bitorder="little").tobytes()
    return sig, len(hashes), xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def differing(similarity: float) -> float:
    """Share of bits in which sets of equal size and this Jaccard similarity differ: their angle in half turns."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_differing(similarity: float, bits: int, deviations: float) -> int:
    """Bits in which such sets differ, and so many standard deviations."""
    share = differing(similarity)
    return math.floor(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def tables_for(n: int, similarity: float) -> tuple[int, int]:
    """Width and number of the fingerprints of ``n`` texts."""
    width = 24
    while width < 48 and n * (width + 1) / 2**width > CHANCE:
        width += 1
    # As all fingerprints choose from one pool, the mean is over how many of its bits differ.
    pool, p = WORDS * BITS, differing(similarity)
    missed = [sum(math.comb(d, r) * math.comb(pool - d, width - r) for r in range(NEAR + 1)) / math.comb(pool, width) for d in range(pool + 1)]
    missed = 1 - np.array(missed)
    chance = lambda d: math.lgamma(pool + 1) - math.lgamma(d + 1) - math.lgamma(pool - d + 1) + d * math.log(p) + (pool - d) * math.log(1 - p)
    odds = np.exp([chance(d) for d in range(pool + 1)])
    tables = 1
    while odds @ missed**tables > 1 - RECALL:
        tables += 1
    return width, tables


def chosen_bits(width: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pool, the bits of each fingerprint, and 64 others that its meetings are checked on."""
    pool, draw = WORDS * BITS, np.random.default_rng(64)
    keys, checks = [], []
    while len(keys) < tables:
        order = draw.permutation(pool)
        for at in range(0, pool - width + 1, width):
            keys.append(order[at : at + width])
            checks.append(np.roll(order, -at - width)[:BITS])
    return np.array(keys[:tables]), np.array(checks[:tables])


def _packed(bits: np.ndarray) -> np.ndarray:
    """The last axis, of at most 64 bits, as one uint64."""
    room = np.zeros((*bits.shape[:-1], BITS), np.uint8)
    room[..., : bits.shape[-1]] = bits
    return np.packbits(room, axis=-1, bitorder="little").view(np.uint64)[..., 0]


def collisions(keys: np.ndarray, checks: np.ndarray, reps: np.ndarray, pattern: int, bits: int, width: int, limit: int, table: int = 0) -> np.ndarray:
    """Rows of what meets among those whose balls of radius 1 have variants that begin with ``pattern``, each once.

    Of up to ``SMALL`` that share a variant, all pairs come, as (0, smaller id, larger id, 0). Where more share one, each
    comes with the smallest id that it shares such a variant with, and as a member (crowd, id, key, place) of the crowd of
    all that are connected by such variants, where the place tells the pattern, after a leading 1: two members have met if their keys differ in ``NEAR`` bits or less. Pairs of
    more than ``limit`` differing check bits are left out. More than ``EXPANDED`` variants are taken part by part.
    """
    low_bits = width - bits
    near = (keys >> np.uint64(low_bits)) == np.uint64(pattern)
    if low_bits > 1 and int(near.sum()) * low_bits > EXPANDED:
        parts = []
        for sub in (2 * pattern, 2 * pattern + 1):
            at = np.bitwise_count((keys >> np.uint64(low_bits - 1)) ^ np.uint64(sub)) <= 1
            parts.append(collisions(keys[at], checks[at], reps[at], sub, bits + 1, width, limit, table))
        return np.unique(np.concatenate(parts), axis=0)
    low = keys & np.uint64((1 << low_bits) - 1)
    inside = np.flatnonzero(near)
    masks = np.array([0, *(1 << i for i in range(low_bits))], np.uint64)
    value = np.concatenate([(masks[:, None] ^ low[inside][None, :]).ravel(), low[~near]])
    owner = np.concatenate([np.tile(inside, len(masks)), np.flatnonzero(~near)])
    order = np.argsort(value)
    value = value[order]
    same = value[1:] == value[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    value, owner = value[shared], owner[order[shared]]
    order = np.lexsort((reps[owner], value))
    value, owner = value[order], owner[order]
    if not len(value):
        return np.zeros((0, 4), np.int64)
    start = np.r_[True, value[1:] != value[:-1]]
    at = np.flatnonzero(start)
    size = np.diff(np.r_[at, len(value)])
    first, sizes = np.repeat(at, size), np.repeat(size, size)
    pairs = []
    for k in range(1, SMALL):
        x = np.flatnonzero((first[k:] == first[:-k]) & (sizes[k:] <= SMALL))
        pairs.append((owner[x], owner[x + k]))
    many = sizes > SMALL
    a, b = owner[first[many]], owner[many]
    head = np.arange(len(keys))
    smallest = reps.copy()
    np.minimum.at(smallest, b, reps[a])
    starts = smallest[b] == reps[a]
    pairs.append((a[starts], b[starts]))
    a, b = _forest(len(keys), a, b)
    head[b] = a  # each member has its component's smallest index
    crowd = np.unique(owner[many])
    place = np.uint64(xxhash.xxh64_intdigest(f"{table} {bits} {pattern}"))
    number = _mixed(reps[head[crowd]].astype(np.uint64) ^ place).view(np.int64) | 1  # never 0
    members = np.stack([number, reps[crowd], keys[crowd].view(np.int64), np.full(len(crowd), 1 << bits | pattern)], 1)
    a, b = (np.concatenate([x[k] for x in pairs]) for k in range(2))
    good = (reps[a] != reps[b]) & (np.bitwise_count(checks[a] ^ checks[b]) <= limit)
    none = np.zeros(int(good.sum()), np.int64)
    found = np.stack([none, reps[a[good]], reps[b[good]], none], 1)
    return np.unique(np.concatenate([found, members]), axis=0)


def first_meeting(keys: np.ndarray, x: int, key: int, bits: int, pattern: int, width: int) -> np.ndarray:
    """Of all rows of ``keys`` (one column for each fingerprint), those that meet row ``x`` here and nowhere before.

    Here is the fingerprint in which ``x`` has ``key``, and among the variants that two keys share, the smallest one's pattern.
    """
    near = np.bitwise_count(keys ^ keys[x]) <= NEAR
    first = np.argmax(near, axis=1)
    rows = np.arange(len(keys))
    mine, other = keys[x][first], keys[rows, first]
    apart = mine ^ other
    one = apart & (~apart + np.uint64(1))  # its lowest bit
    two = np.bitwise_count(apart) == 2
    variant = np.where(two, np.minimum(mine ^ one, other ^ one), np.minimum(mine, other))
    return near.any(axis=1) & (mine == np.uint64(key)) & (variant >> np.uint64(width - bits) == np.uint64(pattern))


def _met(ends: DataFrame, n: int, similarity: float) -> DataFrame:
    """``crowd``, ``a``, ``b``, ``place`` of all texts that meet, as :func:`collisions` has them."""
    width, tables = tables_for(n, similarity)
    key_bits, check_bits = chosen_bits(width, tables)
    limit = most_differing(similarity, BITS, 3)
    bits = 2
    while n * (1 + bits) >> bits > PER_BUCKET:
        bits += 1
    masks = np.array([0, *(1 << i for i in range(bits))], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                pool = np.unpackbits(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, WORDS * 8), axis=1, bitorder="little")
                keys, checks = (_packed(pool[:, chosen]).view(np.int64) for chosen in (key_bits, check_bits))
                bucket = ((keys >> (width - bits))[:, :, None] ^ masks) + (np.arange(tables, dtype=np.int64) << bits)[None, :, None]
                reps = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                columns = [np.broadcast_to(x, bucket.shape) for x in (bucket, keys[:, :, None], checks[:, :, None], reps[:, None, None])]
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in columns], names=["bucket", "key", "check", "rep"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns) for batch in batches]
        if not read:
            return
        bucket, key, check, rep = (np.concatenate(x) for x in zip(*read))
        del read
        order = np.argsort(bucket, kind="stable")
        bucket, key, check, rep = bucket[order], key[order].view(np.uint64), check[order].view(np.uint64), rep[order]
        cuts = [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist(), len(bucket)]
        for i, j in zip(cuts, cuts[1:]):
            table, pattern = int(bucket[i]) >> bits, int(bucket[i]) & ((1 << bits) - 1)
            rows = collisions(key[i:j], check[i:j], rep[i:j], pattern, bits, width, limit, table)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], names=["crowd", "a", "b", "place"])
        del bucket, key, check, rep, order
        give_back()

    parts = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), tables << bits)
    dealt = ends.select("sig", "rep").mapInArrow(deal, "bucket long, key long, check long, rep long").repartition(parts, "bucket")
    return materialize(dealt.mapInArrow(meet, "crowd long, a long, b long, place long").distinct(), "met")


def _alike(pairs: DataFrame, ends: DataFrame, limit: int, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose signatures and sizes do not rule the similarity out."""
    first = ends.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("size").alias("size_a"))
    second = ends.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("size").alias("size_b"))
    both = pairs.join(first, "a").join(second, "b").where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, WORDS) for k in (2, 3))
            good = pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) that have the similarity on their exact shingle sets."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("set_a")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("hashes").alias("set_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose ends ``a`` and ``b`` do not have one label; a text without label is its own."""
    one, two = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    return both.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select(*pairs.columns)


def _within_crowds(members: DataFrame, labels: DataFrame, ends: DataFrame, n: int, limit: int, similarity: float) -> DataFrame:
    """Pairs (``a``, ``b``) of different labels with alike signatures that have met in a crowd (``crowd``, ``rep``, ``key``, ``place``).

    Of the many crowds in which a pair may have met, the first tells it.
    """
    width, tables = tables_for(n, similarity)
    key_bits, _ = chosen_bits(width, tables)
    named = members.join(labels, F.col("rep") == F.col("node"), "left").select("crowd", "rep", "key", "place", F.coalesce("label", "rep").alias("label"))
    named = materialize(named, "members")
    sizes = named.groupBy("crowd").agg(F.count("*").alias("many"), (F.min("label") != F.max("label")).alias("open")).where("open")
    blocks = F.ceil(F.col("many") / (BLOCK // 2)).cast("int")
    sizes = sizes.select("crowd", F.when(F.col("many") > BLOCK, blocks).otherwise(1).alias("n"))
    # Each two blocks of a crowd meet in one task, and so do the members of each block.
    mine = F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")
    others = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("n") - 1), F.col("mine")))
    dealt = named.join(sizes, "crowd").withColumn("mine", mine).select("crowd", "rep", "key", "place", "label", "mine", F.explode(others).alias("other"))
    dealt = dealt.select(F.xxhash64("crowd", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "rep", "key", "place", "label")
    rows = dealt.join(ends.select("rep", "sig", "size"), "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(*(b.column(k).to_numpy() for k in range(6)), b"".join(b.column(6).to_pylist())) for b in batches if b.num_rows]
        if not read:
            return
        task, rep, size, label, key, place = (np.concatenate([x[k] for x in read]) for k in range(6))
        sigs = np.frombuffer(b"".join(x[6] for x in read), np.uint64).reshape(-1, WORDS)
        del read
        order = np.argsort(task, kind="stable")
        cuts = [*np.flatnonzero(np.r_[True, np.diff(task[order]) != 0]).tolist(), len(task)]
        for i, j in zip(cuts, cuts[1:]):
            at = order[i:j]
            for k in range(len(at) - 1):
                x, left = at[k], at[k + 1 :]
                left = left[(np.bitwise_count(key[left] ^ key[x]) <= NEAR) & (label[left] != label[x])]
                left = left[np.minimum(size[left], size[x]) >= similarity * np.maximum(size[left], size[x]) - 1e-6]
                left = left[np.bitwise_count(sigs[left] ^ sigs[x]).sum(axis=1, dtype=np.int64) <= limit]
                if len(left):
                    both, bits = np.r_[x, left], int(place[x]).bit_length() - 1
                    keys = _packed(np.unpackbits(sigs[both].view(np.uint8), axis=1, bitorder="little")[:, key_bits])
                    y = rep[left[first_meeting(keys, 0, int(key[x]), bits, int(place[x]) ^ (1 << bits), width)[1:]]]
                    ends_of = [np.minimum(y, rep[x]), np.maximum(y, rep[x])]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in ends_of], names=["a", "b"])
        del task, rep, size, label, key, place, sigs, order
        give_back()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("task", "rep", "size", "label", "key", "place", "sig").repartition(parts, "task").mapInArrow(compare, "a long, b long").distinct()


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``component_id`` (smallest ``doc_id`` reachable) for every row, over links of ``similarity`` or more.

    The similarity is Jaccard's, of the sets of ``shingle``-word shingles (A-Z lower-cased); a text of fewer words has one
    shingle, and texts without words are copies of each other. A link is told only if the exact sets have the similarity.
    A pair at the threshold is found with a probability of some ``RECALL``, at any number of texts; a pair at 0.85
    practically always. Texts that meet are linked to the smallest id there first; where that leaves a crowd in
    several parts, all of its members that met are compared across the parts, so that texts in between hide nothing. A
    family of m texts that all lie just below the threshold is therefore compared in full, in blocks.

    Equal sets are one node, so exact copies are never paired. A row whose id is null takes the component of its set,
    null if no other row has it; it links nothing itself. Rows that repeat an id are one node where that id is the
    smallest of its set. Repeated rows are returned as often as they come; an empty table gives no rows; very long texts
    are read whole. Other columns of ``docs`` are ignored, whatever their names.
    """
    types = [pa.binary(), pa.int64(), pa.int64()]
    signed = map_texts(docs, id_col, text_col, lambda: lambda raw: signature(raw, shingle), "sig binary, size long, set_id long", types)
    signed = materialize(signed, "sig")
    distinct = materialize(signed.groupBy("sig", "set_id").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size")), "sig-rep")
    ends = distinct.where(F.col("rep").isNotNull() & (F.col("size") > 0))
    n = ends.count()
    met = _met(ends, n, similarity)
    limit = most_differing(similarity, WORDS * BITS, 2.5)

    pairs, members = met.where("crowd = 0").select("a", "b"), met.where("crowd <> 0").select("crowd", F.col("a").alias("rep"), F.col("b").alias("key"), "place")

    # The shingle sets of all that meet anything.
    named = pairs.select("a").union(pairs.select("b")).union(members.select("rep")).distinct().withColumnRenamed("a", "doc_id")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(named, "doc_id", "left_semi")
    hashes = lambda raw: (np.unique(shingle_hashes(raw, shingle)).tobytes(),)
    sets = map_texts(texts, "doc_id", "text", lambda: hashes, "hashes binary", [pa.binary()]).withColumnRenamed("doc_id", "rep")
    sets = materialize(sets.dropDuplicates(["rep", "hashes"]), "sets")

    # Each text against the smallest id that it meets; then all else that this has not linked.
    alike = materialize(_alike(pairs, ends, limit, similarity), "alike")
    heads = alike.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    linked = materialize(_verified(heads, sets, similarity).distinct(), "linked")
    up = linked.select(F.col("b").alias("node"), F.col("a").alias("label"))
    higher = linked.select(F.col("b").alias("label"), F.col("a").alias("over"))
    labels = materialize(up.join(higher, "label", "left").select("node", F.coalesce("over", "label").alias("label")), "labels")
    others = alike.join(heads, ["a", "b"], "left_anti")
    rest = _across(others, labels).union(_within_crowds(members, labels, ends, n, limit, similarity)).distinct()
    more = materialize(_verified(rest, sets, similarity), "more")
    found = materialize(connected_components(linked.union(more)), "comp")
    of = distinct.join(found, distinct.rep == found.node, "left").select("sig", "set_id", F.coalesce("component", "rep").alias("component_id"))
    return signed.join(of, ["sig", "set_id"]).select("doc_id", "component_id")
