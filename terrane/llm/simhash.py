"""SimHash near-duplicates: whole-text fingerprints, linked by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant that is within half the radius of both. Every distinct
fingerprint emits all such variants, the shuffle is on the variant, and what meets is deduplicated and verified.
The variants of a fingerprint are not shipped one by one: they are dealt by their leading bits, so the fingerprint
travels once to each leading pattern that its ball reaches (37 rows instead of 2,081 at 8 leading bits and radius 4),
and the receiving task expands just the variants that begin with that pattern. The number of leading bits follows the
number of distinct fingerprints, so that a pattern holds a bounded number of variants at any size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from terrane.functions.scratch import materialize
from terrane.llm.components import connected_components
from terrane.llm.textmap import give_back, map_texts

BITS = 64
#: Variants that one leading pattern should hold, on average.
PER_PATTERN = 1 << 21
#: Variants that a task expands at once.
EXPANDED = 1 << 23
#: A pattern is dealt by so many more bits if it holds over so many fingerprints, and so many times what patterns hold on average.
STEP, HOT, HOT_TIMES = 8, 1 << 16, 8


def shingle_hashes(raw: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of words, repeats included; of the whole if there are fewer words; none if there is none."""
    words = (raw or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.zeros(n, np.int64)
    np.cumsum(size[:-1] + 1, out=start[1:])
    end = start + size
    if n <= shingle:
        spans = [(0, len(text))]
    else:
        spans = zip(start[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[i:j], 42) for i, j in spans], np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The word whose bit b is set if it is set in over half of ``hashes``; zero for none."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # as many rows as a byte can count
            count += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(raw: bytes | None, shingle: int) -> int:
    """The SimHash of a text as a signed number: bit b is set if it is set in over half of its shingles' hashes."""
    return int(majority(shingle_hashes(raw, shingle)).astype(np.int64))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) for every row. Null and blank texts have fingerprint zero."""
    return map_texts(docs, id_col, text_col, lambda: lambda raw: (fingerprint(raw, shingle),), "fp long", [pa.int64()])


def _masks(width: int, most: int) -> np.ndarray:
    """All ``width``-bit masks with at most ``most`` bits set, as uint64."""
    if width <= 0:
        return np.zeros(1, np.uint64)
    sets = (c for r in range(most + 1) for c in itertools.combinations(range(width), r))
    return np.array([sum(1 << i for i in c) for c in sets], np.uint64)


def leading_bits(n: int, half: int) -> int:
    """Leading bits by which variants of ``n`` fingerprints are dealt."""
    ball = sum(math.comb(BITS, r) for r in range(half + 1))
    return min(28, max(4, math.ceil(math.log2(max(1.0, n * ball / PER_PATTERN)))))


def _meet(pattern: int, fps: np.ndarray, bits: int, half: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (indexes into ``fps``, distinct uint64) among the variants that begin with ``pattern``: a forest's edges.

    Where the variants are more than ``EXPANDED``, they are taken by further leading bits, one part after the other, so
    that memory stays bounded however many fingerprints meet in a pattern.
    """
    rest = BITS - bits
    far = np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(pattern)).astype(np.int64)
    sizes = [sum(math.comb(rest, r) for r in range(half - flipped + 1)) for flipped in range(half + 1)]
    if rest > 8 and len(fps) > 2 and sum(int((far == k).sum()) * n for k, n in enumerate(sizes)) > EXPANDED:
        a = b = np.zeros(0, np.int64)
        for sub in (2 * pattern, 2 * pattern + 1):
            at = np.flatnonzero(np.bitwise_count((fps >> np.uint64(rest - 1)) ^ np.uint64(sub)) <= half)
            x, y = _meet(sub, fps[at], bits + 1, half, radius)
            a, b = np.r_[a, at[x]], np.r_[b, at[y]]
        return _forest(len(fps), a, b)
    return _expanded(pattern, fps, bits, half, radius)


def _expanded(pattern: int, fps: np.ndarray, bits: int, half: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_meet`, with all variants at once."""
    rest = np.uint64(BITS - bits)
    far = np.bitwise_count((fps >> rest) ^ np.uint64(pattern)).astype(np.int64)
    low = fps & ((np.uint64(1) << rest) - np.uint64(1))
    values, owners = [], []
    for flipped in range(half + 1):
        at = np.flatnonzero(far == flipped)
        if len(at):
            masks = _masks(BITS - bits, half - flipped)
            values.append((masks[:, None] ^ low[at][None, :]).ravel())
            owners.append((at, len(masks)))
    if not values:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.concatenate(values)
    value_sorted = np.sort(value)
    twice = value_sorted[1:][value_sorted[1:] == value_sorted[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spread = np.uint64(0x9E3779B97F4A7C15)
    table = np.zeros(1 << 20, bool)
    table[(twice * spread) >> np.uint64(44)] = True
    hit = np.flatnonzero(table[(value * spread) >> np.uint64(44)])
    hit = hit[np.isin(value[hit], twice)]
    base = np.cumsum([0, *(len(a) * m for a, m in owners)])
    block = np.searchsorted(base, hit, side="right") - 1
    owner = np.empty(len(hit), np.int64)
    for k, (at, _) in enumerate(owners):
        mine = block == k
        owner[mine] = at[(hit[mine] - base[k]) % len(at)]
    order = np.lexsort((owner, value[hit]))
    owner, same = owner[order], value[hit][order]
    head = np.maximum.accumulate(np.where(np.r_[True, same[1:] != same[:-1]], np.arange(len(same)), 0))
    if radius % 2:  # members of a variant are within the next even radius only, so all pairs are compared
        a = b = np.zeros(0, np.int64)
        for k in range(1, len(owner)):
            near = head[k:] == head[:-k]
            if not near.any():
                break
            x, y = owner[:-k][near], owner[k:][near]
            right = (x != y) & (np.bitwise_count(fps[x] ^ fps[y]) <= radius)
            a, b = _forest(len(fps), np.r_[a, x[right]], np.r_[b, y[right]])
        return a, b
    a, b = owner[head], owner
    pair = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    a, b = pair[:, 0], pair[:, 1]
    right = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    return _forest(len(fps), a[right], b[right])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as nodes that span the same components."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (root[root] == root).all():
            root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return root[at], at


def _flips(value: Column, bits: int, most: int) -> Column:
    """The ``bits``-bit ``value`` with at most ``most`` bits flipped, in all ways."""
    return F.transform(F.array(*[F.lit(int(m)) for m in _masks(bits, most)]), lambda m: value.bitwiseXOR(m))


def _dealt(distinct: DataFrame, bits: int, half: int, most: int) -> DataFrame:
    """``bits``, ``pattern``, ``fp``, ``rep``: each fingerprint once for every leading pattern that its ball reaches.

    A pattern that more than ``most`` fingerprints reach is dealt again by ``STEP`` more of its bits, and again, so that a family of
    any size is the work of many tasks. What a pattern holds follows from counts of leading bits, before anything is dealt.
    """
    out, open_ = None, distinct.select("fp", "rep", F.lit(half).alias("left"), F.lit(None).cast("long").alias("under"))
    depth, step = bits, bits
    while True:
        rest = BITS - depth
        head = F.shiftrightunsigned("fp", rest).bitwiseAND(F.lit((1 << step) - 1))
        base = F.shiftleft(F.coalesce("under", F.lit(0).cast("long")), step)
        # At first all bits may be flipped, then what the bits above have left.
        reached = _flips(head, step, half) if out is None else F.get(F.array(*[_flips(head, step, n) for n in range(half + 1)]), F.col("left"))
        made = lambda df, keep: df.select(*keep, "left", head.alias("head"), base.alias("base"), F.explode(reached).alias("low")).select(
            F.lit(depth).alias("bits"), F.col("base").bitwiseOR(F.col("low")).alias("pattern"), *keep, (F.col("left") - F.bit_count(F.col("head").bitwiseXOR(F.col("low")))).alias("left")
        )
        tips = open_.groupBy(head.alias("h"), "under", "left").agg(F.count("*").alias("n"))
        tips = tips.select("n", F.shiftleft(F.col("h"), rest).alias("fp"), "under", "left")
        hot = made(tips, ["n"]).groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("pattern")
        dealt = made(open_, ["fp", "rep"])
        more = rest - STEP > 8 and not (hot := materialize(hot, "hot")).isEmpty()
        cold = dealt.join(hot, "pattern", "left_anti") if more else dealt
        cold = cold.select("bits", "pattern", "fp", "rep")
        out = cold if out is None else out.union(cold)
        if not more:
            return out
        again = dealt.join(hot, "pattern", "left_semi")
        open_ = materialize(again.select("fp", "rep", "left", F.col("pattern").alias("under")), "dealt")
        depth, step = depth + STEP, STEP


def links(distinct: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Edges (``a``, ``b``: the ``rep`` of two fingerprints) that connect all of ``distinct`` (``fp``, ``rep``) within ``radius``.

    ``n``: its row count. Of fingerprints that meet in one variant, which are within the radius of each other by the
    triangle inequality, each is linked to one, so a group of m makes m - 1 links and not m * m. At an odd radius they
    are within the next even one only: all pairs of a variant are then compared.
    """
    half, odd = divmod(radius, 2)
    half += odd  # an odd radius is met from the next even one; all pairs of a variant are verified
    bits = leading_bits(n, half)
    ball = sum(math.comb(BITS, r) for r in range(half + 1))
    dealt = _dealt(distinct, bits, half, max(HOT, HOT_TIMES * n * len(_masks(bits, half)) >> bits))
    shuffle = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffle, math.ceil(n * ball / (16 * PER_PATTERN)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns) for batch in batches]
        if not read:
            return
        depth, pattern, fp, rep = (np.concatenate(x) for x in zip(*read))
        order = np.lexsort((pattern, depth))
        depth, pattern, fp, rep = depth[order], pattern[order], fp[order].astype(np.int64).view(np.uint64), rep[order]
        cuts = [*np.flatnonzero(np.r_[True, (pattern[1:] != pattern[:-1]) | (depth[1:] != depth[:-1])]).tolist(), len(pattern)]
        for i, j in zip(cuts, cuts[1:]):
            if j - i > 1:
                x, y = _meet(int(pattern[i]), fp[i:j], int(depth[i]), half, radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[i:j][x]), pa.array(rep[i:j][y])], names=["a", "b"])
        del read, depth, pattern, fp, rep, order
        give_back()

    return dealt.repartition(parts, "bits", "pattern").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest ``doc_id`` reachable over links of ``radius`` bits) for every row.

    A bit is set if it is set in over half of the shingles' hashes: at exactly half it is not. Very long texts are read whole, their hashes
    counted in parts. Exact copies share a fingerprint and are one node, so they are never paired. Null and blank texts have fingerprint
    zero, which links like any other. A row whose id is null takes the component of its fingerprint, null if no other
    row has that fingerprint; it links nothing itself. Repeated rows are returned as often as they come; an empty
    table gives no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fp")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "rep")
    ends = distinct.where(F.col("rep").isNotNull())
    n = ends.count()
    # Two fingerprints may share a smallest id where an id repeats: such nodes are one.
    found = materialize(connected_components(links(ends, n, radius)), "comp")
    of = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str) -> Column:
    """A fingerprint column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
