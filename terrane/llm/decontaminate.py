"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A long document's own MinHash says nothing about a short item within it, so only the items are sketched: the smallest
hashes of an item's shingles are looked up among all shingles of the document (containment MinHash). Items are
partitioned by their number of shingles, and the partition sets the sketch's length: an item of at most m shingles gets
floor((1 - threshold) * m) + 1 hashes, of which a document that holds the threshold's share must hold one. The search
therefore misses nothing, and each candidate is then verified on the shingles themselves.

The sketches are a table. Documents are read once: a Bloom filter of the sketches' hashes, of bounded size whatever the
number of items, tells which shingles may be in the table, and only documents with such a shingle go on, to an
equi-join with it. Nothing of either table but that filter passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from terrane.functions.scratch import materialize
from terrane.llm.textmap import give_back, map_texts

#: All but ASCII letters and digits and the bytes of other characters separates words; A-Z in lower case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The filter of sketch hashes: bits for each hash, at most 2 to the power of the second in all (32 MB), and probes.
BITS_EACH, MOST_BITS, PROBES = 64, 28, 4
#: Items that are verified on one copy of a document's text, in the mean; the rest has further copies.
ITEMS_AT_ONCE = 256


def tokens(raw: bytes | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased; punctuation separates."""
    return (raw or b"").translate(_FOLD).split()


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """The k-word shingles in order, repeats included; none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return []
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.zeros(len(words), np.int64)
    np.cumsum(size[:-1] + 1, out=start[1:])
    return [text[i:j] for i, j in zip(start[:n].tolist(), (start + size)[k - 1 :].tolist())]


def _hashes(parts: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x) for x in parts], np.uint64)


def sketch(raw: bytes | None, k: int, threshold: float) -> tuple[int, int, list[int]]:
    """Shingle length (``k``; less for items of fewer words), number of distinct shingles, and the smallest hashes, as signed numbers."""
    words = tokens(raw)
    if not words:
        return 0, 0, []
    length = min(k, len(words))
    own = np.unique(_hashes(shingles(words, length)))
    part = math.ceil(math.log2(len(own))) if len(own) > 1 else 0
    return length, len(own), own[: math.floor((1 - threshold) * (1 << part) + 1e-9) + 1].view(np.int64).tolist()


def sketches(benchmark: DataFrame, k: int, threshold: float) -> DataFrame:
    """``item``, ``item_id``, ``raw``, ``length``, ``sketch`` of every distinct item that has a word; ``item`` numbers them."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
    found = map_texts(rows, "item_id", "text", lambda: lambda raw: sketch(raw, k, threshold), "length long, n long, sketch array<long>", types, keep=["text"])
    return found.where("n > 0").select(F.monotonically_increasing_id().alias("item"), F.col("doc_id").alias("item_id"), F.col("text").cast("binary").alias("raw"), "length", "sketch")


def hash_map(entries: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the ``n`` rows' hashes, 64 bits to a word; of at most ``2 ** MOST_BITS`` bits, whatever n."""
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(max(1, n) * BITS_EACH))))
    probes = F.array(*[F.expr(f"((hash >>> 32) + {k}L * ((hash & 4294967295L) | 1L)) & {(1 << bits) - 1}L") for k in range(PROBES)])
    at = entries.select(F.explode(probes).alias("at")).select(F.shiftright("at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at & 63L as int))").alias("bit"))
    rows = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    found = np.zeros(1 << (bits - 6), np.uint64)
    found[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return found


def may_hold(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold: all that it was made of, and few others."""
    high, low, last = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF) | np.uint64(1), np.uint64(len(known) * 64 - 1)
    at = np.arange(len(hashes))
    for k in range(PROBES):
        place = (high[at] + np.uint64(k) * low[at]) & last
        at = at[(known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _suspects(docs: DataFrame, lengths: list[int], known: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``doc``, ``doc_id``, ``raw``, ``hits`` (length and hash) of the documents with a shingle that may be in a sketch."""

    def make() -> Callable[[bytes | None], tuple]:
        def one(raw: bytes | None) -> tuple:
            words, hits = tokens(raw), []
            for length in lengths:
                hashes = _hashes(shingles(words, length))
                may = may_hold(known, hashes)
                hits += [{"length": length, "hash": h} for h in np.unique(hashes[may]).view(np.int64).tolist()]
            return (hits,) if hits else (None,)

        return one

    kind = pa.list_(pa.struct([("length", pa.int64()), ("hash", pa.int64())]))
    named = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = map_texts(named, "doc_id", "text", make, "hits array<struct<length:bigint,hash:bigint>>", [kind], keep=["text"])
    return found.where("hits IS NOT NULL").select(F.monotonically_increasing_id().alias("doc"), "doc_id", F.col("text").cast("binary").alias("raw"), "hits")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``item_id``, ``containment`` for every document and item of which it holds ``threshold`` or more.

    Containment is the share of the item's distinct ``k``-word shingles that occur in the document; an item of fewer
    words is one shingle of all its words. Items that are null or have no word match nothing, nor do such documents;
    repeated rows of ``docs`` give repeated rows, repeated items do not; a null id is returned as null; very long texts
    are read whole; empty tables give no rows. Other columns are ignored, whatever their names.
    """
    items = materialize(sketches(benchmark, k, threshold), "items")
    entries = items.select("item", "length", F.explode("sketch").alias("hash"))
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # at most k numbers
    known = hash_map(entries, entries.count())
    suspects = materialize(_suspects(docs, lengths, known, id_col, text_col), "suspects")
    pairs = suspects.select("doc", F.inline("hits")).join(entries, ["length", "hash"]).select("doc", "item").distinct()
    pairs = materialize(pairs, "pairs")
    # A document goes with as many items at once as fit a row, so that its text is copied and read once for each such part.
    parts = pairs.groupBy("doc").agg(F.ceil(F.count("*") / ITEMS_AT_ONCE).alias("parts"))
    given = pairs.join(parts, "doc").join(items.select("item", F.struct("item_id", "raw", "length").alias("i")), "item")
    given = given.groupBy("doc", F.pmod(F.xxhash64("item"), F.col("parts")).alias("part")).agg(F.collect_list("i").alias("items"))
    both = given.select("doc", "items").join(suspects.select("doc", "doc_id", F.col("raw").alias("text")), "doc")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for doc_id, text, listed in zip(*batch.columns):
                words, known = tokens(text.as_py()), {}
                for entry in listed.as_py():
                    length = entry["length"]
                    if length not in known:
                        known[length] = set(shingles(words, length))
                    item = set(shingles(tokens(entry["raw"]), length))
                    share = len(item & known[length]) / len(item)
                    if share >= threshold:
                        found.append((doc_id.as_py(), entry["item_id"], share))
            if found:
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["doc_id", "item_id", "containment"])
        give_back()

    return both.select("doc_id", "text", "items").mapInArrow(verify, "doc_id long, item_id long, containment double")
