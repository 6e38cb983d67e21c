"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier predicts each bit, and decoding takes the codeword of the
least loss, weighted by how well a bit's classifier tells its languages apart. A small lead over the second is flagged.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terrane.llm.textmap import map_texts

#: Labelled rows that the n-gram statistics are taken from at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
BINS, EXHAUSTIVE_UP_TO, SHARPNESS, MIN_LEAD = 1 << 14, 6, 4.0, 0.2
#: A-Z in lower case; all else that is ASCII and no letter separates; other characters stay as UTF-8 bytes.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(raw: bytes) -> bool:
    folded = raw.translate(_FOLD)
    if raw.isascii():
        return not folded.isspace() and bool(folded)
    return any(97 <= b <= 122 for b in folded) or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def ngrams(raw: bytes) -> np.ndarray:
    """Bins of all byte bigrams and trigrams within and at the ends of words."""
    folded = b" " + b" ".join(raw.translate(_FOLD).split()) + b" "
    a = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    two = (a[:-1] << np.uint32(8)) | a[1:]
    three = (two[:-1] << np.uint32(8)) | a[2:]
    shift = np.uint32(32 - int(math.log2(BINS)))
    return np.concatenate([(two * np.uint32(0x85EBCA6B)) >> shift, (three * np.uint32(0x9E3779B1)) >> shift])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """An ``n`` x bits matrix of -1 and 1: all distinct splits for few languages, else random columns of a fixed seed.

    Two or three languages have codewords that are 1 or 2 bits apart, so that no wrong bit is corrected there; four are
    4 apart, and a single wrong bit does no harm.
    """
    if n <= EXHAUSTIVE_UP_TO:
        columns = [[1, *(1 if m >> k & 1 else -1 for k in range(n - 1))] for m in range((1 << (n - 1)) - 1)]
    else:
        draw, columns = random.Random(seed), []
        while len(columns) < math.ceil(10 * math.log2(n)):
            column = [draw.choice((-1, 1)) for _ in range(n)]
            if len(set(column)) == 2 and column not in columns and [-x for x in column] not in columns:
                columns.append(column)
    return np.array(columns, np.int8).reshape(-1, n).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bins x bits: log-odds of a bin
    scale: np.ndarray  # bits: the mean size of a margin
    trust: np.ndarray  # bits

    def predict(self, raw: bytes | None) -> tuple[str, float, bool, str | None]:
        """Language, score in [0, 1], whether it is ambiguous, and the runner-up."""
        if raw is None or not self.languages or not has_letter(raw):
            return "und", 0.0, False, None
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False, None
        bins, margin = ngrams(raw), np.zeros(self.code.shape[1])
        for at in range(0, len(bins), 1 << 16):
            margin += self.weights[bins[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        margin = margin / max(1, len(bins)) / self.scale
        loss = np.log1p(np.exp(-SHARPNESS * self.code * margin)) @ self.trust
        fit = np.exp(loss.min() - loss)
        share = fit / fit.sum()
        order = np.argsort(-share, kind="stable")
        lead = float(share[order[0]] - share[order[1]])
        return self.languages[order[0]], float(share[order[0]]), lead < MIN_LEAD, self.languages[order[1]]


def build_model(counts: dict[str, np.ndarray]) -> Model:
    """From n-gram counts by language. A bit's classifier weighs bins by the log-odds of its two sides' mean distributions."""
    languages = sorted(counts)
    n = len(languages)
    if n < 2:
        return Model(languages, np.zeros((n, 0), np.int8), np.zeros((BINS, 0), np.float32), np.zeros(0), np.zeros(0))
    p = np.stack([(counts[x] + 0.01) / (counts[x] + 0.01).sum() for x in languages])
    code = codewords(n)
    weights = np.stack([np.log(p[c == 1].mean(0)) - np.log(p[c == -1].mean(0)) for c in code.T], 1)
    expected = p @ weights  # languages x bits
    scale = np.maximum(np.abs(expected).mean(0), 1e-9)
    trust = np.clip((code * expected / scale).min(0), 0.0, 1.0)
    trust = trust / trust.sum() if trust.sum() > 0 else np.full(len(trust), 1 / len(trust))
    return Model(languages, code.astype(np.float64), weights.astype(np.float32), scale, trust * len(trust))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most ``max_labelled`` rows that have text, language and id and are not held out.

    The ids chosen are at most 8 bytes * ``max_labelled``, hence the broadcast. Texts stay on the executors: what
    comes to the driver is a table of languages x bins.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    some = rows.join(F.broadcast(ids), "doc_id").select("lang", F.col("text").cast("binary").alias("raw"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0), batch.column(1)):
                held.setdefault(lang.as_py(), np.zeros(BINS, np.int64))
                held[lang.as_py()] += np.bincount(ngrams(raw.as_py()), minlength=BINS)
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bin", "n"])

    counts: dict[str, np.ndarray] = {}
    for r in some.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r.lang, np.zeros(BINS))[r.bin] = r.n
    return build_model(counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``ambiguous``, ``second`` for every row, from the whole text alone.

    A text that is null or without any letter is ``und`` with score 0, as is every text if the model has no language.
    Languages that fit equally well are told in alphabetical order; very long texts are read whole, in parts. A null id counts as not held out; repeated rows come back as they are; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """

    def make() -> Callable[[bytes | None], tuple]:
        return model.predict

    types = [pa.string(), pa.float64(), pa.bool_(), pa.string()]
    out = map_texts(docs, id_col, text_col, make, "lang_pred string, score double, ambiguous boolean, second string", types)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous", "second")
