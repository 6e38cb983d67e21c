"""Quality rules: a decision list over text statistics, learned by sequential covering and run as Spark conditionals.

Statistics are array functions of one row, without any shuffle. Rules are conjunctions of thresholds, grown on two
thirds of a bounded sample of labelled rows and pruned on the rest; the result is one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from terrane.functions.columns import SPACES, let, words

#: Labelled rows that a list is learned from at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: What conditions may test; per word, so that a threshold means the same for any length.
FEATURES = ("symbols_per_word", "chars_per_word", "repeat_share", "dup_lines_per_word")


def repeated_words(w: Column, window: int = 3) -> Column:
    """Words in ``window``-word windows that occur twice or more in the array ``w``, the first occurrence included.

    Windows are compared by a 64-bit hash. They are sorted with their positions only where a hash repeats at all; the
    union of equal-length intervals at sorted starts is the sum of each start's distance to the next, at most ``window``.
    """
    n = F.size(w) - (window - 1)
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        def starts(s: Column) -> Column:
            same = F.filter(
                s,
                lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(same, lambda e: e["i"]))

        spans = let(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), starts),
            lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
        )

    return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``.

    A null text counts as empty: all statistics are zero.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    out = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        *[docs[c].alias(c) for c in keep or []],
        counts.alias("__w"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return out.withColumns({"n_words": F.col("__w.n"), "n_repeat_words": F.col("__w.r")}).drop("__w")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    per = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    top = {"symbols_per_word": "n_symbols", "chars_per_word": "word_chars", "repeat_share": "n_repeat_words", "dup_lines_per_word": "n_dup_lines"}
    return {name: F.col(top[name]) / per for name in FEATURES}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def holds(self, x: dict[str, float]) -> bool:
        return x[self.feature] > self.at if self.above else x[self.feature] <= self.at

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.at if self.above else value <= self.at

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.at:.6g}"


Rule = tuple[Condition, ...]


def learn(rows: list[tuple[dict[str, float], bool]], min_precision: float = 0.9, min_cover: int = 5, max_rules: int = 20) -> list[Rule]:
    """Rules that recognise bad rows (True), in the order found.

    ``rows`` in a fixed order: every third prunes, the others grow. A rule grows by the condition of the largest FOIL
    gain until it covers no good row, then loses its last conditions as long as (bad - good) / (bad + good) on the
    pruning rows does not fall. It is kept if it covers ``min_cover`` bad rows and is right on ``min_precision`` of
    all rows that it covers; the first rule that is not ends the list. Of equal gains the first counts, by the order of ``FEATURES``, then
    from the smallest cut, below it before above. One class only, or no rows: no rules.
    """
    grow = [x for i, x in enumerate(rows) if i % 3 != 2]
    prune = [x for i, x in enumerate(rows) if i % 3 == 2]
    rules: list[Rule] = []
    while len(rules) < max_rules and any(bad for _, bad in grow):
        rule = _pruned(_grown(grow), prune)
        mine = [bad for x, bad in grow + prune if all(c.holds(x) for c in rule)]
        if not rule or sum(mine) < min_cover or sum(mine) < min_precision * len(mine):
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r[0]) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r[0]) for c in rule)]
    return rules


def _grown(rows: list[tuple[dict[str, float], bool]], longest: int = 4) -> Rule:
    rule: list[Condition] = []
    while rows and len(rule) < longest and not all(bad for _, bad in rows):
        p, n = sum(bad for _, bad in rows), sum(not bad for _, bad in rows)
        if not p:
            break
        was, best = math.log2(p / (p + n)), (1e-9, None)
        for name in FEATURES:
            ordered = sorted((x[name], bad) for x, bad in rows)
            bad_below = good_below = 0
            for k, (value, bad) in enumerate(ordered[:-1]):
                bad_below, good_below = bad_below + bad, good_below + (not bad)
                if ordered[k + 1][0] == value:
                    continue
                cut = (value + ordered[k + 1][0]) / 2
                for above, b, g in ((False, bad_below, good_below), (True, p - bad_below, n - good_below)):
                    if b:
                        gain = b * (math.log2(b / (b + g)) - was)
                        if gain > best[0]:
                            best = (gain, Condition(name, above, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r[0])]
    return tuple(rule)


def _pruned(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> Rule:
    def worth(conditions: Rule) -> float:
        covered = [bad for x, bad in rows if all(c.holds(x) for c in conditions)]
        return (2 * sum(covered) - len(covered)) / len(covered) if covered else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules learned from at most ``max_labelled`` labelled documents that pass the base rules.

    ``labels``: ``doc_id``, ``quality`` (0 is bad; null labels are left out). Rows are chosen and ordered by the hash of
    their id, so that reruns agree. The ids chosen are at most 8 bytes * ``max_labelled``, hence the broadcast; one
    row of four numbers for each of them comes to the driver.
    """
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    chosen = named.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    stats = statistics(texts.join(F.broadcast(chosen), "doc_id"), keep=["quality"])
    # The base rules come after the collect: as a filter they would be pushed below the join, to every document.
    stats = stats.select("doc_id", "quality", base_failed().alias("failed"), *[c.alias(k) for k, c in features().items()])
    rows = stats.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(max_labelled).collect()  # rows may repeat an id
    rows = [r for r in rows if not r.failed]
    ordered = sorted(rows, key=lambda r: (r.doc_id * 0x9E3779B97F4A7C15 % (1 << 61), *[r[k] for k in FEATURES]))
    return learn([({k: r[k] for k in FEATURES}, r.quality == 0) for r in ordered[:max_labelled]])


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: the number of the first rule that holds, null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        holds = rules[k - 1][0].column()
        for c in rules[k - 1][1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """:func:`statistics`, with ``base_failed``, ``rule`` (the first that holds, null if none) and ``kept``.

    Every row comes back once. Null, empty and blank texts fail the base rules; very long texts are read whole, within their row;
    of several rules that hold the first is told; a null id stays null; an empty table
    gives no rows; columns of ``docs`` that are not in ``keep`` are ignored, whatever their names.
    """
    stats = statistics(docs, id_col, text_col, keep)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
