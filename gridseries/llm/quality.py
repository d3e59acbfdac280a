"""Quality rules: text statistics and learned decision lists.

Sequential covering grows conjunctions of thresholds for the bad class on part of
a bounded sample of labelled rows and prunes them on the rest. The rules become
one ordered Spark conditional expression, which judges all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import clean_text, hash_cache, smallest_hashes, stage, window_hashes, word_hashes

#: Base rules: fewest words, window of repeated words, largest share of them in percent.
LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
#: Labelled rows from which the rules are learned, those of smallest hash of the id.
TRAIN_ROWS = 20_000
#: Share of the sample that grows rules; conditions of a rule; rules of a list; thresholds tried of a statistic.
GROW_SHARE, MOST_CONDITIONS, MOST_RULES, THRESHOLDS = 2 / 3, 4, 12, 64
#: A rule must be right on so much of the pruning rows that it covers, and cover so many.
LEAST_PRECISION, LEAST_COVER = 0.8, 5

#: Kinds of bytes of a text in UTF-8: white space, bytes that continue a character, symbols, capitals, digits, ends of sentences.
SPACE, CONTINUED, SYMBOL, UPPER, NUMBER, END = range(1, 7)
KINDS = np.zeros(256, np.uint8)
KINDS[0x80:0xC0] = CONTINUED
for _kind, _chars in ((SPACE, b" \t\n\r\x0b\x0c"), (SYMBOL, b"#*$%&|<>"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (NUMBER, b"0123456789"), (END, b".!?")):
    KINDS[list(_chars)] = _kind
STATS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_ends bigint, n_upper bigint, n_digits bigint, n_distinct bigint"


def repeated_words(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words in runs of ``width`` words that occur twice or more in the text."""
    windows = window_hashes(hashes, width)
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(windows, again))
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = hash_cache()
    for batch in batches:
        rows = []
        for raw in batch.column(1).to_pylist():
            words = raw.split()  # at ASCII white space only
            codes = np.frombuffer(raw, np.uint8)
            kinds = np.bincount(KINDS[codes], minlength=7)
            spaces = np.append(KINDS[codes[1:]] == SPACE, True) if len(codes) else np.empty(0, bool)
            rows.append((
                len(words), len(codes) - kinds[SPACE] - kinds[CONTINUED], kinds[SYMBOL], repeated_lines(raw), repeated_words(word_hashes(words, cache)),
                ((KINDS[codes] == END) & spaces).sum(), kinds[UPPER], kinds[NUMBER], len(set(words)),
            ))
        columns = zip(*rows, strict=True) if rows else [[]] * 9
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[c.split()[0] for c in STATS.split(", ")])


def text_stats(docs: DataFrame) -> DataFrame:
    """Statistics of every whole text; a null text has none of anything."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_text().cast("binary").alias("text")).mapInArrow(_stats, STATS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """The statistics that rules may test: counts, and shares of the words or characters."""
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"), "n_dup_lines": F.col("n_dup_lines").cast("double"),
        "mean_word": per_word("word_chars"), "symbols": per_word("n_symbols"), "repeats": per_word("n_repeat_words"), "ends": per_word("n_ends"),
        "upper": F.col("n_upper") / F.greatest("word_chars", F.lit(1)), "digits": F.col("n_digits") / F.greatest("word_chars", F.lit(1)), "distinct": per_word("n_distinct"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.limit if self.above else values <= self.limit

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.name] > self.limit if self.above else of[self.name] <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.name])
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of the highest information gain until no good row is covered or none gains."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            held = values[inside]
            for limit in np.unique(np.quantile(held, np.linspace(0, 1, THRESHOLDS), method="lower")):
                for above in (True, False):
                    c = Condition(name, above, float(limit))
                    hit = inside & c.holds(values)
                    p1, n1 = (bad & hit).sum(), (~bad & hit).sum()
                    if p1:
                        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = c, g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x[best.name])
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Cut final conditions as long as (p - n) / (p + n) on the pruning rows doesn't fall."""
    def worth(r: Rule) -> float:
        hit = _covered(r, x, len(bad))
        return (2 * (bad & hit).sum() - hit.sum()) / max(1, hit.sum())

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for the bad class; what no rule covers is good."""
    grows = np.arange(len(bad)) % 3 < 3 * GROW_SHARE - 0.5
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES and (bad & left & grows).any():
        grow, check = left & grows, left & ~grows
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule:
            break
        held = {k: v[check] for k, v in x.items()}
        rule = _prune(rule, held, bad[check])
        hit = _covered(rule, held, int(check.sum()))
        if hit.sum() < LEAST_COVER or (bad[check] & hit).sum() < LEAST_PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~_covered(rule, x, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for what no rule calls bad: CASE WHEN rule 1 THEN false WHEN rule 2 ... ELSE true."""
    of, out = features(), None
    for rule in rules:
        test = rule[0].column(of)
        for c in rule[1:]:
            test &= c.column(of)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_rules(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from the ``rows`` labelled rows of smallest id hash that pass the base rules. Labels: doc_id, quality (1 good, 0 bad)."""
    marked = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.where(~base_failed()).join(marked, "doc_id")
    names = features()
    known = known.select("doc_id", "quality", *(c.alias(k) for k, c in names.items()))
    sample = smallest_hashes(known, rows, ["doc_id"]).collect()
    if not sample:
        return []
    return learn({k: np.array([r[k] for r in sample], float) for k in names}, np.array([r["quality"] == 0 for r in sample]))


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: one row per row of ``docs``.

    Needs doc_id and text of ``docs``, doc_id and quality of ``labels``; other
    columns are ignored. A null text has no words and fails the base rules. Null
    ids or labels teach nothing; a document labelled both ways counts as bad.
    Without labels the base rules alone decide. Rows repeated with their id are
    judged each; an empty table gives an empty result.
    """
    stats = stage(text_stats(docs), "quality-stats")
    failed = stats.withColumn("base_failed", base_failed())
    kept = failed.withColumn("kept", ~F.col("base_failed") & verdict(learn_rules(stats, labels)))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
