"""Language identification: known words first, then ever shorter character n-grams.

The model is bounded whatever the corpus holds: a word is known to a language if
it makes up at least 1 / WORD_SHARE of the language's words, which at most
WORD_SHARE words can; likewise for the n-grams of each length. Counts come from
all training rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.llm.common import clean_text, stage

WORD_SHARE, GRAM_SHARE = 100_000, 20_000
LONGEST_GRAM = 4
#: Languages that are learned, those with most words first; the model's size is this times the known words.
MOST_LANGUAGES = 256
UNKNOWN = "und"
#: Distinct words that a counting task holds before it passes them on, and words whose scores are kept.
HELD, CACHED = 300_000, 300_000
LETTERS = re.compile(r"[^\W\d_]+")
VERDICT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, words in held.items() for word, n in words.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, held.values())) > HELD:
            yield out()
            held = {}
    yield out()


def gram_counts(words: list[str], counts: np.ndarray, size: int) -> dict[str, int]:
    """Counts of the n-grams of padded words, each word ``counts`` times."""
    text = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32)
    letters, codes = np.unique(text, return_inverse=True)
    if len(letters) > 2**16:  # beyond the places of a key: count halves, a single word letter by letter
        halves = (slice(0, len(words) // 2), slice(len(words) // 2, None))
        if len(words) > 1:
            return dict(sum((Counter(gram_counts(words[h], counts[h], size)) for h in halves), Counter()))
        padded = f" {words[0]} "
        return {g: n * int(counts[0]) for g, n in Counter(padded[k : k + size] for k in range(len(padded) - size + 1)).items()}
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends, weights = np.repeat(np.cumsum(lengths), lengths), np.repeat(counts, lengths)
    at = np.flatnonzero(np.arange(len(text)) + size <= ends)
    keys = np.zeros(len(at), np.uint64)
    for k in range(size):
        keys = keys << np.uint64(16) | codes[at + k].astype(np.uint64)
    distinct, inverse = np.unique(keys, return_inverse=True)
    totals = np.bincount(inverse, weights[at]).astype(np.int64)
    chars = [chr(c) for c in letters]
    return {"".join(chars[int(key) >> 16 * k & 0xFFFF] for k in range(size - 1, -1, -1)): int(n) for key, n in zip(distinct, totals, strict=True)}


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, words, counts = batch.column("lang").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_numpy()
        rows = []
        for lang in set(langs):
            own = [k for k, x in enumerate(langs) if x == lang]
            for size in range(1, LONGEST_GRAM + 1):
                rows += [(lang, size, gram, n) for gram, n in gram_counts([words[k] for k in own], counts[own], size).items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "size", "gram", "n"])


@dataclass
class LanguageModel:
    """Log frequencies: languages in order, their vectors by word and by n-gram."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]


class Scorer:
    """Verdicts over texts; a word's scores are computed once while they stay in the table.

    A known word scores its log frequency by language. An unknown one scores, at
    each of its positions, that of the longest known n-gram; as overlapping
    n-grams share their letters, each counts by 1 / n.
    """

    def __init__(self, model: LanguageModel):
        self.model, self.rows = model, {}
        width = max(1, len(model.languages))
        self.table = np.zeros((CACHED, width))
        self.gram_rows = {gram: k for k, gram in enumerate(model.grams, 1)}
        self.gram_table = np.vstack([np.zeros((1, width)), *(v[None] / len(gram) for gram, v in model.grams.items())])

    def parts(self, word: str) -> list[int]:
        """Rows of the longest known n-gram at each position of the padded word; row 0, of zeros, where none is known."""
        padded, known, out = f" {word} ", self.gram_rows, [0]
        for at in range(len(padded)):
            for end in range(min(at + LONGEST_GRAM, len(padded)), at, -1):
                if (row := known.get(padded[at:end])) is not None:
                    out.append(row)
                    break
        return out

    def learn(self, words: list[str]) -> None:
        first = len(self.rows)
        unknown, parts = [], []
        for row, word in enumerate(words, first):
            self.rows[word] = row
            if (known := self.model.words.get(word)) is not None:
                self.table[row] = known
            else:
                unknown.append(row)
                parts.append(self.parts(word))
        if unknown:
            starts = np.cumsum([0, *map(len, parts[:-1])])
            self.table[unknown] = np.add.reduceat(self.gram_table[[r for p in parts for r in p]], starts)

    def verdict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        for begin in range(0, len(words), CACHED):
            part = words[begin : begin + CACHED]
            new = sorted({w for w in part if w not in self.rows})
            if len(self.rows) + len(new) > CACHED:
                self.rows, new = {}, sorted(set(part))
            self.learn(new)
            total += self.table[np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))].sum(axis=0)
        odds = np.exp(total - total.max())
        top = int(odds.argmax())
        return self.model.languages[top], float(odds[top] / odds.sum())


def _vectors(rows, key: str, totals: dict[str, int], languages: list[str]) -> dict[str, np.ndarray]:
    """Smoothed log frequencies, half a count for what a language lacks."""
    at = {lang: k for k, lang in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r[key], np.full(len(languages), 0.5))[at[r["lang"]]] += r["n"]
    sizes = np.array([math.log(totals[lang] + 1.0) for lang in languages])
    return {k: np.log(v) - sizes for k, v in counts.items()}


def train(labelled: DataFrame) -> LanguageModel:
    """Model from rows (lang, text) with a lang that isn't null. Only the bounded model reaches the driver."""
    counted = labelled.select(F.col("lang").cast("string").alias("lang"), clean_text().alias("text")).mapInArrow(_count_words, "lang string, word string, n bigint")
    words = stage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(totals)
    of_lang = F.create_map(*(F.lit(x) for lang in languages for x in (lang, totals[lang]))) if languages else None

    def frequent(rows: DataFrame, share: int, total: Column) -> list:
        return rows.where(F.col("n") * share >= total).collect()  # at most ``share`` a language

    if not languages:
        return LanguageModel([], {}, {})
    words = words.where(F.col("lang").isin(languages))
    known = frequent(words, WORD_SHARE, of_lang[F.col("lang")])
    spread = words.mapInArrow(_count_grams, "lang string, size int, gram string, n bigint")
    by_gram = stage(spread.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    # A language's n-grams of one length: all positions of its padded words, counted over all of them.
    gram_totals = {(r["lang"], r["size"]): r["n"] for r in by_gram.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    at = F.create_map(*(F.lit(x) for (lang, size), n in gram_totals.items() for x in (f"{lang}\x00{size}", n)))
    often = frequent(by_gram, GRAM_SHARE, at[F.concat("lang", F.lit("\x00"), F.col("size").cast("string"))])
    vectors: dict[str, np.ndarray] = {}
    for size in range(1, LONGEST_GRAM + 1):
        vectors |= _vectors([r for r in often if r["size"] == size], "gram", {lang: gram_totals.get((lang, size), 0) for lang in languages}, languages)
    return LanguageModel(languages, _vectors(known, "word", totals, languages), vectors)


def predictor(docs: DataFrame, model: LanguageModel) -> Column:
    """Column struct(lang_pred, score) of the text; the bounded model is sent to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.grams))

    @F.arrow_udf(VERDICT)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(LanguageModel(*shared.value))
        for batch in texts:
            verdicts = [scorer.verdict(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([v[0] for v in verdicts], pa.string()), pa.array([v[1] for v in verdicts], pa.float64())], names=["lang_pred", "score"])

    return predict(clean_text())


def held_out() -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``.

    Needs doc_id, text and lang; other columns are ignored. Learns from rows that
    aren't held out and have a lang. A text that is null or has no letter is
    ``und`` with score 0, as is every text where nothing was learned; equal scores
    go to the first language by name. Rows repeated with their id are judged each;
    an empty table gives an empty result.
    """
    model = train(docs.where(~held_out() & F.col("lang").isNotNull()))
    judged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), predictor(docs, model).alias("v"))
    return judged.select("doc_id", "held_out", "v.lang_pred", "v.score")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns.

    Dropped are texts without a letter, null ones among them; any other text has
    a most likely language, however short it is. Where no row that isn't held out
    has a language, nothing is learned and nothing dropped but these texts. Rows
    repeated are judged each; an empty table gives an empty result.
    """
    model = train(docs.where(~held_out() & F.col("lang").isNotNull()))
    if not model.languages:
        return docs.where(clean_text().rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.grams))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(LanguageModel(*shared.value))
        for batch in batches:
            verdicts = [t is not None and scorer.verdict(str(t))[0] != UNKNOWN for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    # The rows themselves pass through the task batch by batch, so none wait beside it for their verdict.
    return docs.mapInArrow(known, docs.schema)
