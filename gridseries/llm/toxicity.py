"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts: one on passages of
ordinary texts, one on the words that ordinary texts don't account for in toxic
ones. A window's gain is the number of bytes by which it compresses better with
the toxic dictionary than without it; both compressors share the ordinary one.
A text's largest gains are set against a threshold calibrated on labelled texts
that the dictionaries have not seen.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import BoundedCache, clean_text

#: Labelled rows and bytes of each label that the model is fitted on, smallest hashes first.
SAMPLE_ROWS, SAMPLE_BYTES = {0: 3000, 1: 1500}, 24_000_000
#: One sampled row in so many calibrates the threshold; the others train the dictionaries.
CALIBRATE = 3
#: Bytes of the two dictionaries, and of a passage of ordinary text that its dictionary is trained on.
TOXIC_BYTES, ORDINARY_BYTES, PASSAGE = 4096, 4096, 64
#: Substrings of MER bytes mark a word where they occur in so many different contexts of toxic
#: texts, and, as a share of the sampled texts, so many times as often as in ordinary ones.
MER, CONTEXTS, CONTRAST = 5, 6, 25.0
#: Words of a window, and the largest gains of a text that are looked at.
WINDOW, TOP = 1, 4
#: Every window begins with this, and both dictionaries end with it, so that short windows are compressed too; it
#: ends with TRAILER, since zstandard looks for no match in the last eight bytes.
CARRIER, TRAILER = b" ~\x01 beginning of a window \x02~", b"\x03\x04\x05\x06\x07\x0e\x0f\x10"
#: Windows whose gains a task keeps.
CACHED = 400_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    """Runs of ``width`` words between spaces; the last may be shorter."""
    if width == 1:
        return words
    return [b" ".join(words[k : k + width]) for k in range(0, len(words), width)]


def _mers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Substrings of MER bytes inside the words between spaces, as numbers, with the word and the place in it of each."""
    text = np.frombuffer(b"".join(b" %b " % w for w in words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    n = max(0, len(text) - MER + 1)
    codes, inside = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(MER):
        codes = codes << np.uint64(8) | text[k : k + n].astype(np.uint64)
        if 0 < k < MER - 1:
            inside &= text[k : k + n] != 32
    at = np.flatnonzero(inside)
    word = np.searchsorted(ends, at, side="right")
    return codes[at], word, at - np.concatenate([[0], ends])[word]


def telling_runs(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Parts of words that toxic texts hold and ordinary ones don't account for, once for each context, in a fixed order.

    A context is a pair of neighbouring words: copies of a text add nothing, near
    copies little.
    """
    contexts: dict[bytes, set[tuple[bytes, bytes]]] = defaultdict(set)
    for words in toxic:
        for before, word, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
            contexts[word].add((before, after))
    held = sorted(contexts)
    times = np.fromiter((len(contexts[w]) for w in held), np.int64, len(held))
    codes, word, place = _mers(held)
    found, index = np.unique(codes, return_inverse=True)
    counts = np.bincount(index, times[word], len(found))
    usual_codes, usual_counts = np.unique(_mers([w for words in ordinary for w in words])[0], return_counts=True)
    usual = np.zeros(len(found))
    if len(usual_codes):
        at = np.minimum(np.searchsorted(usual_codes, found), len(usual_codes) - 1)
        usual = np.where(usual_codes[at] == found, usual_counts[at], 0)
    scale = CONTRAST * max(1, len(toxic)) / max(1, len(ordinary))
    telling = (counts >= CONTEXTS) & (counts >= scale * usual)
    runs: Counter = Counter()
    begin = end = last = -1
    for k in np.flatnonzero(telling[index]):
        if word[k] != last or place[k] > end:
            if last >= 0:
                runs[(b" %b " % held[last])[begin:end]] += int(times[last])
            begin, last = place[k], word[k]
        end = place[k] + MER
    if last >= 0:
        runs[(b" %b " % held[last])[begin:end]] += int(times[last])
    samples = [run for run, n in sorted(runs.items()) if n >= CONTEXTS for _ in range(n)]
    random.Random(11).shuffle(samples)
    return samples


def passages(texts: list[list[bytes]]) -> list[bytes]:
    joined = b" ".join(word for words in texts for word in words)
    cut = [joined[k : k + PASSAGE] for k in range(0, len(joined), PASSAGE)]
    random.Random(11).shuffle(cut)
    return cut[:50_000]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a zstandard dictionary trained on ``samples``; all of them where they are too few to train on."""
    whole = b"".join(dict.fromkeys(samples))
    if len(whole) <= size:
        return whole
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return whole[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=15, hash_log=14, chain_log=15, search_log=6, target_length=64,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    trained = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=parameters)


@dataclass(frozen=True)
class ToxicityModel:
    """The two dictionaries and the calibration; a few kilobytes whatever the corpus holds."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    constant: float | None = None

    def gains(self) -> BoundedCache:
        """Bytes gained by the toxic dictionary, by window."""
        # The toxic dictionary is the nearer part, so that even short matches in it are cheap.
        plain, toxic = compressor(self.ordinary), compressor(self.ordinary + self.toxic)

        def gain(window: bytes) -> int:
            padded = b"%b %b %b" % (CARRIER, window, TRAILER)
            return len(plain.compress(padded)) - len(toxic.compress(padded))

        return BoundedCache(gain, CACHED)

    def score(self, features: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return _sigmoid(float(np.dot(self.weights[1:], features) + self.weights[0]))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def features(words: list[bytes], gains: BoundedCache) -> np.ndarray:
    """The TOP largest gains of the windows, in falling order, and the logarithm of the number of windows."""
    windows = windows_of(words)
    out = np.zeros(TOP + 1)
    if windows:
        values = np.fromiter(map(gains.__getitem__, windows), np.int64, len(windows))
        top = np.sort(values[values > 0])[::-1][:TOP]
        out[: len(top)] = top
        out[TOP] = math.log1p(len(windows))
    return out


def calibrate(x: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Logistic weights (intercept first), shifted so that 0.5 lies at the threshold of the best F1.

    Both labels weigh the same in the fit; a ridge keeps separable samples finite.
    """
    design = np.hstack([np.ones((len(x), 1)), x])
    share = toxic.mean()
    sample = np.where(toxic, 0.5 / share, 0.5 / (1 - share))
    ridge = np.diag([1e-6] + [0.1] * x.shape[1])
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (sample * (p - toxic)) + ridge @ w
        hessian = (design * (sample * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    logits = design @ w
    order = np.argsort(-logits, kind="stable")
    hits, taken = np.cumsum(toxic[order]), np.arange(1, len(order) + 1)
    f1 = 2 * hits / (taken + toxic.sum())
    ends = np.append(np.diff(logits[order]) != 0, True)  # a threshold doesn't part equal scores
    at = int(np.argmax(np.where(ends, f1, -1)))
    below = logits[order][at + 1] if at + 1 < len(order) else logits[order][at] - 2
    w[0] -= (logits[order][at] + below) / 2
    return tuple(float(v) for v in w)


    return dictionary(telling_runs(texts[1], texts[0]), TOXIC_BYTES, 16), dictionary(passages(texts[0]), ORDINARY_BYTES, PASSAGE)


def dictionaries(rows: list[tuple[int, list[bytes], bool]]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of rows (label, words, ...)."""
    texts = {label: [r[1] for r in rows if r[0] == label] for label in (0, 1)}
    return dictionary(telling_runs(texts[1], texts[0]), TOXIC_BYTES, 16), dictionary(passages(texts[0]), ORDINARY_BYTES, PASSAGE)


def fit(sample: list[tuple[int, str | None, bool]]) -> ToxicityModel:
    """Model from rows (label, text, calibrates).

    Without both labels nothing can be compared: every score is 1 if only toxic
    texts were given, else 0.
    """
    if {label for label, _, _ in sample} != {0, 1}:
        return ToxicityModel(b"", b"", (), 1.0 if any(label for label, _, _ in sample) else 0.0)
    rows = [(label, words_of(text), held) for label, text, held in sample]
    train, calibrating = ([r for r in rows if r[2] == held] for held in (False, True))
    if {r[0] for r in train} != {0, 1} or {r[0] for r in calibrating} != {0, 1}:
        train = calibrating = rows  # too few to hold some back
    toxic, ordinary = dictionaries(train)
    gains = ToxicityModel(toxic, ordinary, ()).gains()
    x = np.array([features(words, gains) for _, words, _ in calibrating])
    return ToxicityModel(toxic, ordinary, calibrate(x, np.array([label == 1 for label, _, _ in calibrating])))


def _crc():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def held_out():
    """crc32 of the id as text, modulo 5, is 0; a null id is an empty text."""
    return _crc() % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str | None, bool]]:
    """Bounded sample of labelled rows that aren't held out: (label, text, calibrates).

    Of each label the SAMPLE_ROWS ids of smallest hash, as many as fit into
    SAMPLE_BYTES of text; an id with both labels is toxic, of several texts of an
    id the one of smallest hash is taken.
    """
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    ids = ids.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.withColumn("hash", F.xxhash64(F.lit("toxicity"), "doc_id"))
    picked = [r for label, n in SAMPLE_ROWS.items() for r in ids.where(F.col("toxic") == label).orderBy("hash", "doc_id").limit(n).collect()]
    spark = docs.sparkSession
    if not picked:
        return []
    wanted = spark.createDataFrame([(r["doc_id"], r["toxic"], r["hash"]) for r in picked], "doc_id bigint, toxic int, hash bigint")
    text = clean_text()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).join(F.broadcast(wanted), "doc_id")  # at most 5,000 ids
    texts = texts.groupBy("toxic", "hash", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = texts.withColumn("before", F.sum(F.octet_length("text")).over(_sample_order())).where(F.col("before") <= SAMPLE_BYTES)
    rows = texts.orderBy("toxic", "hash", "doc_id").collect()
    return [(r["toxic"], r["text"], r["hash"] % CALIBRATE == 0) for r in rows]


def _sample_order():
    from pyspark.sql import Window

    return Window.partitionBy("toxic").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Needs doc_id and text in ``docs``, doc_id and toxic in ``labels``; other columns
    are ignored. Learns from a bounded sample of labelled rows that aren't held
    out (``labelled_sample``); labels other than 0 and 1, null labels and labels
    of null or unknown ids are ignored. Every word of every text is compressed.
    A null text counts as empty and gets the score of a text without gains.
    Without labels of both kinds all scores are 1 if only toxic ones are known,
    else 0. Rows repeated with their id are scored each; an empty table gives an
    empty result.
    """
    model = fit(labelled_sample(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = None if model.constant is not None else model.gains()
        for batch in batches:
            values = [model.score(features(words_of(t), gains) if gains is not None else np.zeros(0)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), clean_text().alias("text"))
    scored = rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
