"""Packing tokenised documents into sequences by bin completion on the length histogram.

Pieces of one length are interchangeable, so the packing problem is the histogram
of lengths: at most ``capacity`` rows whatever the corpus holds. The driver
solves it by branch and bound and gets a list of patterns (lengths and copies in
a sequence, number of such sequences). Pieces are ranked within their length in
bounded windows and look up their place by rank.
"""

from __future__ import annotations

import logging
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm.common import clean_text, stage

CAPACITY, END_ID = 4096, 1
#: Rows that one ranking window should hold, and the least number of windows of a length.
RANK_ROWS, RANK_PARTS = 200_000, 64
#: Search limits: fillings looked at for one largest piece, branches tried at one, and steps in all. They bound the
#: search for fewer sequences, not what is packed.
FILLINGS, BRANCHES, STEPS = 400, 3, 60_000

#: Texts whose new words are tokenised together; words and parts whose ids are kept.
TEXTS, CACHED = 256, 1_000_000
#: ASCII marks that may end a word; letters of ASCII and Latin-1 in UTF-8.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

LOG = logging.getLogger(__name__)

Pattern = tuple[tuple[tuple[int, int], ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: the incumbent of the search."""
    room: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in range(length, capacity):
            while left and room[free]:
                items, bins = room[free].pop()
                copies = free // length
                used = min(bins, left // copies)
                if used < bins:
                    room[free].append((items, bins - used - (left % copies > 0 and used == left // copies)))
                    if not room[free][-1][1]:
                        room[free].pop()
                    if rest := left - used * copies:
                        room[free - rest * length].append(((*items, (length, rest)), 1))
                        left -= rest
                if used:
                    room[free - copies * length].append(((*items, (length, copies)), used))
                    left -= used * copies
            if not left:
                break
        copies = capacity // length
        if left >= copies:
            room[capacity - copies * length].append((((length, copies),), left // copies))
        if left % copies:
            room[capacity - left % copies * length].append((((length, left % copies),), 1))
    return [p for group in room for p in group]


def fillings(lengths: list[int], counts: dict[int, int], room: int, waste_limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, pieces) of the undominated fillings of ``room`` found within the limits, least waste first.

    Larger pieces are tried first and only maximal fillings are kept. Of two
    fillings with equal waste the one of fewer, larger pieces dominates, as its
    pieces are the harder ones to place later.
    """
    found: dict[int, tuple[int, ...]] = {}
    looked = 0
    at_most = np.searchsorted(np.array(lengths), room, side="right") - 1
    stack: list[tuple[int, int, tuple[int, ...]]] = [(int(at_most), room, ())]
    while stack and looked < FILLINGS and 0 not in found:
        at, free, taken = stack.pop()
        while at >= 0 and (lengths[at] > free or counts[lengths[at]] <= taken.count(lengths[at])):
            at -= 1
        if at < 0:
            looked += 1
            if free <= waste_limit and (free not in found or len(taken) < len(found[free])):
                found[free] = taken
            continue
        stack.append((at - 1, free, taken))
        stack.append((at, free - lengths[at], (*taken, lengths[at])))
    return sorted(found.items())


def complete_bins(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fewest patterns' sequences found for the histogram ``counts`` (length: pieces).

    Depth-first bin completion: the largest piece left opens a sequence, each of
    its best fillings is a branch, and the pattern is used as often as the pieces
    allow. A branch is pruned when the waste so far rules out fewer sequences
    than the incumbent, and the search ends at the bound total / capacity.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    total = sum(k * v for k, v in counts.items())
    bound = max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    steps = 0

    def branches(left: dict[int, int], spare: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        """The next patterns (items, waste), best last."""
        lengths = sorted(left)
        top = lengths[-1]
        left[top] -= 1
        options = fillings(lengths, left, capacity - top, spare)[:BRANCHES]
        left[top] += 1
        out = []
        for waste, taken in options:
            pieces = (top, *taken)
            out.append((tuple((k, pieces.count(k)) for k in dict.fromkeys(pieces)), waste))
        return out[::-1]

    path: list[tuple[tuple[tuple[int, int], ...], int, int]] = []  # items, sequences, waste of each
    spent, used = 0, 0
    left = dict(counts)
    open_: list[list] = []
    while fewest > bound and steps < STEPS:
        if not left:
            if used < fewest:
                fewest, best = used, [(items, n) for items, n, _ in path]
            options = []
        else:
            options = branches(left, (fewest - 1) * capacity - total - spent)
        open_.append(options)
        while open_ and not open_[-1]:
            open_.pop()
            if path:
                items, n, waste = path.pop()
                spent, used = spent - n * waste, used - n
                for k, c in items:
                    left[k] = left.get(k, 0) + c * n
        if not open_:
            break
        steps += 1
        items, waste = open_[-1].pop()
        n = min(left[k] // c for k, c in items)
        if waste:  # the last sequence's empty end isn't waste that the bound forbids, so stay within what is left of it
            spare = (fewest - 1) * capacity - total - spent
            n = max(1, min(n, spare // waste))
        for k, c in items:
            left[k] -= c * n
            if not left[k]:
                del left[k]
        path.append((items, n, waste))
        spent, used = spent + n * waste, used + n
    if fewest > bound:
        LOG.warning("packing search ended %s: %d sequences, bound %d", f"by its limit of {STEPS} steps" if steps >= STEPS else "with no branch left", fewest, bound)
    return best


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence, copies and offset of each run of places, by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    first = 0
    for items, bins in patterns:
        offset = 0
        for length, copies in items:
            out.setdefault(length, []).append((given.get(length, 0), first, copies, offset))
            given[length] = given.get(length, 0) + copies * bins
            offset += length * copies
        first += bins
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def token_bytes(tokenizer_file: str):
    """Generator function from texts to their ids as little-endian 32-bit bytes.

    The tokenizer drops white space before it splits, so a text's ids are those of
    its words one after the other. It also splits letters from marks and ignores
    case, so a word of letters and final marks is made of two parts. Words and
    parts are tokenised once while they stay in the cache.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers

    tokenizer = Tokenizer.from_file(tokenizer_file)
    # Letters and marks in lower case are normal already, so their tokenizer can do without the normaliser.
    bare = Tokenizer.from_file(tokenizer_file)
    bare.normalizer = normalizers.Sequence([])
    probe = " ".join(bytes(range(33, 127)).decode()) + " " + " ".join(map(chr, range(0xC0, 0x100)))
    if bare.encode(probe.lower(), add_special_tokens=False).ids != tokenizer.encode(probe, add_special_tokens=False).ids:
        bare = tokenizer
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    cache: dict[bytes, bytes] = {b"": b""}

    def ids(text: str, by: Tokenizer) -> np.ndarray:
        # without the offsets that encode() works out
        return np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(words: set[bytes]) -> None:
        """Ids of words that the cache lacks; the words are in lower case as far as ASCII goes."""
        plain, marked, other = [], [], []
        for word in words:
            stem = word.rstrip(MARKS)
            if stem.isalpha() or LETTERS.fullmatch(stem):
                if len(stem) == len(word):
                    plain.append(word)
                else:
                    marked.append((word, stem, word[len(stem) :]))
            else:
                other.append(word)
        ends_of_words = {p for _, stem, mark in marked for p in (stem, mark)}
        ends_of_words.difference_update(plain)
        parts = plain + [p for p in ends_of_words if p not in cache]
        code = ids(b" ".join(parts).decode().lower(), bare)  # each part is one word to the tokenizer, and a word's last token says so
        cuts = 4 * (np.flatnonzero(ends[code]) + 1)
        if len(cuts) != len(parts):
            raise ValueError("the tokenizer does not mark the ends of words")
        data, stops = code.tobytes(), cuts.tolist()
        cache.update(zip(parts, map(data.__getitem__, map(slice, [0, *stops], stops)), strict=False))
        cache.update([(w, cache[a] + cache[b]) for w, a, b in marked])
        cache.update([(w, ids(w.decode(), tokenizer).tobytes()) for w in other])

    def encode(texts: list[bytes]) -> Iterator[bytes]:
        for at in range(0, len(texts), TEXTS):
            split = [t.lower().split() for t in texts[at : at + TEXTS]]
            words = set().union(*split)
            new = words - cache.keys()
            if len(cache) + 2 * len(new) > CACHED:
                cache.clear()
                cache[b""] = b""
                new = words
            learn(new)
            for row in split:
                yield b"".join(map(cache.__getitem__, row))

    return encode


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as ids, those over ``capacity`` cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_bytes(tokenizer_file)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, length, crc = [], [], [], []
            for at, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += end
                for k, begin in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[begin : begin + 4 * capacity]
                    row.append(at)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            pieces = pa.array(piece, pa.int32())
            starts = pa.array(np.array(piece, np.int64) * capacity)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pieces, starts, pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_text().cast("binary").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of ``docs``.

    Needs doc_id and text; other columns are ignored. A null or empty text is the
    end id alone. Rows repeated with their id are packed each. An empty table
    gives an empty result. Sequences are gapless from offset 0.
    """
    pieces = stage(token_pieces(docs, tokenizer_file, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    table = places(complete_bins(counts, capacity))
    parts = max(RANK_PARTS, -(-sum(counts.values()) // RANK_ROWS))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("local", local).join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first_rank, first, copies, start = table[int(length)]
                run = np.searchsorted(first_rank, ranks[rows], side="right") - 1
                k = ranks[rows] - first_rank[run]
                sequence[rows] = first[run] + k // copies[run]
                offset[rows] = start[run] + k % copies[run] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")
