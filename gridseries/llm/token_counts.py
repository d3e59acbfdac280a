"""Token counts by a deterministic transducer compiled from a BPE vocabulary.

The tokenizer merges neighbouring pieces by score. Two facts make it finite-state:
the pieces of a prefix before its last piece are the tokenisation of a shorter
prefix, and a sequence of pieces is the tokenisation exactly if every two
neighbours are. So what the next character does depends only on the longest
suffix that begins some piece, and on the last piece and count at each of its
positions. These are the states; they are compiled when first met and carry on
each transition the number of tokens that it adds, which may be negative where
pieces merge.

A position that no piece spans puts the automaton into its start state whatever
came before: a synchronising point. The state map of a chunk of text is therefore
its text before the first such point, the count between the first and the last,
and the text after the last. These maps compose associatively, so the chunks of a
long text are counted on any executors and combined as in a prefix scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import BoundedCache, clean_text

TOKEN_LIMIT = 4096
#: Texts over this length are dealt out in chunks of it, in characters.
CHUNK = 65_536
#: Compiled states kept at a time, and units whose count is kept.
STATES, UNITS = 200_000, 600_000
SPACE = "▁"  # how the vocabulary writes a space; in a text it counts as a space
#: A unit: a run of spaces and what follows it, or a line feed and what follows it.
UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
#: What follows a synchronising point: a line feed, or a space that no space precedes.
SYNC = re.compile(r"\n|(?<=[^ ]) ")

MAPS = "doc_id bigint, text_hash binary, chunk bigint, n_bytes bigint, synced boolean, head string, count bigint, tail string"
COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint"


class CountTransducer:
    """Transitions (state, character) -> (state, added tokens) of a BPE vocabulary with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i).replace(SPACE, " ")] = model.get_score(i)
        if any("\n" in p or " " in p.lstrip(" ") for p in self.score):
            raise ValueError("a piece spans a synchronising point")
        self.begins = {p[:k] for p in self.score for k in range(1, len(p))}
        self.longest = max(map(len, self.score))
        self.whole = BoundedCache(lambda piece: self.pieces(piece) == [piece])
        self.joined = BoundedCache(self._stay_apart, limit=2_000_000)
        self.reset()
        self.units = BoundedCache(self._walk, limit=UNITS)

    def reset(self) -> None:
        # a state: the suffix, and for each of its positions from its start to here (last piece, tokens so far less tokens here)
        self.number = {("", ((None, 0),)): 0}
        self.states = [("", ((None, 0),))]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def pieces(self, text: str) -> list[str]:
        """The tokenisation of a short text, by its definition."""
        parts = list(text)
        while True:
            top = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (top is None or s > top[0]):
                    top = (s, i)
            if top is None:
                return parts
            parts[top[1] : top[1] + 2] = [parts[top[1]] + parts[top[1] + 1]]

    def _stay_apart(self, pair: tuple[str, str]) -> bool:
        return self.pieces(pair[0] + pair[1]) == list(pair)

    def weight(self, piece: str) -> int:
        """Tokens of a piece; a character outside the vocabulary falls back to its bytes."""
        return 1 if piece in self.score else len(piece.encode())

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        suffix, ends = self.states[state]
        grown = suffix + char
        for at in range(len(grown)):
            piece, (before, count) = grown[at:], ends[at]
            known = piece in self.score or len(piece) == 1
            if known and (before is None or self.joined[(before, piece)]) and (len(piece) == 1 or self.whole[piece]):
                added = count + self.weight(piece)
                break
        keep = next((k for k in range(max(0, len(grown) - self.longest + 1), len(grown)) if grown[k:] in self.begins), len(grown))
        here = [*((p, c - added) for p, c in ends), (piece, 0)]
        new = (grown[keep:], tuple(here[keep:]))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        move = self.moves[state][char] = (self.number[new], added)
        return move

    def _walk(self, unit: str) -> int:
        if len(self.states) > STATES:
            self.reset()
        state, tokens = 0, 0
        for char in unit:
            move = self.moves[state].get(char) or self._compile(state, char)
            state = move[0]
            tokens += move[1]
        return tokens

    def count(self, text: str) -> int:
        """Tokens of a text that begins at a synchronising point, as the sum over its units."""
        return sum(map(self.units.__getitem__, UNIT.findall(text)))

    def chunk_map(self, text: str, first: bool) -> tuple[bool, str, int, str]:
        """(synced, head, count, tail). The first chunk of a text begins at a synchronising point, after a space of its own."""
        if first:
            text, begin = " " + text, 0
        else:
            found = SYNC.search(text)
            if found is None:
                return False, text, 0, ""
            begin = found.start()
        space = text.rfind(" ")
        while space > begin and text[space - 1] == " ":
            space -= 1
        end = max(text.rfind("\n"), space, begin)
        return True, text[:begin], self.count(text[begin:end]), text[end:]

    def compose(self, maps: list[tuple[bool, str, int, str]]) -> tuple[bool, str, int, str]:
        """The map of neighbouring chunks, combined in pairs level by level."""
        while len(maps) > 1:
            paired = [self._pair(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = paired + maps[len(paired) * 2 :]
        return maps[0]

    def _pair(self, a: tuple[bool, str, int, str], b: tuple[bool, str, int, str]) -> tuple[bool, str, int, str]:
        if not a[0]:
            # a sees no point of its own, but b's start may be one
            return (b[0], a[1] + b[1], b[2], b[3])
        if not b[0]:
            return (True, a[1], a[2], a[3] + b[1])
        return (True, a[1], a[2] + self.count(a[3] + b[1]) + b[2], b[3])

    def total(self, maps: list[tuple[bool, str, int, str]]) -> int:
        """Tokens of a whole text from the maps of its chunks, the first of which is synced."""
        _, _, count, tail = self.compose(maps)
        return count + self.count(tail)


def chunk_maps(chunks: DataFrame, model_file: str) -> DataFrame:
    """State maps of chunk rows (doc_id, text_hash, chunk, text)."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = CountTransducer(model_file)
        for batch in batches:
            numbers, texts = batch.column("chunk").to_pylist(), batch.column("text").to_pylist()
            made = [transducer.chunk_map(t.replace(SPACE, " "), k == 0) if t else (True, "", 0, "") for k, t in zip(numbers, texts, strict=True)]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            kinds = (pa.bool_(), pa.string(), pa.int64(), pa.string())
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "chunk")), sizes, *columns], names=[c.split()[0] for c in MAPS.split(", ")])

    return chunks.mapInArrow(maps, MAPS)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in enumerate(batch.column(1).to_pylist()):
            parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
            n = len(parts)
            hashed = pa.array([xxhash.xxh3_128_digest(text)] * n, pa.binary())
            ids = batch.column(0).take(pa.array([row] * n))
            yield pa.RecordBatch.from_arrays([ids, hashed, pa.array(range(n), pa.int64()), pa.array(parts)], names=["doc_id", "text_hash", "chunk", "text"])


def token_counts(docs: DataFrame, model_file: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``.

    Needs doc_id and text; other columns are ignored. A null or empty text has no
    tokens; rows repeated with their id are counted each; an empty table gives an
    empty result. Texts of any length are counted whole: those over ``CHUNK``
    characters are cut into chunk rows and dealt out before they are counted.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_text().alias("text"))
    short = texts.where(F.length("text") <= CHUNK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = CountTransducer(model_file)
        for batch in batches:
            whole = batch.column(1).to_pylist()
            tokens = [transducer.total([transducer.chunk_map(t.replace(SPACE, " "), True)]) if t else 0 for t in whole]
            sizes = pa.array([len(t.encode()) for t in whole], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = CountTransducer(model_file)
        for batch in batches:
            ids, sizes, tokens = [], [], []
            for row in batch.to_pylist():
                parts = {m["chunk"]: m for m in row["maps"]}  # rows repeated with their id repeat their chunks
                total = transducer.total([(m["synced"], m["head"], m["count"], m["tail"]) for _, m in sorted(parts.items())])
                for _ in range(len(row["maps"]) // len(parts)):
                    ids.append(row["doc_id"])
                    sizes.append(sum(m["n_bytes"] for m in parts.values()))
                    tokens.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    chunks = texts.where(F.length("text") > CHUNK).mapInArrow(_split, "doc_id bigint, text_hash binary, chunk bigint, text string")
    maps = chunk_maps(chunks.repartition("text_hash", "chunk"), model_file)
    grouped = maps.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("chunk", "n_bytes", "synced", "head", "count", "tail")).alias("maps"))
    counted = short.mapInArrow(count, COUNTS).unionByName(grouped.select("doc_id", "maps").mapInArrow(combine, COUNTS))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
