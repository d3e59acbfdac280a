"""Structure repair of conversations by weighted CYK parsing.

Role initials of a repaired conversation read ``(s?(ua)+)?``. A place between two
messages is in one of four positions: at the start, after the system message,
after a user's, after an assistant's. The nonterminals of the repair grammar are
pairs of positions: [p, q] derives the edited messages that lead from p to q, with
the rules

    [p, q] -> [p, r] [r, q]                 binary, Chomsky normal form
    [p, q] -> a message kept or reroled, where its role leads from p to q
    [p, p] -> a message deleted
    [p, q] -> messages inserted from p to q  (the closure, of empty spans)

A cell of a span holds, for every nonterminal, the least (cost, audit). As a
nonterminal fixes the positions on both sides, every derivation of a span can be
cut at any message, so one cut of a span is enough and spans of 1, 2, 4, ...
messages are combined bottom-up. Equal costs compare their audits; of two audits
of a span with equal cost none begins with the other (it would hold more
insertions), so least cells make least concatenations.

Conversations are cut into chunks of messages and each chunk's cell is built in a
task; cells of neighbouring chunks are then combined level by level. Only the
digest of the repaired text, one SHA-256 over a conversation, reads its messages
in sequence, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.functions.ranks import row_numbers
from gridseries.llm.common import stage

START, SYSTEM, USER, ASSISTANT = range(4)
#: (position before, initial of a message, position after).
MOVES = [(START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (USER, "a", ASSISTANT), (ASSISTANT, "u", USER)]
#: Positions at which a conversation may end.
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Messages of a chunk, and chunks combined at a level.
CHUNK, FAN = 256, 64
#: Letters of the first fault of a message; blank and duplicate messages must be deleted.
FAULTS = {"blank": "b", "duplicate": "d", "truncated": "t"}
SOUND = "-"
LEGAL = {"su", "ua", "au"}

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cell: Cell, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def joined(left: Cell, right: Cell) -> Cell:
    """Cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (more, rest) in right.items():
            if r == r2:
                _least(out, (p, q), (cost + more, audit + rest))
    return out


def _closure() -> Cell:
    """Insertions alone, in any number: the cell of an empty span."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    step = {**cell, **{(p, q): (INSERT, "I") for p, initial, q in MOVES if initial in ROLES}}
    for _ in range(4):
        cell = joined(cell, step)
    return cell


CLOSURE = _closure()


@lru_cache(maxsize=None)
def message_cell(kind: str) -> Cell:
    """Cell of one message with insertions before it; ``kind`` is its initial and the letter of its fault."""
    initial, fault = kind
    own: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in "bd":
        extra = TRUNCATED if fault == "t" else 0
        for p, letter, q in MOVES:
            if letter == initial:
                _least(own, (p, q), (extra, "K"))
            if letter in ROLES:
                _least(own, (p, q), (REROLE + extra, "R"))
    return joined(CLOSURE, own)


@lru_cache(maxsize=50_000)
def _short_cell(kinds: str) -> Cell:
    if len(kinds) == 2:
        return message_cell(kinds)
    middle = len(kinds) // 4 * 2
    return joined(_short_cell(kinds[:middle]), _short_cell(kinds[middle:]))


def span_cell(kinds: str) -> Cell:
    """Cell of a span of messages, two letters each; spans of 1, 2, 4, ... messages are combined bottom-up."""
    if not kinds:
        return {(p, p): (0, "") for p in range(4)}
    width = 16
    cells = [_short_cell(kinds[k : k + width]) for k in range(0, len(kinds), width)]
    return combined(cells)


def combined(cells: list[Cell]) -> Cell:
    """Cell of neighbouring spans, by halves."""
    while len(cells) > 1:
        cells = [joined(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


def best_parse(cell: Cell) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation, insertions at its end included."""
    closed = joined(cell, CLOSURE)
    return min(closed[START, end] for end in ENDS if (START, end) in closed)


class Repair:
    """Applies an audit to the messages of a conversation, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.position = audit, 0, START

    def _insertions(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._moved("I", "", "")

    def _moved(self, edit: str, role: str, text: str) -> tuple[str, str]:
        letter, self.position = next((x, q) for p, x, q in MOVES if p == self.position and (x == role[:1] if edit == "K" else x in ROLES))
        return (role if edit == "K" else ROLES[letter]), text

    def message(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """Messages of the repaired conversation up to this one."""
        yield from self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._moved(edit, role, text)

    def rest(self) -> Iterator[tuple[str, str]]:
        """Messages inserted at the end."""
        yield from self._insertions()


def _letter(name: str) -> Column:
    return F.substring(F.col(name), 1, 1)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, copy: the rows after damage; null roles and texts are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("damage"),
    ).where("damage <> 0")
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role"))
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "damage")
    # The digest orders messages of equal turn and tells equal texts without carrying them.
    hurt = hurt.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    return hurt.withColumn("copy", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("damage")


ORDER = ["turn", "role", "digest", "copy"]


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, at (place in the conversation), initial, fault (null if none) of rows (conv_id, turn, role, text, digest, copy).

    Places are counted over range partitions, so a conversation of any size
    spreads over many tasks; texts don't travel. The first of equal messages is
    found by a minimum that combines before the shuffle.
    """
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    small = rows.select(
        "conv_id", *ORDER, _letter("role").alias("initial"), (F.length(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     "))) == 0).alias("blank"), (~last.isin(".", "!", "?")).alias("open"),
    )
    placed = stage(row_numbers(small, ["conv_id"], ORDER, "at", "n"), "messages")
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select(F.col("conv_id").alias("c"), F.col("at").alias("a"), F.lit(True).alias("first"))
    marked = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    return marked.select("conv_id", "at", "initial", fault.alias("fault"))


CELL_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("chunk", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), *((f, pa.int64()) for f in FAULTS),
    ("keys", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
])
CELLS = f"conv_id bigint, chunk bigint, first string, last string, illegal bigint, {', '.join(f'{f} bigint' for f in FAULTS)}, keys array<int>, costs array<bigint>, audits array<string>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _listed(cell: Cell) -> tuple[list[int], list[int], list[str]]:
    keys = sorted(cell)
    return [p * 4 + q for p, q in keys], [cell[k][0] for k in keys], [cell[k][1] for k in keys]


def _cell(keys: list[int], costs: list[int], audits: list[str]) -> Cell:
    return {divmod(k, 4): (cost, audit) for k, cost, audit in zip(keys, costs, audits, strict=True)}


def _chunk_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of chunks given as rows (conv_id, chunk, kinds of the messages in order)."""
    for batch in batches:
        rows = []
        for conv, chunk, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            initials, faults = kinds[::2], kinds[1::2]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            rows.append((conv, chunk, initials[0], initials[-1], illegal, *(faults.count(x) for x in FAULTS.values()), *_listed(span_cell(kinds))))
        yield _batch(rows, CELL_SCHEMA)


def _joined_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of runs of neighbouring spans, given as rows (conv_id, chunk, spans in order)."""
    for batch in batches:
        rows = []
        for conv, chunk, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            illegal = sum(s["illegal"] for s in spans) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(spans, spans[1:], strict=False))
            cell = combined([_cell(s["keys"], s["costs"], s["audits"]) for s in spans])
            rows.append((conv, chunk, spans[0]["first"], spans[-1]["last"], illegal, *(sum(s[f] for s in spans) for f in FAULTS), *_listed(cell)))
        yield _batch(rows, CELL_SCHEMA)


def _parses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([CELL_SCHEMA.field(n) for n in ("conv_id", "illegal", *FAULTS)] + [pa.field("cost", pa.int64()), pa.field("audit", pa.string())])
    for batch in batches:
        yield _batch([(*row[:-3], *best_parse(_cell(*row[-3:]))) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)], schema)


def parsed(messages: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """conv_id, illegal, blank, duplicate, truncated, cost, audit: one row per conversation of ``flagged`` rows.

    The messages of a chunk and the spans combined at a level are groups of
    bounded size; the driver gets one number a level.
    """
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("?")
    kind = F.concat(initial, F.coalesce(*(F.when(F.col("fault") == f, x) for f, x in FAULTS.items()), F.lit(SOUND)))
    in_order = F.array_sort(F.collect_list(F.struct("at", kind.alias("kind"))))
    chunks = messages.groupBy("conv_id", F.floor(F.col("at") / chunk).alias("chunk")).agg(F.array_join(in_order["kind"], "").alias("kinds"))
    cells = stage(chunks.mapInArrow(_chunk_cells, CELLS), "chunk-cells")
    names = [n for n in CELL_SCHEMA.names if n not in ("conv_id", "chunk")]
    while (cells.agg(F.max("chunk")).first()[0] or 0) > 0:
        level = cells.groupBy("conv_id", F.floor(F.col("chunk") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("chunk", *names))).alias("spans"))
        cells = stage(level.mapInArrow(_joined_cells, CELLS), "span-cells")
    whole = cells.select("conv_id", "illegal", *FAULTS, "keys", "costs", "audits")
    return stage(whole.mapInArrow(_parses, f"conv_id bigint, illegal bigint, {', '.join(f'{f} bigint' for f in FAULTS)}, cost bigint, audit string"), "parses")


def _streamed(rows: DataFrame, parses: DataFrame) -> DataFrame:
    """conv_id, message, role, text: a conversation's audit (as text, message false), then its messages in order."""
    heads = parses.select("conv_id", F.lit(False).alias("message"), *[F.lit(None).cast(t).alias(n) for n, t in zip(ORDER, ("bigint", "string", "binary", "int"), strict=True)], F.col("audit").alias("text"))
    both = heads.unionByName(rows.select("conv_id", F.lit(True).alias("message"), *ORDER, "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "message", *ORDER).select("conv_id", "message", "role", "text")


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bool, list[tuple[str, str]]]]]:
    """For each batch of streamed rows: (conv_id, whether a conversation begins, repaired messages) in order.

    Memory holds one audit and one batch, however long a conversation is.
    """
    repair, current = None, None
    for batch in batches:
        out = []
        for conv, message, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if message:
                out.append((conv, False, list(repair.message(role, text))))
                continue
            if repair is not None:
                out.append((current, False, list(repair.rest())))
            repair, current = Repair(text), conv
            out.append((conv, True, []))
        yield out
    if repair is not None:
        yield [(current, False, list(repair.rest()))]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    current = digest = None
    between = b""
    for steps in _repairs(batches):
        done = []
        for conv, begins, lines in steps:
            if begins:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest, between = conv, hashlib.sha256(), b""
            for role, text in lines:
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
        yield _batch(done, schema)
    if digest is not None:
        yield _batch([(current, digest.hexdigest())], schema)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    place = 0
    for steps in _repairs(batches):
        rows = []
        for conv, begins, lines in steps:
            place = 0 if begins else place
            for role, text in lines:
                rows.append((conv, place, role, text))
                place += 1
        yield _batch(rows, schema)


def with_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, copy: rows of a table (conv_id, turn, role, text) as the parser takes them; nulls of role and text are one space."""
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text")
    )
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("copy", F.lit(0))


def repaired_messages(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the messages of every conversation after its cheapest repair.

    As ``repair_report``, on the rows as they are. A conversation whose messages
    are all deleted has none.
    """
    rows = with_digest(conversations)
    return _streamed(rows, parsed(flagged(rows))).mapInArrow(_messages, "conv_id bigint, place bigint, role string, text string")


def repair_report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per row of ``ids`` (conv_id).

    ``rows`` are (conv_id, turn, role, text, digest, copy) of ``with_digest`` or
    ``damaged``. Messages of a conversation are taken by turn, nulls first; of
    equal turns by role, then by the digest of the text, so the order does not
    depend on the partitions. A null conv_id is a conversation of its own. A role
    whose first character isn't s, u or a, or that is empty, is never kept. An id
    without rows has zeros, an empty audit and the hash of the empty string; an
    empty table gives an empty result.
    """
    parses = parsed(flagged(rows))
    digests = _streamed(rows, parses).mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    out = ids
    for k, side in enumerate([gaps, parses, digests]):
        key = f"_c{k}"
        out = out.join(side.withColumnRenamed("conv_id", key), F.col("conv_id").eqNullSafe(F.col(key)), "left").drop(key)
    counts = ["gaps", *FAULTS, "illegal", "cost"]
    return out.select(
        "conv_id", *(F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair_report`` of the rows of ``conversations`` after ``damaged``, for every conv_id of the table.

    Needs conv_id, turn, role and text; other columns are ignored.
    """
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    return repair_report(damaged(conversations), ids)
