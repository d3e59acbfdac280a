"""Line deduplication with log templates.

A line goes down a tree of fixed depth: its number of tokens, then its leading
tokens, where a token with a digit is a variable field. A line of fewer than four
tokens, or without a word beside its digits, keeps its exact tokens. In a leaf of several
lines the other fields are generalised too: a token stays constant at its place
if enough documents have it there, else the place is a variable. Lines whose
constants, variables and leaf agree share a template. A template that recurs in
two documents or more is dropped everywhere but in the document of smallest id.

A leaf is never gathered: fields are counted as (leaf, place, token) rows of its
distinct lines, and lines look their decision up in joins that adaptive execution
splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import clean_text, stage

#: Leading tokens that name a leaf; documents that make a template recur; documents that make a token constant.
DEPTH, LEAST_DOCS, LEAST_SUPPORT = 3, 2, 3
#: Tokens of a line whose variables are masked; of one that may have several variables outside its leading tokens; constants it needs then, in percent.
LEAST_TOKENS, LEAST_OPEN, LEAST_CONSTANT = 4, 8, 60
#: Lines of at most so many tokens say little, and more documents must hold them.
SHORT, SHORT_DOCS = 2, 9
VARIABLE = "<*>"
DIGIT = re.compile(rb"\d")
#: A token that tells a masked line from others: no digit, but a letter, ASCII or not.
NAMING = re.compile(rb"[^\d]*[A-Za-z\x80-\xff][^\d]*")

LINES = "doc_id bigint, text_key bigint, line_no int, leaf bigint, line_key bigint, line string"


def masked_tokens(line: bytes) -> list[bytes]:
    """Tokens between ASCII white space; those with a digit are variable fields, unless the line is short or no word would be left."""
    tokens = line.split()
    if len(tokens) < LEAST_TOKENS or not any(map(NAMING.fullmatch, tokens)):
        return tokens
    return [VARIABLE.encode() if DIGIT.search(t) else t for t in tokens]


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, number, leaf, key, out = [], [], [], [], []
        keys = []
        for at, text in enumerate(batch.column(1).to_pylist()):
            keys.append(_hash(text))
            for k, line in enumerate(text.split(b"\n")):
                tokens = masked_tokens(line)
                if tokens:
                    masked = b" ".join(tokens)
                    row.append(at)
                    number.append(k)
                    key.append(_hash(masked))
                    # A short line is a leaf of its own, named by its key.
                    leaf.append(key[-1] if len(tokens) <= SHORT else _hash(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH])))
                    out.append(masked)
        signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), signed(keys).take(take), pa.array(number, pa.int32()), signed(leaf), signed(key), pa.array(out, pa.binary()).cast(pa.string())],
            names=[c.split()[0] for c in LINES.split(", ")],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_text().cast("binary").alias("text"))


def _templates(lines: DataFrame, by_doc: DataFrame) -> DataFrame:
    """line_key, template: of lines in leaves that hold several distinct lines and enough documents."""
    distinct = stage(by_doc.groupBy("leaf", "line_key").agg(F.count(F.lit(1)).alias("docs")), "line-distinct")
    several = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("docs")).where((F.col("n") > 1) & (F.col("docs") >= LEAST_SUPPORT))
    open_lines = lines.select("leaf", "line_key", "line").join(several.select("leaf").hint("merge"), "leaf", "left_semi").dropDuplicates(["line_key"])
    open_lines = stage(open_lines.join(distinct.select("line_key", "docs"), "line_key"), "line-open")
    fields = open_lines.select("leaf", "line_key", "docs", F.posexplode(F.split("line", " ")).alias("at", "token"))
    frequent = fields.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support")).where(F.col("support") >= LEAST_SUPPORT).select("leaf", "at", "token", F.lit(True).alias("constant"))
    told = fields.join(frequent, ["leaf", "at", "token"], "left")
    fixed = F.col("constant").isNotNull() & (F.col("token") != VARIABLE)
    # A line has as many rows as tokens; they meet again under its key.
    shape = told.groupBy("line_key", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("at", F.when(fixed | (F.col("at") < DEPTH), F.col("token")).otherwise(VARIABLE).alias("token")))).alias("fields"),
        F.sum(fixed.cast("int")).alias("constants"), F.count(F.lit(1)).alias("tokens"), F.sum((~fixed).cast("int")).alias("variables"),
        F.sum((fixed & (F.col("at") >= DEPTH)).cast("int")).alias("constants_after"),
    )
    # Few tokens leave room for one variable, beside a constant that the leaf doesn't name already.
    roomy = (F.col("tokens") >= LEAST_OPEN) | ((F.col("variables") == 1) & (F.col("constants_after") > 0))
    general = roomy & (100 * F.col("constants") >= LEAST_CONSTANT * F.col("tokens")) & (F.col("variables") > 0)
    return shape.where(general).select("line_key", F.xxhash64("leaf", F.concat_ws(" ", F.col("fields.token"))).alias("template"))


def recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text_key, line_no, template: the lines to drop."""
    lines = stage(_keyed(docs).mapInArrow(_lines, LINES), "lines")
    by_doc = stage(lines.groupBy("leaf", "line_key", "doc_id").agg(F.count(F.lit(1)).alias("n")), "line-docs")
    templates = stage(_templates(lines, by_doc), "line-templates")
    short = F.col("leaf") == F.col("line_key")
    named = by_doc.select("line_key", "doc_id", short.alias("short")).join(templates.hint("merge"), "line_key", "left").withColumn("template", F.coalesce("template", "line_key"))
    by_template = named.groupBy("template", "doc_id").agg(F.max("short").alias("short")).groupBy("template")
    spread = by_template.agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_id"), F.max("short").alias("short"))
    enough = F.col("docs") >= F.when(F.col("short"), max(least_docs, SHORT_DOCS)).otherwise(least_docs)
    recurring = stage(spread.where(enough), "line-recurring")
    of_line = by_doc.select("line_key").distinct().join(templates, "line_key", "left").withColumn("template", F.coalesce("template", "line_key"))
    decisions = stage(of_line.join(recurring, "template").select("line_key", "template", "first_id"), "line-decisions")
    hit = lines.select("doc_id", "text_key", "line_no", "line_key").join(decisions.hint("merge"), "line_key")
    return hit.where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text_key", "line_no", "template")


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        keys = pa.array(np.array([_hash(t) for t in texts], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array([t.count(b"\n") + 1 for t in texts], pa.int32())], names=["doc_id", "text_key", "n_lines"])


def line_report(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped_lines (line numbers from 0): one row per row of ``docs``.

    Needs doc_id and text; other columns are ignored. Lines end at line feeds; a
    null or empty text is one empty line. Blank lines stay; lines of at most
    ``SHORT`` tokens go from ``SHORT_DOCS`` documents on. Rows repeated with id and text share the decision; rows of one
    id count as one document; null is an id of its own and never the smallest.
    An empty table gives an empty result.
    """
    dropped = recurring_lines(docs, least_docs).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("dropped_lines"))
    dropped = dropped.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "dropped_lines")
    rows = _keyed(docs).mapInArrow(_line_counts, "doc_id bigint, text_key bigint, n_lines int")
    found = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    lines = F.coalesce("dropped_lines", F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", F.size(lines).alias("n_dropped"), lines.alias("dropped_lines"))


def drop_recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` without the recurring lines; a text of which nothing stays is empty. Columns and rows stay."""
    @F.arrow_udf("bigint")
    def text_key(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([_hash(t) for t in texts.to_pylist()], np.uint64).view(np.int64))

    dropped = recurring_lines(docs, least_docs).groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("_lines"))
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_lines")
    keyed = docs.withColumn("_text_key", text_key(clean_text().cast("binary")))
    found = keyed.join(dropped, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains("_lines", k))
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return found.withColumn("text", text).select(*docs.columns)
