"""Exact and near dedup, mixing and line templates against plain Python."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridseries.llm import exact_dedup, line_dedup, mixing, near_dedup
from gridseries.llm.common import read
from gridseries.llm.components import connected_components
from gridseries.llm.queries import ORACLES, QUERIES
from gridseries.session import scratch_folder
from tests.llm.helpers import EDGE_ROWS, brute_components, edge_docs, rows, shingles, table, words
from tools.check import TABLES, norm

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_exact_groups_edges(spark):
    got = rows(exact_dedup.exact_groups(edge_docs(spark)))
    assert len(got) == len(EDGE_ROWS)
    by_id = {g["doc_id"]: g for g in got}
    assert [by_id[k]["keep_id"] for k in (1, 2)] == [2, 2] and by_id[1]["group_size"] == 3
    # null and empty are one text, and the null id loses
    assert by_id[3]["keep_id"] == by_id[4]["keep_id"] == 4 and by_id[4]["group_size"] == 3
    assert by_id[6]["text_sha256"] == hashlib.sha256(EDGE_ROWS[8][1].encode().lower()).hexdigest()
    assert exact_dedup.exact_groups(edge_docs(spark, [])).count() == 0


def test_drop_exact_copies_keeps_columns(spark):
    docs = edge_docs(spark)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 4, None, 5, 6, 7, 8])
    assert exact_dedup.drop_exact_copies(edge_docs(spark, [])).count() == 0


def test_digest_index_over_loads(spark):
    path = scratch_folder(spark, "index_test")
    index = exact_dedup.DigestIndex.open(spark, path, path.rsplit("/", 1)[-1].replace("-", "_"), 4)
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id bigint, text string")
    later = spark.createDataFrame([(9, "a"), (10, "c"), (11, "C")], "doc_id bigint, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(first, index).collect()} == {(1, 2), (2, 2), (3, 3)}
    for _ in range(2):  # again: nothing changes
        assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(later, index).collect()} == {(9, 2), (10, 11), (11, 11)}
    assert spark.table(index.table).count() == 3
    reopened = exact_dedup.DigestIndex.open(spark, path, index.table + "_again", 4)
    assert spark.table(reopened.table).count() == 3


def test_mixing_edges_and_bounds(spark):
    got = rows(mixing.mix(edge_docs(spark)))
    assert len(got) == len(EDGE_ROWS)
    assert Counter((g["doc_id"], g["size"]) for g in got) == Counter((r[0], len(words(r[1]))) for r in EDGE_ROWS)
    by_source = {}
    for g in got:
        assert 0 <= g["taken"] <= 2 * g["size"]
        by_source.setdefault(g["source"], [g["target"], 0])[1] += g["taken"]
    assert all(taken == int(target) for target, taken in by_source.values())
    total = sum(g["size"] for g in got)
    assert abs(sum(t for t, _ in by_source.values()) - 1.5 * total) < 1e-6
    assert mixing.mix(edge_docs(spark, [])).count() == 0
    assert mixing.mix(edge_docs(spark, [(1, None, None, "a", 0)])).first().taken == 0


def test_targets_share_excess(spark):
    sizes = spark.createDataFrame([(1, "a", "sa", 10), (2, "b", "sb", 100), (3, "c", "sc", 1000), (4, None, "n", 40)], "doc_id bigint, source string, skey string, size bigint")
    got = {r.skey: r.target for r in mixing.source_targets(sizes).collect()}
    left, caps, weights, want = 1725.0, {"sa": 20, "sb": 200, "sc": 2000, "n": 80}, {"sa": 5, "sb": 2, "sc": 1, "n": 5}, {}
    while True:
        open_ = [k for k in caps if k not in want]
        level = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if level * weights[k] > caps[k]]
        if not over:
            want |= {k: level * weights[k] for k in open_}
            break
        for k in over:
            want[k] = float(caps[k])
            left -= caps[k]
    assert got == pytest.approx(want)


def test_schedule_interleaves_sources(spark):
    sizes = mixing.sizes_of(read(spark, SF_DIR, "documents"))
    plan = mixing.source_plan(mixing.source_targets(sizes))
    quota = {r.skey: r.quota for r in plan.collect()}
    slots = sorted((r.slot, r.skey, r["rank"]) for r in mixing.slot_schedule(plan).collect())
    assert Counter(k for _, k, _ in slots) == Counter(quota)
    for key in quota:
        assert [r for _, k, r in slots if k == key] == list(range(quota[key]))
    half = Counter(k for _, k, _ in slots[: len(slots) // 2])
    assert all(abs(half[k] - q / 2) < 12 + 0.02 * q for k, q in quota.items())


def test_mixed_documents(spark):
    docs = edge_docs(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert all(n <= 4 for n in Counter(r.doc_id for r in mixed.collect()).values())  # a repeated row is two documents


def test_near_groups_edges(spark):
    got = rows(near_dedup.near_groups(edge_docs(spark)))
    assert len(got) == len(EDGE_ROWS)
    by_id = {g["doc_id"]: g for g in got}
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"] and by_id[1]["kept"]
    assert by_id[3]["n_shingles"] == by_id[4]["n_shingles"] == by_id[5]["n_shingles"] == 0
    assert by_id[3]["kept"] and by_id[4]["kept"] and by_id[8]["n_shingles"] == 1
    assert by_id[7]["n_shingles"] == len(shingles(EDGE_ROWS[9][1]))
    assert near_dedup.near_groups(edge_docs(spark, [])).count() == 0
    kept = near_dedup.drop_near_copies(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns and 2 not in {r.doc_id for r in kept.collect()}


def noisy_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh") * 3
        out.append(" ".join(w))
    return out


def test_near_groups_brute_force(spark, monkeypatch):
    """A large group of copies, borderline pairs and a shared passage; small blocks force the block step."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = noisy_copies(rng, text(80), 80, 9)
    passage = text(40)
    texts += [f"{text(15)} {passage} {text(15)}" for _ in range(40)]
    for _ in range(25):
        texts += noisy_copies(rng, text(60), 3, 4)
    docs = list(enumerate(texts))
    got = {r.doc_id: r for r in near_dedup.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    want = brute_components(docs)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t)) for i, t in docs)


@pytest.mark.parametrize("n", [500, 1500])
def test_noisy_copies_brute_force(spark, n):
    """Copies of one text, most pairs of which are near the threshold but no links: nothing is lost, and links are few."""
    rng = random.Random(n)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    docs = list(enumerate(noisy_copies(rng, base, n, 16)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute_components(docs)


def test_blocks_are_whole_over_batches():
    import pyarrow as pa

    rng = random.Random(2)
    rows_ = sorted((rng.randrange(4), 0, rng.randrange(2), 0, rng.randrange(99)) for _ in range(200))
    table_ = pa.table({k: [r[c] for r in rows_] for c, k in enumerate([*near_dedup.BLOCK_KEY, "node"])})
    for size in (1, 3, 50, 500):
        tables = list(near_dedup._blocks(table_.to_batches(max_chunksize=size)))
        assert pa.concat_tables(tables).equals(table_)
        firsts = [tuple(t.column(c)[0].as_py() for c in near_dedup.BLOCK_KEY) for t in tables]
        assert firsts == sorted(set(firsts))


def test_ids_repeated_with_other_texts(spark):
    rng = random.Random(9)
    one, two = (" ".join(f"{c}{rng.randrange(300)}" for _ in range(60)) for c in "xy")
    docs = [(5, one), (5, two), (7, noisy_copies(rng, one, 1, 1)[0]), (9, noisy_copies(rng, two, 1, 1)[0]), (11, "something else entirely, linked with nothing here")]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11)}


def test_bayes_limits_keep_links():
    limits = near_dedup.least_hits()
    rng = np.random.default_rng(3)
    close = rng.random((20_000, near_dedup.HASHES)) < 0.75
    left = np.ones_like(close, np.uint16)
    alive, _ = near_dedup.surviving_hits(left, close.astype(np.uint16), limits)
    assert len(alive) >= 20_000 * (1 - 2e-3)
    far = rng.random((20_000, near_dedup.HASHES)) < 0.4
    assert len(near_dedup.surviving_hits(left, far.astype(np.uint16), limits)[0]) < 20


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (205, 200), (200, 203)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200, 203: 200, 205: 200}


def test_line_templates(spark):
    docs = [(k, f"{' '.join(hashlib.md5(bytes([k, j])).hexdigest() for j in range(12))}\nCopyright by {1990 + k} the very {'north south east west up down left right'.split()[k]} company all rights are reserved now\nshort line") for k in range(8)]
    docs.append((8, "nothing of the kind is in this text at all"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
    assert {k: list(r.dropped_lines) for k, r in got.items()} == {0: [], **{k: [1] for k in range(1, 8)}, 8: []}
    cleaned = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(df).collect()}
    assert cleaned[0] == docs[0][1] and "Copyright" not in cleaned[5] and cleaned[5].endswith("short line")


def test_line_of_two_documents(spark):
    """A passage of 60 words that one pair of documents shares goes from the second, whether or not its leaf has templates."""
    passage = " ".join(hashlib.md5(bytes([j])).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(60))
    docs = [(k, f"the lines of document {'abcdefg'[k]} begin here\n{passage}" if k in (2, 5) else f"only {'abcdefg'[k]} is in this") for k in range(7)]
    got = {r.doc_id: list(r.dropped_lines) for r in line_dedup.line_report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[2] == [] and 1 in got[5]


def test_short_and_variable_lines(spark):
    """Short lines by exact keys, log lines by their words, lines of numbers apart; one open place in a line of six tokens."""
    names = "ann bob cem dan eve fay gus hal ida jon".split()
    docs = [(k, "\n".join([
        "Read more", "All rights reserved." if k < 3 else f"x{k}", f"Page {k}",
        f"Views: {k}20 Likes: {k}3 Shares: {k}", f"2024-01-0{k} 10:0{k}:11 user {k} logged in",
        f"{k} {k}1 {k}2 {k}3", f"welcome to our shop {n} today", "" if k else "only",
    ])) for k, n in enumerate(names)]
    got = {r.doc_id: list(r.dropped_lines) for r in line_dedup.line_report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {k: [] if k == 0 else [0, 1, 3, 4, 6] if k < 3 else [0, 3, 4, 6] for k in range(10)}
    few = spark.createDataFrame(docs[:8], "doc_id bigint, text string")
    assert all(0 not in r.dropped_lines for r in line_dedup.line_report(few).collect())


def test_line_report_edges(spark):
    got = rows(line_dedup.line_report(edge_docs(spark)))
    assert len(got) == len(EDGE_ROWS)
    assert all(g["n_dropped"] == len(g["dropped_lines"]) for g in got)
    assert {g["doc_id"]: g["n_lines"] for g in got}[5] == 2
    assert line_dedup.line_report(edge_docs(spark, [])).count() == 0
    cleaned = line_dedup.drop_recurring_lines(edge_docs(spark))
    assert cleaned.columns == edge_docs(spark).columns and cleaned.count() == len(EDGE_ROWS)


def test_line_report_exact_lines(spark):
    """Lines without variables, by counting."""
    docs = table(f"{SF_DIR}/documents.parquet", ["doc_id", "text"])
    holders = {}
    for d in docs:
        for line in (d["text"] or "").encode().split(b"\n"):
            if len(line.split()) >= line_dedup.LEAST_TOKENS:
                holders.setdefault(b" ".join(line_dedup.masked_tokens(line)), set()).add(d["doc_id"])
    got = {r.doc_id: set(r.dropped_lines) for r in line_dedup.line_report(read(spark, SF_DIR, "documents")).collect()}
    for d in docs:
        for k, line in enumerate((d["text"] or "").encode().split(b"\n")):
            own = holders.get(b" ".join(line_dedup.masked_tokens(line)), ())
            if len(own) >= line_dedup.LEAST_DOCS and d["doc_id"] != min(own):
                assert k in got[d["doc_id"]]


