"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with one shingle set form a class; a class is one node. Banded MinHash
signatures put nodes into buckets. Candidates are compared batch by batch of
their signatures, and a pair is pruned once the posterior probability that it
reaches the threshold falls below the chosen miss probability; survivors are
confirmed on their full shingle sets.

No bucket is expanded into its pairs. Star rounds compare every node of a bucket
with one pseudo-random centre and confirm each node's best pair, which joins
large groups of copies quickly; each round takes a share of the buckets, which
bounds the pairs of a node. What is left are buckets with several
components: there the nodes outside the bucket's main component meet all others
of another component in blocks of bounded size, so no link between components is
lost. Links inside a component change nothing and are not looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import clean_text, hash_cache, stage, window_hashes, word_hashes
from gridseries.llm.components import connected_components

#: Words of a shingle; link at 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 5, 75
#: 32 bands of 4 hashes miss a pair of similarity 0.75 with probability 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature values compared before each pruning decision.
BATCH = 16
#: Posterior probability of a link below which a pair is pruned.
MISS = 1e-5
#: Star rounds; each gives every node one centre to be compared with.
STAR_ROUNDS = 3
#: Nodes of one side of a block.
BLOCK = 256
#: Shingles that meet all hash functions at a time.
STRIPE = 2048

FEATURES = "doc_id bigint, key binary, n_shingles bigint, sig binary, bands array<bigint>, band_bytes binary"
_DRAW = np.random.Generator(np.random.PCG64(20_240_501))
FACTORS = _DRAW.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_FACTORS = _DRAW.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, cache, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct word runs of ``width``; a shorter text is one run, a text without words none."""
    hashes = word_hashes(text.lower().split(), cache)  # bytes: A-Z and ASCII white space only
    return np.unique(window_hashes(hashes, max(1, min(width, len(hashes)))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits of multiply-shift hashes) of a set that isn't empty."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), STRIPE):
        np.minimum(low, (FACTORS[:, None] * shingles[None, at : at + STRIPE]).min(axis=1), out=low)
    return low >> np.uint64(32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    mixed = (sig.reshape(BANDS, ROWS) + np.uint64(1)) * BAND_FACTORS
    mixed = np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(31)), axis=1) + np.arange(BANDS, dtype=np.uint64)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = hash_cache()
    for batch in batches:
        keys, sizes, sigs, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            shingles = shingle_set(text, cache)
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            sizes.append(len(shingles))
            if len(shingles):
                sig = signature(shingles)
                sigs.append(sig.astype(np.uint16).tobytes())
                bands.append(band_keys(sig))
            else:
                sigs.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array([None if b is None else b.tobytes() for b in bands], pa.binary())],
            names=["doc_id", "key", "n_shingles", "sig", "bands", "band_bytes"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = hash_cache()
    for batch in batches:
        sets = [shingle_set(t, cache) for t in batch.column(0).to_pylist()]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "shingles"])


def least_hits(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each batch end: the fewest equal values of so many at which P(similarity >= threshold) is still ``miss``.

    The posterior under a uniform prior is a Beta distribution, integrated on a grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    logs, rest = np.log(grid), np.log1p(-grid)
    out = []
    for seen in range(BATCH, HASHES + 1, BATCH):
        for hits in range(seen + 1):
            logp = hits * logs + (seen - hits) * rest
            p = np.exp(logp - logp.max())
            if p[grid >= percent / 100].sum() >= miss * p.sum():
                break
        out.append(hits)
    return out


def surviving_hits(left: np.ndarray, right: np.ndarray, limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signature rows: indices of those that no batch prunes, and their equal values."""
    alive, hits = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, limit in enumerate(limits):
        part = slice(k * BATCH, (k + 1) * BATCH)
        hits = hits + (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = hits >= limit
        alive, hits = alive[keep], hits[keep]
    return alive, hits


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _bayes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limits = least_hits()
    for batch in batches:
        alive, _ = surviving_hits(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), limits)
        take = pa.array(alive)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])


BLOCK_KEY = ["bucket", "kind", "i", "j"]
MEMBERS = "bucket bigint, kind int, i bigint, j bigint, side int, node bigint, n bigint, comp bigint, sig binary, bands binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks from rows sorted by BLOCK_KEY; a block that goes on in the next batch waits for it."""
    open_: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if open_ is None else pa.concat_tables([open_, table])
        begins = _begins(table)
        if len(begins) > 1:
            yield table.slice(0, begins[-1]).combine_chunks()
        open_ = table.slice(begins[-1]) if len(begins) else None
    if open_ is not None and len(open_):
        yield open_.combine_chunks()


def _begins(table: pa.Table) -> np.ndarray:
    """First row of every block."""
    keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in BLOCK_KEY]) if len(table) else np.empty((4, 0), np.int64)
    return np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if keys.shape[1] else np.empty(0, np.int64)


def _open_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block: index pairs of rows in different components that no signature batch prunes.

    Side 0 meets side 1; without a side 0, side 1 meets itself. A pair that shares
    several bands is taken in the block of the first one only.
    """
    limits = least_hits()
    bucket, side, size, comp = (table.column(c).to_numpy() for c in ("bucket", "side", "n", "comp"))
    sigs = _matrix(table.column("sig"))
    bands = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
    begins = _begins(table)
    for begin, end in zip(begins, [*begins[1:], len(table)], strict=True):
        rows = np.arange(begin, end)
        lone = side[rows] == 1
        across = bool((~lone).any())
        found_a, found_b = [], []
        for i in rows[~lone] if across else rows:
            with_ = rows[lone] if across else rows[rows > i]
            fits = (comp[with_] != comp[i]) & (100 * np.minimum(size[with_], size[i]) >= PERCENT * np.maximum(size[with_], size[i]))
            with_ = with_[fits]
            if len(with_):
                first = (bands[with_] == bands[i]).argmax(axis=1)
                with_ = with_[bands[i][first] == bucket[i]]
            if len(with_):
                alive, _ = surviving_hits(np.broadcast_to(sigs[i], (len(with_), HASHES)), sigs[with_], limits)
                found_a.append(np.full(len(alive), i))
                found_b.append(with_[alive])
        yield (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _members_in_question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of blocks that take part in a pair in question."""
    for table in _blocks(batches):
        wanted = np.zeros(len(table), bool)
        for a, b in _open_pairs(table):
            wanted[a] = wanted[b] = True
        yield from table.filter(pa.array(wanted)).to_batches()


def _links_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links (a, b) of blocks whose members carry their sets: at most one less than a block's components.

    Pairs in question are compared one after another; those that earlier links
    of the block or its components connect already are skipped.
    """
    for table in _blocks(batches):
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        lists = table.column("shingles").combine_chunks()
        values, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        links = []
        for pairs_a, pairs_b in _open_pairs(table):
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := root.get(c, c)) != c:  # noqa: B023
                    root[c] = root.get(up, up)  # noqa: B023
                    c = up
                return c

            for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
                ca, cb = find(int(comp[a])), find(int(comp[b]))
                if ca == cb:
                    continue
                sa, sb = values[ends[a] : ends[a + 1]], values[ends[b] : ends[b + 1]]
                shared = len(np.intersect1d(sa, sb, assume_unique=True))
                if 100 * shared >= PERCENT * (len(sa) + len(sb) - shared):
                    root[max(ca, cb)] = min(ca, cb)
                    links.append((int(node[a]), int(node[b])))
        columns = zip(*links, strict=True) if links else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


class _Links:
    """Exact confirmation of candidate pairs of nodes."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs, nodes

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node, shingles of the nodes of a table; their texts are read again."""
        wanted = stage(self.nodes.select("node", "key", "owner").join(wanted, "node"), "near-wanted")
        texts = self.docs.select(F.col("doc_id").cast("bigint").alias("id"), clean_text().cast("binary").alias("text"))
        owners = wanted.select("owner").distinct()
        texts = texts.join(owners, F.col("id").eqNullSafe(F.col("owner")), "left_semi").select("text")
        sets = texts.mapInArrow(_sets, "key binary, shingles array<bigint>").join(wanted.select("key", "node"), "key")
        return stage(sets.select("node", "shingles").dropDuplicates(["node"]), "near-sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of a staged table that are links on their full sets; sets travel once per pair."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * shared >= PERCENT * (F.size("sa") + F.size("sb") - shared)).select("a", "b")

    def confirm_blocks(self, members: DataFrame) -> DataFrame:
        """The links (a, b) found in blocks of a staged table of MEMBERS; sets travel once per member of a block."""
        sets = self.sets(members.select("node").distinct())
        return _by_block(members.join(sets, "node").select(*members.columns, "shingles")).mapInArrow(_links_of_blocks, "a bigint, b bigint").distinct()


def _by_block(members: DataFrame) -> DataFrame:
    """Blocks whole in a partition and in order, so that they stream through a task one by one."""
    return members.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "side", "node")


def _star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): every node of active buckets with one of their centres of this turn, in another component.

    A bucket's centre is its node of smallest hash. Of its buckets' centres a node
    takes the one of smallest hash again, so the members of a group mostly meet at
    one centre and there is one pair for each node.
    """
    order = F.xxhash64("node", F.lit(turn))
    centres = rows.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), F.col("node"), F.col("comp"), F.col("n"))).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    centres = centres.where("lo < hi").select("bucket", "c.*").toDF("bucket", "o", "centre", "centre_comp", "centre_n")
    met = rows.join(centres, "bucket").where("comp <> centre_comp")
    fits = 100 * F.least("n", "centre_n") >= PERCENT * F.greatest("n", "centre_n")
    return met.where(fits).groupBy(F.col("node").alias("a")).agg(F.min(F.struct("o", "centre")).alias("c")).select("a", F.col("c.centre").alias("b"))


def _block_members(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """MEMBERS of blocks: of every bucket with several components, the nodes that a pair in question holds.

    The largest component of a bucket is set against the others, these against
    each other, in blocks of BLOCK by BLOCK nodes.
    """
    comps = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
    shape = comps.groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("k")).where("k > 1")
    shape = shape.select(
        "bucket", F.col("top.comp").alias("main"), F.col("k"),
        F.ceil(F.col("top.m") / BLOCK).alias("main_parts"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).alias("rest_parts"),
    )
    placed = rows.join(shape, "bucket").withColumn("side", (F.col("comp") != F.col("main")).cast("int"))
    parts = F.when(F.col("side") == 0, F.col("main_parts")).otherwise(F.col("rest_parts"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), parts))
    upto = lambda name: F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1)
    block = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"))
    here = F.col("part")
    as_main = F.transform(upto("rest_parts"), lambda j: block(0, here, j))
    as_rest = F.transform(upto("main_parts"), lambda i: block(0, i, here))
    among = F.when(F.col("k") > 2, F.transform(upto("rest_parts"), lambda j: block(1, F.least(here, j), F.greatest(here, j)))).otherwise(F.array().cast("array<struct<kind:int,i:bigint,j:bigint>>"))
    blocks = F.when(F.col("side") == 0, as_main).otherwise(F.concat(as_rest, among))
    dealt = placed.join(sigs, "node").select("bucket", F.explode(blocks).alias("block"), "side", "node", "n", "comp", "sig", "bands")
    return _by_block(dealt.select("bucket", "block.*", "side", "node", "n", "comp", "sig", "bands")).mapInArrow(_members_in_question, MEMBERS)


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, comp) after the components that ``links`` join are one."""
    a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    edges = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("src"), F.coalesce("cb", "b").alias("dst"))
    joined = connected_components(edges.where("src <> dst").distinct())  # comp, root
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    known = ends.join(labels, "node", "full").select("node", F.coalesce("comp", "node").alias("comp"))
    moved = known.join(joined.toDF("comp", "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    return stage(moved, "near-labels")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Needs doc_id and text; other columns are ignored. A null or wordless text
    has no shingles and is linked with nothing; one of one to four words is one
    shingle. Rows repeated with their id share a class. A null doc_id never
    names a component that has other ids; in a component of nulls component_id
    is null and all rows are kept. Rows that share an id but not their text are
    compared by their own texts each. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_text().cast("binary").alias("text"))
    features = stage(texts.mapInArrow(_features, FEATURES), "near-features")
    filled = features.where("n_shingles > 0")
    owner = F.min("doc_id")
    # Rows of one key have one set, hence one signature; the maximum only picks it.
    nodes = filled.groupBy("key").agg(owner.alias("owner"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("band_bytes").alias("band_bytes"))
    # A node bears the smallest id of its set; ids that several sets share leave them the hash of the set.
    shared_ids = nodes.groupBy("owner").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select(F.col("owner").alias("_shared"))
    nodes = nodes.join(shared_ids, F.col("owner") == F.col("_shared"), "left")
    nodes = stage(nodes.withColumn("node", F.when(F.col("owner").isNull() | F.col("_shared").isNotNull(), F.xxhash64("key")).otherwise(F.col("owner"))).drop("_shared"), "near-nodes")
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    crowded = spread.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    shared = stage(spread.join(crowded, "bucket"), "near-shared")
    sigs = nodes.select("node", "sig")
    signed_bands = nodes.select("node", "sig", F.col("band_bytes").alias("bands"))
    links = _Links(docs, nodes)
    labels = docs.sparkSession.createDataFrame([], "node bigint, comp bigint")
    for turn in range(STAR_ROUNDS):
        rows = shared.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        pairs = _star_pairs(stage(rows, "near-rows"), turn)
        signed = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
        close = signed.mapInArrow(_bayes, "a bigint, b bigint")
        confirmed = stage(links.confirm(stage(close.select("a", "b"), "near-best")), "near-links")
        labels = _relabel(labels, confirmed)
    rows = stage(shared.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-rows")
    rest = stage(links.confirm_blocks(stage(_block_members(rows, signed_bands), "near-rest")), "near-links")
    labels = _relabel(labels, rest)
    return _report(features, nodes, labels)


def _report(features: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    named = nodes.select("key", "node", "owner").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("owner").alias("component_id"))
    classes = stage(named.join(smallest, "comp").select("key", "component_id"), "near-classes")
    rows = features.select("doc_id", "n_shingles", "key").join(classes, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns.

    As ``near_groups``; rows that share the id that stays all stay if any does.
    """
    kept = near_groups(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")), "left_semi")
