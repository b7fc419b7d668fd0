"""N-gram Jaccard join (6) with adaptive multi-match prefixes.

A document is the set of its word shingles. With the shingles of all
documents in one order, rare ones first, two sets that overlap in t shingles
share at least m of their first n - t + m. m is chosen for each document: a
longer prefix costs more list entries, but asks for m shared ones before a
pair is verified. The estimate of both costs comes from a frequency sketch of
the whole corpus; a pair needs the smaller m of the two. The prefix of a
document serves its smallest partner; each pair only counts the part of both
prefixes that its own two sizes ask for.

The result is the connected components of the links, so a pair inside a known
component need not be looked at: first each set is verified against one leader,
the set of the most frequent shingles in the lists of its prefix, then only
pairs across the components found so far, whatever their number. A list with
few sets outside its main component gives its pairs directly. In one with many,
which near copies make that lie too far from each other, the prefix filter runs
once more on what each set has more and less than what most of them have in
common: two sets that link, and are not joined by the set next to that, share
some of these rare differences, and their number tells exactly if they link.
Sets that are equal are one node throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlake.llm.base import slices
from finlake.llm.components import components
from finlake.llm.hashing import shingle_sets
from finlake.session import stage_table

#: Counters of the frequency sketch (16 MB), and the parts it is added up in.
SKETCH_BITS, SKETCH_PARTS = 22, 32
#: Longest extension of a prefix, and what verifying a pair costs in list entries, for each shingle.
MOST_MATCHES, VERIFY_COST = 4, 0.05
#: Sets outside the main component with which a list gives its pairs directly. Shingles of a part of pairs.
MOST_OUTSIDERS, PART_SHINGLES = 16, 1 << 20
#: Sets whose common tokens are the reference of a crowded list.
SAMPLE = 31
#: Bits that tell which texts a join asks for (8 MB).
ASKED_BITS = 1 << 26

#: Tells a token that a set lacks from the same one that a set has.
_MISSING = np.uint64(0x5555555555555555)


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, words: int, text_col: str = "text") -> np.ndarray:
    """How many documents have a shingle of each counter: never below the true frequency of a shingle.

    Tasks send compressed counters in parts; each part is added up batch by
    batch. The sum has a fixed size, whatever the corpus.
    """
    size = 1 << SKETCH_BITS
    part = size // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint32)
        waiting: list[np.ndarray] = []
        n = 0

        def add() -> None:
            if waiting:
                at, times = np.unique(_counter(np.concatenate(waiting)), return_counts=True)
                total[at] += times.astype(np.uint32)

        for batch in slices(batches):
            for s in shingle_sets([t or "" for t in batch.column(0).to_pylist()], words):
                waiting.append(s)
                n += len(s)
            if n > 1 << 20:
                add()
                waiting, n = [], 0
        add()
        packer = zstandard.ZstdCompressor(level=1)
        for i in range(SKETCH_PARTS):
            here = total[i * part:(i + 1) * part]
            if here.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([packer.compress(here.tobytes())], pa.binary())], names=["part", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpacker = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = np.frombuffer(unpacker.decompress(counts), np.uint32)
                sums[i] = sums[i] + here if i in sums else here.astype(np.int64)
        packer = zstandard.ZstdCompressor(level=1)
        for i, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([packer.compress(s.tobytes())], pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    parts = docs.select(text_col).mapInArrow(count, kind).repartition(SKETCH_PARTS, "part").mapInArrow(add_up, kind)
    out = np.zeros(size, dtype=np.int64)
    for i, counts in parts.collect():
        out[i * part:(i + 1) * part] += np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def prefix(tokens: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The adaptive prefix of one set, and the matches m that it was lengthened for.

    ``tokens`` are sorted; their order is by sketch count, then by hash, the
    same for every document. Another set that links overlaps in at least
    ``percent`` percent of the tokens.
    """
    n = len(tokens)
    overlap = -(-percent * n // 100)
    order = np.argsort(counts, kind="stable")
    lists = np.maximum(counts[order] - noise - 1, 0)
    entries = np.cumsum(lists)
    best, best_cost = 1, float("inf")
    for m in range(1, min(MOST_MATCHES, overlap) + 1):
        read = float(entries[n - overlap + m - 1])
        # At most read / m sets share m of these tokens.
        cost = read + VERIFY_COST * n * read / m
        if cost < best_cost:
            best, best_cost = m, cost
    return tokens[order[:n - overlap + best]], best


def set_node(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def profiles(docs: DataFrame, sketch: Broadcast, mean: float, words: int, percent: int) -> DataFrame:
    """(doc_id, n, node, m, hub, prefix) of each row; rows without words have n = 0 and no node.

    ``hub`` tells how frequent the set's shingles are; an edited copy has rare ones that its origin lacks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in slices(batches):
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], words)
            found = [counts[_counter(s)] for s in sets]
            made = [prefix(s, c, mean, percent) if len(s) else (s, 0) for s, c in zip(sets, found)]
            # Rows with a null id are not in the sketch, so theirs may be 0.
            hubs = [int(1000 * np.log2(np.maximum(c, 1)).mean()) if len(c) else 0 for c in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_node(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([m for _, m in made], pa.int32()), pa.array(hubs, pa.int32()),
                pa.array([p.view(np.int64) for p, _ in made], pa.list_(pa.int64())),
            ], names=["doc_id", "n", "node", "m", "hub", "prefix"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, node long, m int, hub int, prefix array<long>")


def asked_docs(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids`` (one column), and a few more: the join after it shuffles only these texts.

    Ids are marked in a bitmap of fixed size, broadcast in at most ASKED_BITS / 32768 rows.
    """
    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(ASKED_BITS)) + F.lit(1)

    at = place(ids.columns[0])
    marks = ids.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_marks"))
    placed = docs.withColumn("_bit", F.bitmap_bit_position(place("doc_id"))).withColumn("_bucket", F.bitmap_bucket_number(place("doc_id")))
    marked = F.expr("shiftright(cast(conv(hex(substring(_marks, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) & 1 = 1")
    return placed.join(F.broadcast(marks), "_bucket").where(marked).select(*docs.columns)


def _paired(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, work: Callable, kind: str,
            references: DataFrame | None = None) -> DataFrame:
    """``work`` over the sets of each pair (``a``, ``b``), in parts of about PART_SHINGLES shingles.

    A part gets the text of each of its ``a``, and once, however many pairs
    ask for it, the text of a ``b``, or its ``tokens`` in ``references``. A
    ``b`` with more pairs than a part holds goes to several parts. ``work``
    gets lists of (a, b, set of a, set of b) and returns a record batch.
    """
    spark = pairs.sparkSession
    ids = nodes.select("node", "doc_id", "n")
    named = stage_table(pairs.select("a", "b").join(ids.toDF("a", "_a", "n_a"), "a").join(ids.toDF("b", "_b", "n_b"), "b"), "pairs")
    sizes = named.groupBy("b").agg((F.sum("n_a") + F.first("n_b")).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_SHINGLES))
    hot = sizes.where(F.col("size") > PART_SHINGLES).select("b", F.ceil(F.col("size") / PART_SHINGLES).alias("_salts"))
    salt = F.pmod(F.xxhash64("a"), F.coalesce("_salts", F.lit(1)))
    dealt = named.join(hot, "b", "left").withColumn("part", F.pmod(F.xxhash64("b", salt), F.lit(parts)))
    left = dealt.join(asked_docs(docs, named.select("_a")).toDF("_a", "text"), "_a").select("part", "a", "b", "text")
    asked = dealt.select("part", "b", "_b").distinct().toDF("deal", "b", "_b")
    if references is None:
        right = asked.join(asked_docs(docs, named.select("_b")).toDF("_b", "text"), "_b").select("deal", "text")
    else:
        right = asked.join(references, "b").select("deal", F.col("b").alias("node"), "tokens")
    words = work.words

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # An id that several texts share comes with each of them: the set tells which one is meant.
        if "text" in right.column_names:
            second = _sets_of(right, words)
        else:
            second = {b: np.array(t, dtype=np.int64).view(np.uint64) for b, t in zip(right["node"].to_pylist(), right["tokens"].to_pylist())}
        out = [work([])]
        for batch in slices(left.to_batches(), 256):
            first = _sets_of(batch, words)
            wanted = dict.fromkeys(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
            out.append(work([(a, b, first[a], second[b]) for a, b in wanted if a in first and b in second]))
        return pa.Table.from_batches(out)

    return left.groupBy("part").cogroup(right.groupBy("deal")).applyInArrow(run, kind)


def _sets_of(rows: pa.Table | pa.RecordBatch, words: int) -> dict[int, np.ndarray]:
    """The sets of the texts of ``rows`` by their nodes."""
    texts = list({t for t in rows.column("text").to_pylist() if t is not None})
    return {set_node(s): s for s in shingle_sets(texts, words) if len(s)}


class _Similar:
    """Keeps the pairs whose sets have the Jaccard similarity."""

    def __init__(self, words: int, percent: int) -> None:
        self.words, self.percent = words, percent

    def __call__(self, pairs: list[tuple]) -> pa.RecordBatch:
        kept = []
        for a, b, s, t in pairs:
            common = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * common >= self.percent * (len(s) + len(t) - common):
                kept.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The (``a``, ``b``) of ``pairs`` whose sets have the Jaccard similarity, from the whole texts."""
    return _paired(pairs, nodes, docs, _Similar(words, percent), "a long, b long")


def references(crowded: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(``b``, ``tokens``): what more than half of SAMPLE sets of each leader ``b`` hold.

    Differences to any set lead to the same links; few of them need looking at
    when it is near to all, so the sample decides on work and not on results.
    """
    order = Window.partitionBy("b").orderBy(F.xxhash64("a"), "a")
    chosen = crowded.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= SAMPLE)
    chosen = stage_table(chosen.select("a", "b").join(nodes.select(F.col("node").alias("a"), "doc_id"), "a"), "chosen")
    texts = chosen.join(asked_docs(docs, chosen.select("doc_id")), "doc_id")

    def common(rows: pa.Table) -> pa.Table:
        wanted = set(rows["a"].to_pylist())
        sets = [s for node, s in _sets_of(rows, words).items() if node in wanted]
        tokens, held = np.unique(np.concatenate(sets), return_counts=True)
        return pa.table({"b": rows["b"].slice(0, 1), "tokens": pa.array([tokens[2 * held > len(sets)].view(np.int64)], pa.list_(pa.int64()))})

    return texts.select("a", "b", "text").groupBy("b").applyInArrow(common, "b long, tokens array<long>")


class _Differences:
    """What a set has more and less than a reference, the tokens that few others differ in first."""

    kind = "node long, leader long, n long, n_ref long, missing long, size long, keys array<long>"

    def __init__(self, words: int, sketch: Broadcast) -> None:
        self.words, self.sketch = words, sketch

    def __call__(self, pairs: list[tuple]) -> pa.RecordBatch:
        rows = []
        counts = self.sketch.value
        for node, leader, own, ref in pairs:
            added, missing = np.setdiff1d(own, ref, assume_unique=True), np.setdiff1d(ref, own, assume_unique=True)
            often = counts[_counter(ref)].max() if len(ref) else 0
            seen = np.concatenate([counts[_counter(added)], often - counts[_counter(missing)]])
            marks = np.concatenate([added, missing ^ _MISSING])
            rows.append((node, leader, len(own), len(ref), len(missing), len(marks), marks[np.lexsort((marks, seen))].view(np.int64)))
        columns = list(zip(*rows)) or [()] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.list_(pa.int64()))],
            names=[f.split()[0] for f in self.kind.split(", ")])


def _need(percent: int) -> str:
    """The overlap that two sizes ask for."""
    return f"((n + n_b) * {percent} + {99 + percent}) div {100 + percent}"


def _similar(percent: int) -> str:
    return f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)"


def shingle_lists(live: DataFrame) -> DataFrame:
    """(``token``, ``node``, ``n``, ``m``, ``hub``, ``_at``, ``leader``, ``n_b``, ``m_b``): prefix tokens that several sets have.

    The leader of a list comes with its size and matches, so that no join on it is needed.
    """
    entries = live.select(F.posexplode("prefix").alias("_at", "token"), "node", "n", "m", "hub")
    # Lists of one set hold no pair, and most lists do.
    leaders = entries.groupBy("token").agg(
        F.min("node").alias("_first"), F.max("node").alias("_last"),
        F.max(F.struct("hub", "node", "n", "m")).alias("_leader"))
    leaders = leaders.where("_first != _last").select(
        "token", F.col("_leader.node").alias("leader"), F.col("_leader.n").alias("n_b"), F.col("_leader.m").alias("m_b"))
    return entries.join(leaders, "token").dropDuplicates(["token", "node"])


def leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``): each set and the leader that it shares the most prefix tokens with, if enough."""
    shared = lists.where("node != leader").where(_similar(percent)).where(f"_at < n - {_need(percent)} + least(m, m_b)")
    shared = shared.groupBy("node", "leader").agg(F.count("*").alias("k"), F.first(F.least("m", "m_b")).alias("m"))
    return shared.where("k >= m").groupBy("node").agg(F.max_by("leader", F.struct("k", "leader")).alias("b")).select(
        F.col("node").alias("a"), "b")


def mixed_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """``lists`` that hold several components: with ``root`` of each set, ``main`` component and ``outsiders`` of the list."""
    placed = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("token", "root").count()
    main = sizes.groupBy("token").agg(
        F.max_by("root", "count").alias("main"), (F.sum("count") - F.max("count")).alias("outsiders"))
    return placed.join(main.where("outsiders > 0"), "token")


def list_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``) across components of lists with at most MOST_OUTSIDERS outsiders: so many rows for an entry at most."""
    few = mixed.where(F.col("outsiders") <= MOST_OUTSIDERS).select("token", "node", "n", "_at", "root", "main")
    other = few.select("token", F.col("node").alias("node_b"), F.col("n").alias("n_b"), F.col("_at").alias("_at_b"), F.col("root").alias("root_b"))
    pairs = few.where("root != main").join(other, "token").where("root != root_b and (root_b = main or node < node_b)")
    # The first shingle that a linked pair shares lies in the single-match part of both prefixes.
    need = _need(percent)
    return pairs.where(_similar(percent)).where(f"_at <= n - {need} and _at_b <= n_b - {need}").select(
        F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def crowded_leaders(mixed: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``): the sets of lists with more outsiders, and a leader of about their size to tell them by.

    A list is cut by size into classes in whose steps a linked pair is at most
    one apart; each set enters its own class and the one below.
    """
    step = math.log(100 / percent) + 1e-6 if percent < 100 else 1e-6
    crowded = mixed.where(F.col("outsiders") > MOST_OUTSIDERS).select("token", "node", "n", "hub")
    size = F.floor(F.log("n") / F.lit(step))
    classed = crowded.withColumn("class", F.explode(F.array(size, size - 1)))
    leaders = classed.groupBy("token", "class").agg(F.max_by("node", F.struct("hub", "node")).alias("b"))
    return classed.join(leaders, ["token", "class"]).select(F.col("node").alias("a"), "b").distinct()


def measured(differences: DataFrame, percent: int) -> DataFrame:
    """``differences`` with each set's distance ``w`` to its reference, and the ``nearest`` set and its distance ``w_0``.

    With p = percent / (100 + percent), d missing and a added tokens, two sets
    u and v of one reference of size n link when they share at least
    p * (n_u + n_v) - n + d_u + d_v = w_u + w_v - c differences, where
    w = p * a + (1 - p) * d and c = (1 - 2 p) * n. ``w`` is in parts of
    1 / (100 + percent). All pairs that need none have both sets ``close``:
    they link with the nearest one.
    """
    w = (F.lit(percent) * (F.col("size") - F.col("missing")) + F.lit(100) * F.col("missing")).alias("w")
    far = differences.select("*", w)
    nearest = far.groupBy("leader").agg(F.min("w").alias("w_0"), F.min_by("node", F.struct("w", "node")).alias("nearest"))
    # The sets of a leader are joined by it, and spread: each has a row for every leader only.
    return far.join(nearest, "leader").withColumn("lacks", F.col("w") + F.col("w_0") - F.lit(100 - percent) * F.col("n_ref")).withColumn(
        "close", F.col("lacks") <= 0)


def difference_links(differences: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``) across components that share enough of their differences to one reference.

    One of the two is not close. Then the other, v, has to share more than
    w_v - w_0 of its own differences, and u at least as many as it lacks to
    the nearest set: either bound gives a prefix. The pair's own bound cuts
    both again, and what the pairs left have in common is counted whole.
    """
    placed = stage_table(differences.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    whole = 100 + percent
    short = f"size - (w - w_0) div {whole}"
    own = f"if(close, {short}, size - (lacks + {whole - 1}) div {whole} + 1)"
    cut = placed.withColumn("keys", F.expr(f"slice(keys, 1, cast({own} as int))")).withColumn("short", F.expr(short))
    entries = cut.select(F.posexplode("keys").alias("_at", "key"), *[c for c in cut.columns if c not in ("keys", "w", "w_0", "lacks", "nearest")])
    several = entries.groupBy("leader", "key").agg(
        F.min("root").alias("_first"), F.max("root").alias("_last"), F.min("close").alias("_close"))
    several = several.where("_first != _last and not _close").select("leader", "key")
    entries = stage_table(entries.join(several, ["leader", "key"]), "differences")
    other = entries.where("_at < short").select(
        "leader", "key", *(F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "missing", "size", "_at")))
    least = f"({_need(percent)} - n_ref + missing + missing_b)"
    pairs = entries.where("not close").join(other, ["leader", "key"]).where("root != root_b").where(_similar(percent))
    pairs = pairs.where(f"_at <= size - {least} and _at_b <= size_b - {least}").select(
        "leader", F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"), F.expr(least).alias("least")).distinct()
    keys = placed.select("leader", "node", "keys")
    both = pairs.join(keys.toDF("leader", "a", "keys"), ["leader", "a"]).join(keys.toDF("leader", "b", "keys_b"), ["leader", "b"])
    return both.where(F.size(F.array_intersect("keys", "keys_b")) >= F.col("least")).select("a", "b")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets
    of ``words``-word shingles (A-Z lower-cased; fewer words are one shingle).
    ``component_id`` is the smallest id reachable by links. Null and empty
    texts and texts of white space have no set and link with nothing; rows
    with a null id take no part and have a null component. Repeated rows and
    rows that share an id are separate rows. An empty table gives no rows;
    other columns are not read. All links between different sets count; no
    list or group is cut.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    spark = docs.sparkSession
    counts = frequency_sketch(known, words)
    sketch = spark.sparkContext.broadcast(counts)  # fixed size
    sets = stage_table(profiles(docs, sketch, float(counts.mean()), words, percent), "sets")
    live = sets.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = stage_table(live.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("m").alias("m")), "nodes")
    lists = stage_table(shingle_lists(live), "lists")

    first = stage_table(leader_pairs(lists, percent), "pairs")
    links = stage_table(verify(first, nodes, known, words, percent), "links")
    roots = stage_table(components(links), "roots")
    seen = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    mixed = stage_table(mixed_lists(lists, roots), "mixed")
    across = list_pairs(mixed, percent)
    crowded = stage_table(crowded_leaders(mixed, percent), "crowded")
    if not crowded.isEmpty():
        common = stage_table(references(crowded, nodes, known, words), "references")
        work = _Differences(words, sketch)
        differences = stage_table(measured(_paired(crowded, nodes, known, work, work.kind, common), percent), "differences")
        near = differences.where("close and node != nearest").select(F.col("node").alias("a"), F.col("nearest").alias("b"))
        links = links.unionByName(near)
        roots = stage_table(components(links), "roots")
        links = links.unionByName(stage_table(difference_links(differences, roots, percent), "links"))

    # A pair needs the smaller m of the two in the whole prefixes.
    across = stage_table(across.join(seen.distinct(), ["a", "b"], "left_anti"), "across")
    whole = live.join(nodes.select("node", "doc_id"), ["node", "doc_id"]).select("node", "m", "prefix")
    second = across.join(whole.toDF("a", "m", "prefix"), "a").join(whole.toDF("b", "m_b", "prefix_b"), "b").where(
        F.size(F.array_intersect("prefix", "prefix_b")) >= F.least("m", "m_b")).select("a", "b").distinct()
    more = stage_table(verify(second, nodes, known, words, percent), "links")
    roots = components(links.unionByName(more))

    members = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = members.withColumnRenamed("doc_id", "_first")
    smallest = members.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = stage_table(members.join(smallest, "root").select("node", "component_id"), "named")
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "node")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    # Rows without a set stay out of the join, where they would all meet.
    return rows.where(F.col("node").isNotNull()).join(named, "node", "left").select("doc_id", "n_shingles", own).unionByName(
        rows.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def oracle(words: int, percent: int) -> str:
    """DuckDB SQL for :func:`jaccard_components` of ``documents``: lists of shingles, links, and what they reach."""
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {words - 1}], ' ') FOR i IN range(1, len(w) - {words - 2})]) END AS s FROM split),
items AS (SELECT doc_id, unnest(s) AS t, len(s) AS n FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.root)
SELECT doc_id, len(s) AS n_shingles, min(root) AS component_id FROM sets JOIN reach USING (doc_id) GROUP BY doc_id, len(s)"""
