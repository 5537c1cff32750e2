"""Near-duplicate documents by SetSketch registers.

A document is its set of five-word shingles. Register i holds the smallest of the set's exponentially
distributed hash values, as its place on a grid of exponentially spaced values, truncated at both ends;
registers of a union are the larger ones of its parts, and two sets agree in a register about as
often as their Jaccard similarity says. Steps:

1. Equal sets become one class with a number of its own; copies go no further. Which documents a class
   holds is only looked up again at the end, so it does not matter whether doc_ids repeat or are missing.
2. Bands of registers deal the classes into buckets. Classes that share a bucket are candidates. A pair
   at similarity s shares none of `BANDS` bands of `ROWS` registers with chance (1 - s ** ROWS) ** BANDS,
   2e-9 at 0.85.
3. The head of a bucket is the class with most company in all its buckets: in a group of near copies,
   the text that the others are edits of. Each class first meets the head that it shares most buckets
   with, and verified links make components. So a large group becomes one component at one pair per
   member.
4. Of what is left in a bucket, all pairs of different components are compared by the joint likelihood
   of their registers, in cells of bounded size, and rows that may reach the threshold with another go
   on. Rows of a bucket's largest component only meet those of others.
5. Every link is verified on the full sets of the texts: first the pairs with a head, in cells of a head
   and at most BLOCK of its members or so, then inside the cells of what went on. A cell gives the links
   that connect its rows, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricelane.config import PricingConfig
from pricelane.functions.hot import join_split
from pricelane.llm import words
from pricelane.llm.components import components
from pricelane.llm.work import written

SHINGLE = 5
ROWS, BANDS = 6, 42
REGISTERS = ROWS * BANDS
#: Parameters of the sketch: base of the grid, rate of the exponential distribution, grid size.
B, RATE, GRID = 1.001, 20.0, 2 ** 16 - 2
BLOCK = 512
#: A pair goes on unless its likelihood at the threshold is below its maximum by this (6.3 sigma).
DOUBT = 20.0

_random = np.random.default_rng(5)
PLACE = _random.integers(0, 2 ** 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIERS = _random.integers(0, 2 ** 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MIX = _random.integers(0, 2 ** 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: By byte: everything but \x20 and \x09-\x0D belongs to words.
LETTER = np.array([0 if i == 0x20 or 0x09 <= i <= 0x0D else i for i in range(256)], np.uint8)
LETTER[0] = 0xFF  # a byte that UTF-8 never has


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each lower-cased text."""
    found = words.split(texts, LETTER)
    value = found.hashes()
    sets = []
    whole = np.zeros(max(0, len(value) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        whole += value[k:k + len(whole)] * PLACE[k]
    whole = words.mixed(whole)
    for a, b in zip(found.bounds[:-1], found.bounds[1:]):
        if b - a >= SHINGLE:
            sets.append(np.unique(whole[a:b - SHINGLE + 1]))
        elif b > a:
            short = (value[a:b] * PLACE[:b - a]).sum(keepdims=True) + PLACE[SHINGLE:] * np.uint64(b - a)
            sets.append(words.mixed(short))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """[set, register]; zeros for empty sets."""
    full = [i for i, s in enumerate(sets) if len(s)]
    found = np.zeros((len(sets), REGISTERS), np.uint16)
    if not full:
        return found
    flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
    least = np.empty((REGISTERS, len(full)), np.uint32)
    product = np.empty_like(flat)
    for i, factor in enumerate(MULTIPLIERS):
        np.multiply(flat, factor, out=product)
        np.minimum.reduceat(product, starts, out=least[i])
    uniform = (least.T.astype(np.float64) + 0.5) / 2.0 ** 32
    exponential = -np.log1p(-uniform) / RATE
    grid = np.floor(1 - np.log(exponential) / np.log(B))
    found[full] = np.clip(grid, 0, GRID + 1).astype(np.uint16)
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    """[set, band]: a 64-bit key of the band's registers and its number."""
    value = found.reshape(len(found), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    keys = (value * MIX).sum(2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return words.mixed(words.mixed(keys))


def likely(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may be similar, by the joint likelihood of their registers: `more` registers of
    the first are larger, `less` are smaller, and n1 and n2 are the sizes of the sets."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    most = np.minimum(u / v, v / u)
    possible = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)

    def chance(x):
        return -np.log1p(-np.clip(x, 1e-9, 1) * (B - 1) / B) / np.log(B)

    def likelihood(j):
        p, m = chance(u[:, None] - v[:, None] * j), chance(v[:, None] - u[:, None] * j)
        rest = np.maximum(1 - p - m, 1e-12)
        same = REGISTERS - more - less
        return more[:, None] * np.log(p) + less[:, None] * np.log(m) + same[:, None] * np.log(rest)

    best = likelihood(most[:, None] * np.linspace(0, 1, 41)).max(1)
    steps = np.linspace(0, 1, 9)
    low = np.minimum(percent / 100, most)[:, None]
    similar = likelihood(low + (most[:, None] - low) * steps).max(1)
    return possible & (best - similar <= DOUBT)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, raw (a hash of the text), n, digest (of the set; null without words), registers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in words.slices(batch.column(2)):
                sets = shingle_sets(texts)
                rows = registers(sets)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(at, len(texts)) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                              for s in sets], pa.binary()),
                    pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary())],
                    names=["doc_id", "raw", "n", "digest", "registers"])

    return docs.select(F.col("doc_id").cast("long"), _raw(), F.col("text").cast("string")) \
        .mapInArrow(run, "doc_id long, raw long, n long, digest binary, registers binary")


def _raw() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("raw")


def as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            keys = band_keys(as_registers(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.asarray(part.column(0)), BANDS)), pa.array(keys.ravel().view(np.int64))],
                names=["id", "key"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell (key, i, j) of a sorted stream, one cell at a time, without lone rows."""
    rest = None
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            rest = part if rest is None else pa.concat_batches([rest, part])
            done = 0
            change = np.any([np.diff(np.asarray(rest.column(i))) != 0 for i in range(3)], axis=0)
            for cut in np.flatnonzero(change) + 1:
                if cut - done > 1:
                    yield rest.slice(done, cut - done)
                done = int(cut)
            rest = rest.slice(done)
    if rest is not None and len(rest) > 1:
        yield rest


def likely_pairs(cell: pa.RecordBatch, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows that it may be similar to) of a cell: of different components, in blocks that face
    each other, and in no earlier band together, where the pair is looked at already."""
    roots, sizes, side = (np.asarray(cell.column(i)) for i in (4, 5, 6))
    regs = as_registers(cell.column(7))
    keys, own = band_keys(regs), np.asarray(cell.column(0)).view(np.uint64)[0]
    right = np.flatnonzero(side != 0)
    for i in np.flatnonzero(side != 1):
        other = right[(roots[right] != roots[i]) & ((side[i] == 0) | (right > i))]
        other = other[100 * np.minimum(sizes[other], sizes[i]) >= percent * np.maximum(sizes[other], sizes[i])]
        other = other[keys[i, (keys[other] == keys[i]).argmax(1)] == own]
        if len(other):
            more = (regs[i] > regs[other]).sum(1).astype(float)
            less = (regs[i] < regs[other]).sum(1).astype(float)
            n = np.full(len(other), float(sizes[i]))
            other = other[likely(more, less, n, sizes[other].astype(float), percent)]
        if len(other):
            yield int(i), other


def _promising(percent: int):
    """The rows of each cell that may be similar to some other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            keep = np.zeros(len(cell), bool)
            for i, other in likely_pairs(cell, percent):
                keep[i] = True
                keep[other] = True
            if keep.any():
                yield cell.filter(pa.array(keep))
    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _linked(percent: int):
    """Links between the rows of a cell, verified on the full sets of the texts: enough of them to
    connect what is connected, so one less than there are rows at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            ids, group = np.asarray(cell.column(3)), np.asarray(cell.column(4)).copy()
            texts, sets, found = cell.column(8), {}, []

            def set_of(i):
                if i not in sets:
                    sets[i] = shingle_sets([texts[i].as_py().encode("utf-8", "surrogatepass").lower()])[0]
                return sets[i]

            for i, other in likely_pairs(cell, percent):
                for j in other.tolist():
                    if group[i] != group[j] and similar(set_of(i), set_of(j), percent):
                        found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                        group[group == group[j]] = group[i]
            if found:
                low, high = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                                                 names=["low", "high"])
    return run


def _verify(percent: int):
    """The links between heads and members of a stream (head, cell, id, text) in which each cell starts
    with its head, whose id is null. A head's set is made once per cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            low, high = [], []
            for at, texts in words.slices(batch.column(3)):
                sets = shingle_sets(texts)
                for head, member, found in zip(batch.column(0).slice(at, len(texts)).to_pylist(),
                                               batch.column(2).slice(at, len(texts)).to_pylist(), sets):
                    if member is None:
                        own = found
                    elif similar(own, found, percent):
                        low.append(min(head, member))
                        high.append(max(head, member))
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["low", "high"])
    return run


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """low, high: the pairs (id, head) whose texts' full sets are similar. The members of a head are dealt
    into cells, each of which gets the head's text once."""
    sizes = pairs.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cells"))
    members = pairs.join(sizes, "head").withColumn("cell", F.pmod(F.xxhash64("id"), "cells").cast("int"))
    members = members.join(texts, "id").select("head", "cell", "id", "text")
    heads = sizes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))) \
        .join(texts.toDF("head", "text"), "head").select("head", "cell", F.lit(None).cast("long").alias("id"), "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return heads.unionAll(members).repartition(parts, "head", "cell").sortWithinPartitions("head", "cell", "id") \
        .mapInArrow(_verify(percent), "low long, high long").distinct()


def dealt(rooted: DataFrame) -> DataFrame:
    """key, i, j, id, root, side: the cells in which the rows (key, size, id, root) of buckets with several
    roots meet. Rows of a bucket's largest root, if they are more than a block, have blocks of their own,
    which meet the blocks of the other rows only; all other blocks of a bucket meet each other."""
    per_root = rooted.groupBy("key", "root").agg(F.count("*").alias("m"))
    largest = per_root.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("m", "root")).alias("most")) \
        .filter("roots > 1").select("key", F.col("most.m").alias("m"), F.col("most.root").alias("main"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    apart = F.when(F.col("m") > BLOCK, F.col("m")).otherwise(0)
    own = (F.col("m") > BLOCK) & (F.col("root") == F.col("main"))
    lot = F.xxhash64("id")
    return rooted.join(largest, "key") \
        .withColumn("rest", blocks(F.col("size") - apart)).withColumn("all", F.col("rest") + blocks(apart)) \
        .withColumn("block", F.when(own, F.col("rest") + F.pmod(lot, F.col("all") - F.col("rest")))
                    .otherwise(F.pmod(lot, F.col("rest"))).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("rest")).otherwise(F.col("all")) - 1))) \
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "root",
                F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
                .alias("side"))


def linked_classes(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """id, root of the classes (id, doc, raw, n, registers) that are linked to a smaller one. doc and raw: the
    doc_id and hash of a text of the class."""
    bands = written(classes.select("id", "registers").mapInArrow(_bands, "id long, key long"), "bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = written(bands.join(shared, "key"), "shared")
    company = buckets.groupBy("id").agg(F.sum("size").alias("company"))
    heads = buckets.join(company, "id").groupBy("key").agg(
        F.max(F.struct("company", (-F.col("id")).alias("h"))).alias("best")) \
        .select("key", (-F.col("best.h")).alias("head"))
    members = written(buckets.join(heads, "key"), "buckets")
    rows = docs.select(F.col("doc_id").cast("long"), _raw(), F.coalesce("text", F.lit("")).alias("text"))
    asked = classes.join(members.select("id").distinct(), "id", "left_semi") \
        .select(F.col("id"), F.col("doc").alias("class_doc"), F.col("raw").alias("class_raw"))
    same = F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("raw") == F.col("class_raw"))
    texts = written(rows.join(asked, same).groupBy("id").agg(F.first("text").alias("text")), "texts")  # of equal rows one

    # the head that a class shares most buckets with
    first = members.filter("id != head").groupBy("id", "head").agg(F.count("*").alias("shared")) \
        .groupBy("id").agg(F.max(F.struct("shared", (-F.col("head")).alias("h"))).alias("best")) \
        .select(F.col("id"), (-F.col("best.h")).alias("head"))
    links = written(verified(first, texts, percent), "links")
    roots = written(components(links), "roots")

    rooted = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = dealt(rooted)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_cells = lambda rows: rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    cells = open_.join(classes, "id").select("key", "i", "j", "id", "root", "n", "side", "registers")
    near = written(in_cells(cells).mapInArrow(_promising(percent), cells.schema), "near")
    more = written(in_cells(near.join(texts, "id").select(*near.columns, "text"))
                   .mapInArrow(_linked(percent), "low long, high long"), "links")
    if more.isEmpty():
        return roots
    return components(links.unionByName(more))


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, raw, n, component_id, one row per row of `docs`."""
    rows = written(sketches(docs), "sketches")
    named = rows.filter(F.col("digest").isNotNull())
    classes = named.groupBy("digest").agg(
        F.min(F.struct("doc_id", "raw")).alias("of"), F.min("doc_id").alias("low"), F.first("n").alias("n"),
        F.first("registers").alias("registers"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "digest", "low", "n", "registers",
                                     F.col("of.doc_id").alias("doc"), F.col("of.raw").alias("raw")), "classes")
    roots = linked_classes(docs, classes.select("id", "doc", "raw", "n", "registers"), percent)
    rooted = classes.select("digest", "id", "low").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    split = PricingConfig(hot_rows=1000)  # a set with many rows, or a root with many sets, is spread over slices
    rooted = written(rooted.select("digest", "root", F.col("id").alias("class_id")), "rooted")
    found = join_split(rooted, lowest, ["root"], F.col("class_id"), split).select("digest", "component_id")
    met = join_split(named.select("doc_id", "raw", "n", "digest"), found, ["digest"], F.monotonically_increasing_id(), split)
    columns = ["doc_id", "raw", "n", "component_id"]
    empty = rows.filter(F.col("digest").isNull()).withColumn("component_id", F.col("doc_id"))
    return met.select(*columns).unionAll(empty.select(*columns))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_shingles (size of
    the set), component_id (smallest doc_id reachable by links, itself included), kept.

    Linked are documents with 100 * intersection >= percent * union of their sets. A text of fewer than
    five words is one shingle; a null text or one without words has an empty set and no links. Rows that
    share a doc_id are told apart by their texts: each is linked, and kept or not, by its own. Rows without
    a doc_id are linked like others; component_id is null, and all are kept, if no row of theirs has one.
    An empty table gives no rows.
    """
    return _judged(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                         F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: those that near_duplicates() keeps, found by
    doc_id and text. Empty texts stay; equal rows stay or go together. An empty table gives no rows."""
    kept = _judged(docs, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))) \
        .select(F.col("doc_id").alias("kept_id"), F.col("raw").alias("kept_raw")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select("*", _raw()).toDF(*names, "own_raw")
    ids = F.col(names[docs.columns.index("doc_id")]).cast("long")
    return own.join(kept, ids.eqNullSafe(F.col("kept_id")) & (F.col("own_raw") == F.col("kept_raw")), "left_semi") \
        .select(*names).toDF(*docs.columns)
