"""Audit of how far the sources of a language differ in the terms that they use.

Terms are counted in numpy, in buckets by length. A term of up to 8 bytes is one 64-bit word, one of up
to 16 bytes two, padded with zero bytes (no term holds one), so that the order of numbers is the order
of bytes. Words are radix-sorted by their 16-bit digits, together with language and source, and equal
ones lie in runs that are counted. Longer terms go to a bucket per width (a power of two) and are sorted
as bytes. A task folds what it has counted again and again, so it hands out few rows: one per language
and term, with the counts by source beside it.

Everything after that is DataFrame work: languages keep the terms with enough documents, shares are
exact integers, and sources are compared in cells of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pricelane.llm import cells, words
from pricelane.llm.work import written

#: By byte: a-z and all bytes beyond ASCII belong to terms (A-Z are lower-cased before).
LETTER = np.array([i if 0x61 <= i <= 0x7A or i >= 0x80 else 0 for i in range(256)], np.uint8)
OUTSIDE = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Rows of a table that are folded at once, and rows after which a task hands out what it has.
FOLD, HELD = 1 << 20, 1 << 21
#: Rows of a cell and sources of a block in the comparison of sources.
CELL, BLOCK = 1 << 15, 256
#: Shares are whole parts of this.
SCALE, EXTRA = 10 ** 9, 5
MASK = np.array([(1 << 64) - (1 << 64 - 8 * k) if k else 0 for k in range(9)], np.uint64)

COUNTED = "lang string, term string, docs long, sources array<string>, counts array<long>"


class Table(NamedTuple):
    """Counted terms: keys (language, the words or the bytes of the term, source) and their numbers."""
    keys: tuple[np.ndarray, ...]
    count: np.ndarray
    docs: np.ndarray


# -- sorting ---------------------------------------------------------------------------------------

def radix_order(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """A stable order by `keys`, the first one above all. Numbers are sorted by their 16-bit digits from
    the last one on; bytes as they are."""
    order = None
    for key in reversed(keys):
        if key.dtype.kind == "S":
            step = np.argsort(key if order is None else key[order], kind="stable")
            order = step if order is None else order[step]
            continue
        for shift in range(0, 8 * key.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit == digit[0]).all():
                continue
            step = np.argsort(digit if order is None else digit[order], kind="stable")  # radix sort on 16 bits
            order = step if order is None else order[step]
    return np.arange(len(keys[0])) if order is None else order


def runs(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where a row differs from the one before; the first row does."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def fold(tables: list[Table]) -> Table:
    """One table with one row per key, in order."""
    keys = tuple(np.concatenate(k) for k in zip(*(t.keys for t in tables)))
    count, docs = (np.concatenate(x) for x in zip(*((t.count, t.docs) for t in tables)))
    order = radix_order(keys)
    keys = tuple(k[order] for k in keys)
    first = np.flatnonzero(runs(keys))
    return Table(tuple(k[first] for k in keys), np.add.reduceat(count[order], first), np.add.reduceat(docs[order], first))


# -- counting --------------------------------------------------------------------------------------

def packed(found: words.Words) -> Iterator[tuple[object, np.ndarray, tuple[np.ndarray, ...]]]:
    """(bucket, which words, their packed keys) of each bucket that has words."""
    padded = np.concatenate([found.letters, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(found.letters) + 8, ">u8", padded, strides=(1,))  # the 8 bytes from each place on
    for width in (1, 2):
        which = np.flatnonzero((found.length > 8 * (width - 1)) & (found.length <= 8 * width))
        if len(which):
            first, length = found.first[which], found.length[which]
            yield width, which, tuple(
                eight[first + 8 * k].astype(np.uint64) & MASK[np.clip(length - 8 * k, 0, 8)] for k in range(width))
    long = np.flatnonzero(found.length > 16)
    if len(long):
        width = 1 << np.ceil(np.log2(found.length[long])).astype(np.int64)
        for w in np.unique(width).tolist():
            which = long[width == w]
            terms = [found.letters[a:a + n].tobytes() for a, n in zip(found.first[which].tolist(), found.length[which].tolist())]
            yield f"S{w}", which, (np.array(terms, f"S{w}"),)


def counted(texts: list[bytes], lang: np.ndarray, source: np.ndarray) -> dict[object, Table]:
    """The terms of lower-cased texts by bucket. lang and source: numbers, one per text."""
    found = words.split(texts, LETTER)
    doc = np.repeat(np.arange(len(texts)), np.diff(found.bounds))
    tables = {}
    for bucket, which, terms in packed(found):
        own = doc[which]
        keys = (lang[own], *terms, source[own])
        order = radix_order(keys)  # stable: within a run documents stay in order
        keys, own = tuple(k[order] for k in keys), own[order]
        new = runs(keys)
        first = np.flatnonzero(new)
        tables[bucket] = Table(tuple(k[first] for k in keys), np.diff(np.r_[first, len(own)]),
                               np.add.reduceat((new | np.r_[True, own[1:] != own[:-1]]).astype(np.int64), first))
    return tables


def counted_long(text: bytes, lang: int, source: int, size: int = words.SLICE) -> dict[object, Table]:
    """The same for one long text, read in pieces that end outside of terms."""
    tables: dict[object, list[Table]] = {}
    at = 0
    while at < len(text):
        cut = OUTSIDE.search(text, min(len(text), at + size))
        end = cut.start() if cut else len(text)
        for bucket, table in counted([text[at:end]], np.array([lang], np.uint32), np.array([source], np.uint32)).items():
            tables.setdefault(bucket, []).append(table)
        at = end
        if cut:
            at += 1
    folded = {bucket: fold(own) for bucket, own in tables.items()}
    return {bucket: Table(t.keys, t.count, np.minimum(t.docs, 1)) for bucket, t in folded.items()}


def _terms(columns: tuple[np.ndarray, ...]) -> pa.Array:
    """Packed terms as text."""
    if columns[0].dtype.kind == "S":
        raw = columns[0].tolist()
    else:
        wide = np.stack(columns, axis=1).astype(">u8")
        raw = wide.view(f"S{8 * len(columns)}").ravel().tolist()  # without the zero bytes
    return pa.array(raw, pa.binary()).cast(pa.string())


def _handed(table: Table, langs: list[str], sources: list[str]) -> Iterator[pa.RecordBatch]:
    first = np.flatnonzero(runs(table.keys[:-1]))
    docs = np.add.reduceat(table.docs, first)
    ends = np.r_[first[1:], len(table.count)]
    names = pa.array(sources, pa.string())
    langs_ = pa.array(langs, pa.string())
    for at in range(0, len(first), 8192):
        a, b = first[at:at + 8192], ends[at:at + 8192]
        rows = slice(a[0], b[-1])
        offsets = pa.array(np.r_[a, b[-1]] - a[0], pa.int32())
        yield pa.RecordBatch.from_arrays([
            langs_.take(pa.array(table.keys[0][a])), _terms(tuple(k[a] for k in table.keys[1:-1])),
            pa.array(docs[at:at + 8192]),
            pa.ListArray.from_arrays(offsets, names.take(pa.array(table.keys[-1][rows]))),
            pa.ListArray.from_arrays(offsets, pa.array(table.count[rows]))],
            names=["lang", "term", "docs", "sources", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a whole partition. What is held stays below HELD rows, beyond which it is handed out."""
    langs: dict[str, int] = {}
    sources: dict[str, int] = {}
    held: dict[object, list[Table]] = {}

    def numbers(column, known):
        encoded = column.dictionary_encode()
        own = [known.setdefault(v, len(known)) for v in encoded.dictionary.to_pylist()]
        return np.array(own, np.uint32)[np.asarray(encoded.indices)]

    def folded():
        for bucket, tables in held.items():
            held[bucket] = [fold(tables)]
        return sum(len(t[0].count) for t in held.values())

    waiting = 0
    for batch in batches:
        lang, source = numbers(batch.column(0), langs), numbers(batch.column(1), sources)
        for at, texts in words.slices(batch.column(2)):
            if len(texts) == 1:
                found = counted_long(texts[0], int(lang[at]), int(source[at]))
            else:
                found = counted(texts, lang[at:at + len(texts)], source[at:at + len(texts)])
            for bucket, table in found.items():
                held.setdefault(bucket, []).append(table)
                waiting += len(table.count)
            if waiting >= FOLD:
                waiting = 0
                if folded() >= HELD:
                    for tables in held.values():
                        yield from _handed(tables[0], list(langs), list(sources))
                    held, langs, sources = {}, {}, {}
                    lang, source = numbers(batch.column(0), langs), numbers(batch.column(1), sources)
    folded()
    for tables in held.values():
        yield from _handed(tables[0], list(langs), list(sources))


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, source, count, lang_count, lead: the occurrences of the terms that a language keeps, in
    each source that has them and in the language. lead: one row per language and term is 1."""
    found = docs.select(*_group(), F.col("text").cast("string")).mapInArrow(_count, COUNTED)
    of_term = Window.partitionBy("lang", "term")
    kept = found.withColumn("docs", F.sum("docs").over(of_term)).filter(F.col("docs") >= min_docs)
    rows = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("of")) \
        .groupBy("lang", "term", F.col("of.sources").alias("source")).agg(F.sum("of.counts").alias("count"))
    return rows.withColumn("lang_count", F.sum("count").over(of_term)) \
        .withColumn("lead", (F.col("source") == F.min("source").over(of_term)).cast("int"))


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


# -- comparing -------------------------------------------------------------------------------------

def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + EXTRA) / (total + EXTRA * terms)), exact as long as counts fit a long."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = wide(count + EXTRA) * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", over, wide(total + EXTRA * terms))


def sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), lang_n, terms (that the language keeps), rows (of
    `kept`), groups (sources of the language), zero (the share of a term that is absent): one row per
    group that occurs, even without terms."""
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.sum("lead").alias("terms"), F.count("*").alias("rows"))
    groups = docs.select(*_group()).distinct()
    number = groups.groupBy("lang").agg(F.count("*").alias("groups"))
    zero = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("terms"))).otherwise(F.lit(0).cast("long"))
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(number, "lang") \
        .fillna(0, ["n", "lang_n", "terms", "rows"]).withColumn("zero", zero)


def top_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source has above its language, up to `top`."""
    rows = kept.join(groups, ["lang", "source"])
    apart = share(F.col("count"), F.col("n"), F.col("terms")) - share(F.col("lang_count"), F.col("lang_n"), F.col("terms"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.col("term").alias("item"), apart.alias("value")).filter("value > 0") \
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def in_cells(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, chunk, i, j, term, block, source, share, zero, terms: the rows of the cells in which two
    blocks of sources meet over a chunk of the terms. Rows without a term name all sources of a block."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("rows") / CELL)).cast("int")
    blocks = F.ceil(F.col("groups") / BLOCK).cast("int")
    own = groups.select("lang", "source", "n", "terms", "zero", chunks.alias("chunks"), blocks.alias("blocks")) \
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    names = own.select("*", F.lit(None).cast("string").alias("term"), F.col("zero").alias("share")) \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = kept.select("lang", "source", "term", "count").join(own, ["lang", "source"]) \
        .withColumn("share", share(F.col("count"), F.col("n"), F.col("terms"))) \
        .withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).select(*names.columns)
    return names.unionByName(rows) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("lang", "chunk", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "term",
                "block", "source", "share", "zero", "terms")


def cell_distances(cell: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, item, value of a cell: per pair of sources the summed difference over the terms of
    the chunk. Terms that only other blocks have differ by the shares of absent terms: all kept terms are
    taken to do so at first, in chunk 0, and each chunk takes out those that it has seen."""
    chunk, i, j = (cell.column(k)[0].as_py() for k in (1, 2, 3))
    named = cell.column(4).is_null().to_numpy(zero_copy_only=False)
    names = cell.filter(pa.array(named))
    sources = names.column(6).to_pylist()
    block, zero, terms = np.asarray(names.column(5)), np.asarray(names.column(8)), names.column(9)[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    rows = cell.filter(pa.array(~named))
    total = np.zeros((len(left), len(right)), np.int64)
    n_terms = 0
    if len(rows):
        place = pc.index_in(rows.column(6), value_set=names.column(6)).to_numpy(zero_copy_only=False)
        first = cells.starts(pa.RecordBatch.from_arrays([rows.column(4)], names=["term"]), 1)
        term = np.zeros(len(rows), np.int64)
        term[first] = 1
        term = np.cumsum(term)
        n_terms = int(term[-1]) + 1
        shares = np.asarray(rows.column(7))
        step = max(1, (1 << 21) // len(sources))
        cuts = np.searchsorted(term, np.arange(0, n_terms + step, step))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            p = np.tile(zero, (int(term[b - 1] - term[a]) + 1, 1))
            p[term[a:b] - term[a], place[a:b]] = shares[a:b]
            mine = p[:, left].T.copy()
            other = p[:, right].T.copy()
            for k in range(len(left)):
                total[k] += np.abs(other - mine[k]).sum(1)
    apart = np.abs(zero[left][:, None] - zero[right][None, :])
    total += apart * ((terms if chunk == 0 else 0) - n_terms)
    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    differ = a != b
    a, b, value = a[differ], b[differ], total.ravel()[differ]
    if i != j:
        a, b, value = np.r_[a, b], np.r_[b, a], np.r_[value, value]
    names_ = pa.array(sources, pa.string())
    lang = pa.array([cell.column(0)[0].as_py()] * len(a), pa.string())
    return pa.RecordBatch.from_arrays([lang, names_.take(pa.array(a)), names_.take(pa.array(b)), pa.array(value)],
                                      names=["lang", "source", "item", "value"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell in cells.groups(batches, 4):
        yield cell_distances(cell)


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: the distance of each source to every other source of its language."""
    met = in_cells(kept, groups).repartition("lang", "chunk", "i", "j").sortWithinPartitions("lang", "chunk", "i", "j", "term")
    found = met.mapInArrow(_distances, "lang string, source string, item string, value long")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) \
        .withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of `docs` (text, lang, source; other columns are ignored; null
    is the empty string).

    Terms are runs of letters (A-Z lower-cased, and all characters beyond ASCII). A language keeps the terms
    that at least `min_docs` of its documents have. A group (lang, source) or a language with `count`
    occurrences of a kept term, of N of all kept terms, V in number, gives it the share
    1 + floor(10**9 * (count + 5) / (N + 5 * V)). Part "pair": item is another source of the language, value
    the summed difference of shares over all kept terms. Part "term": item is a kept term that the group has,
    with a greater share than in the language, value the difference; ranks to `top`. Ranks start at 1 per
    group and part, by falling value, then item. Repeated rows count as documents of their own. A language
    that keeps no term has pairs at distance 0; an only source has no pair; an empty table gives no rows.
    """
    kept = written(kept_counts(docs, min_docs), "counts")
    groups = written(sizes(docs, kept), "groups")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_distances(kept, groups).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionAll(top_terms(kept, groups, top).withColumn("part", F.lit("term")).select(*columns))
