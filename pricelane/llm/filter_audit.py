"""Audit of how filters act together: what each removes in every order of application.

A document's failures are a mask with one bit per filter. Whether it survives a set of filters depends
on the mask alone, so the document becomes a word of 32 bits, one per subset of the five filters: bit S
is 1 if it fails none of S. Counting each bit over the words of a part gives the survivors of every
subset, and these give every number of the audit: a step of an order removes the survivors of the
letters before it less those of the letters up to it. So the work over documents does not grow with the
120 orders.

Bits are counted by carry-save adders over whole arrays of words: three words of one weight become one
of that weight and one of twice the weight, until two words of each weight are left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricelane.llm.words import SLICE
from pricelane.llm.work import written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
BLANK = re.compile("[\x20\x09-\x0D]")
MARKS = re.compile("[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: By mask of failures: the word of the subsets that a document survives.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if s & mask == 0) for mask in range(SUBSETS)], np.uint32)
#: Rows that a task holds before it counts them.
HELD = 1 << 18
KINDS = ("kept", "good", "toxic")


# -- failures --------------------------------------------------------------------------------------

def word_counts(text: str, size: int = SLICE) -> tuple[int, int]:
    """Words and distinct words of a text, read in pieces of about `size` characters."""
    at, n, seen = 0, 0, set()
    while at < len(text):
        cut = BLANK.search(text, min(len(text), at + size))
        end = cut.start() if cut else len(text)
        found = text[at:end].encode("utf-8", "surrogatepass").split()  # cuts at exactly the blanks above
        n += len(found)
        seen.update(found)
        at = end + 1
    return n, len(seen)


def own_failures(text: str, data: bytes) -> int:
    """The mask of failures that a text shows by itself: filters A to D."""
    n, distinct = word_counts(text)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return ((n < 50) | (100 * distinct < 65 * n) << 1 | (100 * capitals > 5 * len(text)) << 2
            | (MARKS.search(text) is not None) << 3)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (of the whole text) and mask (filters A to D), one row per row of `docs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                digests, masks = [], []
                for value in rows.column(2):
                    text = value.as_py() or ""
                    data = text.encode("utf-8", "surrogatepass")
                    digests.append(hashlib.blake2b(data, digest_size=16).digest())
                    masks.append(own_failures(text, data))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                    names=["doc_id", "part", "digest", "mask"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")),
                       F.col("text").cast("string")) \
        .mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), good, toxic: one row per row of `docs`.

    A document that is not the first of its text fails E. It looks for itself among the first ones, by
    text and doc_id, so a text that many share is spread over all tasks.
    """
    rows = written(failures(docs), "failures")
    named = rows.filter("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("first_id")) \
        .select(F.col("digest").alias("first_digest"), "first_id")
    flags = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")) \
        .filter("good OR toxic").withColumnRenamed("doc_id", "label_id")
    same = (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id"))
    met = named.join(first, same, "left").join(flags, F.col("doc_id") == F.col("label_id"), "left").select(
        "part", F.when(F.col("first_id").isNull(), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = rows.filter("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return met.unionAll(nameless)


# -- survivors -------------------------------------------------------------------------------------

def positional_counts(level: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit, by carry-save addition."""
    total, weight = np.zeros(32, np.int64), 1
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third:2 * third], level[2 * third:3 * third]
            half = a ^ b
            carries.append(a & b | half & c)
            level = np.concatenate([half ^ c, level[3 * third:]])
        for word in level.tolist():
            total += weight * (word >> np.arange(32) & 1)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return total


def _counted(parts: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """One row per part: its survivors of each subset among all, the good and the toxic documents."""
    code, row = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(code)) + 1, len(code)]
    word = WORDS[row & 31]
    counts = [[positional_counts(word[a:b][row[a:b] & flag > 0] if flag else word[a:b])
               for a, b in zip(cuts[:-1], cuts[1:])] for flag in (0, 32, 64)]
    return pa.RecordBatch.from_arrays(
        [pa.array([names[k] for k in code[cuts[:-1]]], pa.string()),
         *(pa.array([c.tolist() for c in kind], pa.list_(pa.int64())) for kind in counts)], names=["part", *KINDS])


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    held, n = [], 0
    for batch in batches:
        part = batch.column(0).dictionary_encode()
        own = np.array([known.setdefault(p, len(known)) for p in part.dictionary.to_pylist()], np.int64)
        flags = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
        held.append((own[np.asarray(part.indices)], np.asarray(batch.column(1)) + 32 * flags[0] + 64 * flags[1]))
        n += len(batch)
        if n >= HELD:
            yield _counted(held, list(known))
            known, held, n = {}, [], 0
    if n:
        yield _counted(held, list(known))


def survivors(rows: DataFrame) -> DataFrame:
    """part, kept, good, toxic: arrays of 32 counts, by subset of filters."""
    counted = rows.select("part", F.col("mask").cast("int"), "good", "toxic").mapInArrow(
        _survivors, "part string, kept array<long>, good array<long>, toxic array<long>")
    sums = {kind: F.array(*(F.sum(F.col(kind)[s]) for s in range(SUBSETS))) for kind in KINDS}
    return counted.groupBy("part").agg(*(c.alias(kind) for kind, c in sums.items()))


# -- audit -----------------------------------------------------------------------------------------

def _shapley(letter: int) -> Column:
    """What a filter removes, summed over all orders: as many orders as place the letters of a subset
    before it and the others after it, times what it removes from the survivors of that subset."""
    total = None
    for subset in range(SUBSETS):
        if not subset >> letter & 1:
            before = subset.bit_count()
            orders = factorial(before) * factorial(len(FILTERS) - 1 - before)
            term = orders * (F.col("kept")[subset] - F.col("kept")[subset | 1 << letter])
            total = term if total is None else total + term
    return total


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (value of `source`; null is the empty string), filter_order (all 120 orders of ABCDE) and
    step (1 to 5, its filter is that letter of the order), counts within the part: kept after the step,
    removed by it, redundant (fail its filter but were removed before), unique_fails (fail its filter
    only), good_lost and toxic_lost (removed here and labelled quality 1 or toxic 1), and shapley (what
    its filter removes, summed over all orders).

    `docs` (doc_id, text, source; other columns are ignored) fail A with fewer than 50 words; B if under
    65 % of the words are distinct; C if over 5 % of the characters are A-Z; D with one of #$%&*|; E if a
    document with a smaller doc_id has the same text. A null text is empty: it fails A alone, and E if it
    is not the first. Repeated rows of one doc_id are documents of their own, of which none is smaller
    than the other. Rows without a doc_id never fail E and have no labels. Several labels of a document
    count if one of them is 1. An empty table gives no rows.
    """
    counts = survivors(masks(docs, labels))
    every = (1 << len(FILTERS)) - 1
    letters = counts.select("part", *KINDS, F.array(*(_shapley(k) for k in range(len(FILTERS)))).alias("shares"))
    steps = letters.select("*", F.explode(F.lit(["".join(p) for p in permutations(FILTERS)])).alias("filter_order")) \
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda place: F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", place, 1)) - 65)
    places = F.sequence(F.lit(0), F.col("step") - 1)
    before = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i > 0, bit(i)).otherwise(0))
    own = bit(F.col("step"))
    known = steps.select("*", before.alias("before"), own.alias("own")) \
        .select("*", (F.col("before") + F.col("own")).alias("after"))
    lost = {kind: F.col(kind)[F.col("before")] - F.col(kind)[F.col("after")] for kind in KINDS}
    fails = F.col("kept")[0] - F.col("kept")[F.col("own")]
    return known.select(
        "part", "filter_order", "step", F.col("kept")[F.col("after")].alias("kept"), lost["kept"].alias("removed"),
        (fails - lost["kept"]).alias("redundant"),
        (F.col("kept")[every - F.col("own")] - F.col("kept")[every]).alias("unique_fails"),
        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"),
        F.element_at("shares", F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - 64).alias("shapley"))
