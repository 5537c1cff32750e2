"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: a slot holds a bitmask with one bit per language, so
the AND of an n-gram's slots tells at once all languages whose filter contains it. A text's hits per
language are popcounts over its n-grams, corrected for the false positives that the fill of each filter
makes likely; the language with the most corrected hits is the answer.

N-grams are runs of letters, lower-cased, with the word boundary as a letter. A language's filter takes
those n-grams that a bounded sample of its documents shows at least `min_count` times, and not far more
rarely than another language does.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pricelane.llm.text import free_name
from pricelane.llm.work import written

UNKNOWN = "und"
ORDERS = (3, 4)
SLOTS_LOG2, PROBES = 20, 2
SEGMENT = 1 << 20
#: A text is accepted if its language knows this share of its n-grams, and so many standard deviations more
#: of them than false hits make likely. Texts of a language that was learned have shares above a half,
#: random letters and other languages mostly below a fifth.
LEAST, DEVIATIONS = 0.25, 3.0
FACTORS = np.random.default_rng(9).integers(1, 2 ** 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_letters: list[np.ndarray] = []


class Filters(NamedTuple):
    languages: list[str]
    slots: np.ndarray  # [word of 64 languages, slot]
    false_rate: np.ndarray  # by language


def letters() -> np.ndarray:
    """By code point: its lower-case letter's code point, or 0 for what is no letter."""
    if not _letters:
        lower = lambda c: ord(c.lower()[0]) if c.isalpha() else 0
        _letters.append(np.array([lower(chr(i)) for i in range(sys.maxunicode + 1)], np.uint32))
    return _letters[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def segments(text: str) -> Iterator[str]:
    """A long text in parts, cut where no letter is, as n-grams end there anyhow; a run of letters
    beyond a part's size is cut inside."""
    while len(text) > SEGMENT:
        cut = next((i for i in range(SEGMENT, SEGMENT // 2, -1) if not text[i].isalpha()), SEGMENT)
        yield text[:cut]
        text = text[cut:]
    yield text


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, bounds of the texts) of all n-grams, for each order."""
    code = np.frombuffer("".join(f" {t}" for t in texts).encode("utf-32-le", "surrogatepass") + bytes(4),
                         np.uint32)
    letter = letters()[code]
    keep = (letter > 0) | (np.r_[np.uint32(1), letter[:-1]] > 0)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    ends = np.cumsum(keep)[ends - 1]  # of the texts among the letters that are kept
    letter = letter[keep].astype(np.uint64)
    for order in ORDERS:
        count = max(0, len(letter) - order + 1)
        value = np.zeros(count, np.uint64)
        whole = np.ones(count, bool)
        for i in range(order):
            part = letter[i:i + count]
            value += part * FACTORS[i]
            if 0 < i < order - 1:
                whole &= part > 0
        # the boundary before a text's first word may stand in the text before
        bounds = np.r_[0, np.cumsum(whole)][np.clip(np.r_[0, ends] - 1, 0, count)]
        value = value[whole]
        value ^= value >> np.uint64(31)
        value *= FACTORS[7]
        value ^= value >> np.uint64(29)
        yield value, bounds


def probes(value: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield ((value >> np.uint64(SLOTS_LOG2 * i)) & np.uint64((1 << SLOTS_LOG2) - 1)).astype(np.int64)


def train(docs: DataFrame, learn: Column, rows_per_language: int = 1500, min_count: int = 2,
          rare: float = 0.05) -> Filters:
    """Filters from the rows of `docs` (doc_id, text, lang) for which `learn` holds and lang and text
    are not null.

    rows_per_language: so many documents of each language, chosen by a hash of their ids, are read
    (an expected number; all of a language with fewer). rare: an n-gram enters a language's filter if
    its share there is at least this part of its largest share in any language.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()) \
        .select("doc_id", "text", "lang")
    counts = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())
    languages = [lang for lang, _ in counts]
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return Filters([], np.zeros((1, 1 << SLOTS_LOG2), np.uint64), np.zeros(0))
    spark = docs.sparkSession
    share = F.broadcast(spark.createDataFrame(  # one row per language
        [(lang, i, min(1.0, rows_per_language / n)) for i, (lang, n) in enumerate(counts)],
        "lang string, number int, part double"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003
    sample = rows.join(share, "lang").filter(chance < F.col("part")).select("number", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                owner = np.asarray(batch.column(0)[at:at + 200])
                texts = batch.column(1)[at:at + 200].to_pylist()
                cut = [(n, s) for n, t in zip(owner, texts) for s in segments(t)]
                for value, bounds in grams([s for _, s in cut]):
                    number = np.repeat(np.array([n for n, _ in cut]), np.diff(bounds))
                    order = np.lexsort((value, number))
                    value, number = value[bounds[0]:bounds[-1]][order], number[order]
                    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (number[1:] != number[:-1])]) \
                        if len(value) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number[first].astype(np.int32)), pa.array(value[first].view(np.int64)),
                         pa.array(np.diff(np.r_[first, len(value)]))], names=["number", "gram", "n"])

    found = sample.mapInArrow(run, "number int, gram long, n long") \
        .groupBy("number", "gram").agg(F.sum("n").alias("n"))
    found = written(found, "grams")
    total = F.broadcast(found.groupBy("number").agg(F.sum("n").alias("total")))  # one row per language
    rate = F.col("n") / F.col("total")
    kept = found.join(total, "number").withColumn("rate", rate) \
        .withColumn("most", F.max("rate").over(Window.partitionBy("gram"))) \
        .filter((F.col("n") >= min_count) & (F.col("rate") >= rare * F.col("most")))
    low = F.lit((1 << SLOTS_LOG2) - 1)
    spots = F.array(*(F.shiftrightunsigned("gram", SLOTS_LOG2 * i).bitwiseAND(low) for i in range(PROBES)))
    bit = F.expr("shiftleft(1L, number % 64)")
    rows = kept.select(F.floor(F.col("number") / 64).alias("word"), bit.alias("bit"), F.explode(spots).alias("slot")) \
        .groupBy("word", "slot").agg(F.bit_or("bit").alias("mask"))
    slots = np.zeros((words, 1 << SLOTS_LOG2), np.uint64)
    for batch in rows.toArrow().to_batches():  # one row per slot and word at most
        slots[np.asarray(batch["word"]), np.asarray(batch["slot"])] = np.asarray(batch["mask"]).view(np.uint64)
    fill = np.array([((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filters(languages, slots, fill ** PROBES)


def hits(texts: list[str], filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Corrected hits by text and language, and the number of n-grams by text."""
    count = np.zeros((len(texts), len(filters.languages)))
    n = np.zeros(len(texts))
    for value, bounds in grams(texts):
        n += np.diff(bounds)
        spots = list(probes(value))
        for word, slots in enumerate(filters.slots):
            mask = slots[spots[0]]
            for spot in spots[1:]:
                mask &= slots[spot]
            for i in range(64 * word, min(64 * word + 64, len(filters.languages))):
                ones = np.r_[0, np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)]
                count[:, i] += np.diff(ones[bounds])
    return np.maximum(0, count - n[:, None] * filters.false_rate) / (1 - filters.false_rate), n


def summed_hits(texts: list[str | None], filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """What hits() gives for texts of any length."""
    cut = [(i, s) for i, t in enumerate(texts) for s in segments(t or "")]
    sums, grams_of = np.zeros((len(texts), len(filters.languages))), np.zeros(len(texts))
    at = 0
    while at < len(cut):
        to, size = at, 0
        while to < len(cut) and (to == at or size + len(cut[to][1]) < SEGMENT):
            size += len(cut[to][1])
            to += 1
        found, n = hits([s for _, s in cut[at:to]], filters)
        owner = [i for i, _ in cut[at:to]]
        np.add.at(sums, owner, found)
        np.add.at(grams_of, owner, n)
        at = to
    return sums, grams_of


def predict(texts: list[str | None], filters: Filters) -> tuple[list[str], np.ndarray]:
    """The language of each text and the winner's share of all corrected hits."""
    sums, _ = summed_hits(texts, filters)
    if not filters.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total = sums.sum(1)
    score = np.where(total > 0, sums.max(1) / np.maximum(total, 1e-300), 0.0)
    known = [has_letter(t) for t in texts]
    best = sums.argmax(1)
    return [filters.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def identified(docs: DataFrame, filters: Filters) -> DataFrame:
    """All columns of `docs` (with text) and lang_pred, score; both get underscores before their names
    if `docs` has them. lang_pred is a learned language, or `und` for a text that is null or has no
    letter. If no n-gram of a text is known, the first language gets it with score 0."""
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                lang, sure = predict(part.column(at).to_pylist(), filters)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(sure)],
                    names=[*part.schema.names, pred, score])

    schema = docs.withColumns({pred: F.lit(""), score: F.lit(0.0)}).schema
    return docs.mapInArrow(run, schema)


def recognised(texts: list[str | None], filters: Filters, least: float = LEAST,
               deviations: float = DEVIATIONS) -> np.ndarray:
    """Whether a language knows at least the share `least` of a text's n-grams, beyond its expected false
    hits, and more than chance gives: its hits exceed these by `deviations` standard deviations."""
    if not filters.languages:
        return np.zeros(len(texts), bool)
    sums, n = summed_hits(texts, filters)
    best = sums.argmax(1)
    false, most = filters.false_rate[best], sums.max(1)
    beyond = most * (1 - false)
    return (most > 0) & (most >= least * n) & (beyond >= deviations * np.sqrt(n * false * (1 - false)))


def accepted(docs: DataFrame, filters: Filters, least: float = LEAST, deviations: float = DEVIATIONS) -> DataFrame:
    """The rows of `docs` whose text has a letter and is recognised() as some language."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                yield part.filter(pa.array(recognised(part.column(at).to_pylist(), filters, least, deviations)))

    return docs.mapInArrow(run, docs.schema)


def held_out(every: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == rest, F.lit(False))


def learnable() -> Column:
    """Documents that are not held out; one without a doc_id is neither."""
    return ~held_out() & F.col("doc_id").isNotNull()
