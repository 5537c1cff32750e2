"""Near duplicates by SimHash, found by covering fingerprints with anchor points.

A document's fingerprint has the bits that are set in over half of the 64-bit hashes of its three-word
shingles, repeats included. Documents are linked if their fingerprints differ in at most THRESHOLD bits.

Anchors are the words of a covering code: bits 0-22 and bits 23-45 of an anchor are words of the binary
Golay code, which covers all 23-bit words within radius 3; the other bits are free, so every fingerprint
has an anchor. The code is perfect, so the nearest anchor, a fingerprint's home, is unique. A partner
within THRESHOLD bits lies within the covering radius plus THRESHOLD of that home, where THRESHOLD is
spent on both halves together: a half that is `d` bits away from an anchor costs max(0, d - 3). So

1. equal fingerprints become one row (copies go no further);
2. a fingerprint sits at its home and visits every other anchor within the covering radius plus
   THRESHOLD. Of two homes that see a pair one suffices: only anchors above the own home are visited;
3. per anchor, those at home are compared with each other and with the visitors. An anchor with more
   than BLOCK rows is cut into blocks that meet in cells, so no task gets more than two blocks at once.
   A cell gives links that connect what is connected, never all pairs;
4. links make components, of which the smallest doc_id stands for all.

Fingerprints are distinct where they meet: a link lost or found depends on the fingerprints alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pricelane.config import PricingConfig
from pricelane.functions.hot import join_split
from pricelane.llm import cells, words
from pricelane.llm.components import components
from pricelane.llm.work import written

SHINGLE, SEED, THRESHOLD = 3, 42, 2
BLANK = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 2048

#: Fixed values of the Golay code: length, check bits, covering radius, generator polynomial.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b110001110101
HALF = (1 << LENGTH) - 1


# -- fingerprints ----------------------------------------------------------------------------------

def shingle_hashes(text: bytes, size: int = words.SLICE) -> Iterator[list[int]]:
    """The hashes of all shingles of a lower-cased text, in pieces of about `size` bytes."""
    held: list[bytes] = []
    at = n = 0
    while at < len(text):
        cut = BLANK.search(text, min(len(text), at + size))
        end = cut.start() if cut else len(text)
        found = text[at:end].split()  # cuts at exactly the blanks above
        n += len(found)
        part = held + found
        if len(part) >= SHINGLE:
            yield joined_hashes(part)
            held = part[1 - SHINGLE:]
        else:
            held = part
        at = end + 1
    if 0 < n < SHINGLE:
        yield [xxhash.xxh64_intdigest(b" ".join(held), SEED)]


def joined_hashes(part: list[bytes]) -> list[int]:
    line = b" ".join(part)
    ends = np.cumsum([len(w) + 1 for w in part]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist())]


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each range of `hashes` the 64-bit word of the bits that over half of them have."""
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    found = np.zeros(len(n), np.uint64)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[:-1][full], axis=0, dtype=np.int64)
        won = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little")
        found[full] = np.ascontiguousarray(won).view("<u8").ravel()
    return found


def fingerprint_of(text: bytes) -> int:
    """The fingerprint of one long lower-cased text, counted piece by piece."""
    ones, n = np.zeros(64, np.int64), 0
    for part in shingle_hashes(text):
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit number, one row per row of `docs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in words.slices(batch.column(1)):
                if len(texts) == 1:
                    found = np.array([fingerprint_of(texts[0])], np.uint64)
                else:
                    hashes = [[h for part in shingle_hashes(t) for h in part] for t in texts]
                    bounds = np.cumsum([0, *(len(h) for h in hashes)])
                    found = majority(np.array([h for part in hashes for h in part], np.uint64), bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")) \
        .mapInArrow(run, "doc_id long, fp long")


# -- anchors ---------------------------------------------------------------------------------------

def syndromes(values: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words divided by the generator: equal for words that differ by a code word."""
    rest = values.astype(np.uint32)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = rest ^ (np.uint32(GENERATOR << (bit - CHECKS)) * ((rest >> np.uint32(bit)) & np.uint32(1)))
    return rest


def _patterns() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By cost 0 to THRESHOLD: (first, count, patterns), the error patterns of that cost of each syndrome."""
    weights = {cost: [RADIUS + cost] if cost else range(RADIUS + 1) for cost in range(THRESHOLD + 1)}
    found = []
    for cost in range(THRESHOLD + 1):
        made = np.array([sum(1 << b for b in bits) for weight in weights[cost]
                         for bits in combinations(range(LENGTH), weight)], np.uint32)
        of = syndromes(made)
        order = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=1 << CHECKS)
        found.append((np.cumsum(count) - count, count, made[order].astype(np.uint64)))
    return found


PATTERNS = _patterns()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, at home) of each seat that fingerprints take: their homes and all anchors above
    within the covering radius plus THRESHOLD."""
    halves = [fps & np.uint64(HALF), (fps >> np.uint64(LENGTH)) & np.uint64(HALF)]
    of = [syndromes(h) for h in halves]
    everyone = np.arange(len(fps))
    home = None
    seats, owner, own = [], [], []
    for low in range(THRESHOLD + 1):
        for high in range(THRESHOLD + 1 - low):
            (first0, count0, bits0), (first1, count1, bits1) = PATTERNS[low], PATTERNS[high]
            n0, n1 = count0[of[0]], count1[of[1]]
            n = n0 * n1
            row = np.repeat(everyone, n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            one = halves[0][row] ^ bits0[first0[of[0][row]] + place // n1[row]]
            two = halves[1][row] ^ bits1[first1[of[1][row]] + place % n1[row]]
            anchor = (one | two << np.uint64(LENGTH)).astype(np.int64)
            if home is None:  # cost 0 in both halves: one pattern each
                home = anchor
                seats, owner, own = [anchor], [row], [np.ones(len(row), bool)]
                continue
            above = anchor > home[row]
            seats.append(anchor[above])
            owner.append(row[above])
            own.append(np.zeros(int(above.sum()), bool))
    return np.concatenate(seats), np.concatenate(owner), np.concatenate(own)


def _seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2048):
            fps = np.asarray(batch.column(0).slice(at, 2048))
            anchor, row, home = anchors(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row]), pa.array(home)],
                                             names=["anchor", "fp", "home"])


def dealt(seats: DataFrame) -> DataFrame:
    """anchor, i, j, fp, home: the cells in which the seats (anchor, fp, home) of each anchor meet. Anchors
    of up to BLOCK rows are one cell. Else rows at home have blocks of their own, from 0 on, and visitors
    the blocks after these; a block at home meets itself and every later one. Neither side is broadcast: Spark
    takes seats to be no more than the fingerprints that they are made of."""
    sizes = seats.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")) \
        .filter("n > 1 AND homes > 0")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    large = F.col("n") > BLOCK
    own = F.when(large, blocks(F.col("homes"))).otherwise(1)
    all_ = F.when(large, F.col("own") + blocks(F.col("n") - F.col("homes"))).otherwise(1)
    lot = F.xxhash64("fp")
    rows = seats.hint("merge").join(sizes, "anchor").withColumn("own", own).withColumn("all", all_)
    rows = rows.withColumn("block", F.when(~large, 0).when(F.col("home"), F.pmod(lot, F.col("own")))
                           .otherwise(F.col("own") + F.pmod(lot, F.col("all") - F.col("own"))).cast("int"))
    met = F.sequence(F.lit(0), F.when(large & F.col("home"), F.col("all")).otherwise(F.col("own")) - 1)
    return rows.withColumn("other", F.explode(met)).select(
        "anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "home", "block")


def spanning(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows, one of `left` and one of `right`, that connect all that are linked among these."""
    group = np.arange(len(fps))
    found = []
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        near = np.bitwise_count(fps[rows][:, None] ^ fps[right]) <= THRESHOLD
        for i, line in zip(rows.tolist(), near):
            other = right[line]
            other = other[group[other] != group[i]]
            if len(other):
                old, first = np.unique(group[other], return_index=True)
                found += [(i, int(k)) for k in other[first]]
                group[np.isin(group, old)] = group[i]
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell in cells.groups(batches, 3):
        if len(cell) < 2:
            continue
        i, j = cell.column(1)[0].as_py(), cell.column(2)[0].as_py()
        fps = np.asarray(cell.column(3))
        home = cell.column(4).to_numpy(zero_copy_only=False)
        block = np.asarray(cell.column(5))
        left = np.flatnonzero(home & (block == i))
        right = np.flatnonzero(block == j)
        pairs = spanning(fps.view(np.uint64), left, right)
        if pairs:
            a, b = (fps[list(side)] for side in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
                                             names=["low", "high"])


def linked(fps: DataFrame) -> DataFrame:
    """low, high: links that connect the distinct fingerprints `fps` (fp) as all links would."""
    seats = fps.select("fp").mapInArrow(_seats, "anchor long, fp long, home boolean")
    met = dealt(seats).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return met.mapInArrow(_links, "low long, high long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, fingerprint (16
    lower-case hex digits), component_id (smallest doc_id reachable by links, itself included).

    Words are what stands between blanks, A-Z lower-cased. A text of one or two words is one shingle; a
    null, empty or blank text has fingerprint zero and is linked like any other. Repeated rows and rows
    that share a doc_id are linked by their own texts. Rows without a doc_id take part; component_id is
    null only if no row of the component has one. An empty table gives no rows.
    """
    rows = written(fingerprints(docs), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    links = written(linked(classes), "links")
    named = classes.select("fp", "id", F.col("fp").alias("root"))
    if not links.isEmpty():
        roots = components(links.distinct()).select(F.col("id").alias("member"), F.col("root").alias("top"))
        named = classes.join(roots.hint("merge"), F.col("fp") == F.col("member"), "left") \
            .select("fp", "id", F.coalesce("top", "fp").alias("root"))
    named = written(named, "named")
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    split = PricingConfig(hot_rows=1000)  # a fingerprint with many rows is spread over slices
    found = join_split(named, lowest, ["root"], F.col("fp"), split).select("fp", "component_id")
    return join_split(rows, found, ["fp"], F.monotonically_increasing_id(), split) \
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
