"""Line dedup by range-partitioned hashes and streamed runs.

Every line becomes a row of its key's 128-bit hash, its document and its position, without the text.
The rows are range-partitioned by (hash, document) and sorted by (hash, document, position), so a key
is one run, and a run of any length is streamed: a key that a third of all lines share extends over
many partitions, each of which reads its part. What a partition cannot know - whether its first and
last runs go on elsewhere - is settled by one row of counts per such run. The result is one compressed
bitmap of kept lines per document that loses any.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pricelane.llm.text import BLANKS, ascii_lower, free_name
from pricelane.llm.work import written

KEY, DOC = ["h1", "h2"], ["doc_id", "text_hash"]
STREAMED = "kind int, part int, h1 long, h2 long, doc_id long, text_hash long, pos int, n_lines int, n long"
DROP, OPEN, COUNT = 0, 1, 2


def lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """h1, h2, doc_id, text_hash, pos, n_lines of every line whose key has `min_chars` code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                      F.split(text, "\n", -1).alias("cut"))
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    return cut.select("doc_id", "text_hash", F.size("cut").alias("n_lines"),
                      F.posexplode("cut").alias("pos", "line")) \
        .select("*", key.alias("key")).filter(F.length("key") >= min_chars) \
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),  # seeded by 1, not by h1
                "doc_id", "text_hash", "pos", "n_lines")


def streaming(min_docs: int, keep: str):
    """Reads one sorted partition run by run. Holds the rows of less than `min_docs` documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows(kind, table, n=0):
            size = len(table["h1"])
            full = lambda v: pa.array(np.full(size, v))
            return pa.RecordBatch.from_arrays(
                [full(np.int32(kind)), full(np.int32(part)), *(table[c] for c in (*KEY, *DOC, "pos", "n_lines")),
                 full(np.int64(n))], names=[f.split()[0] for f in STREAMED.split(", ")])

        key, first_run, doc, docs, held = None, True, None, 0, []

        def end(last: bool):
            """What the run that ends here leaves."""
            if key is None:
                return
            if first_run or last:  # it may go on in another partition
                yield from (rows(OPEN, t) for t in held)
                yield rows(COUNT, head, docs)
            held.clear()

        head = None
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            ids = [pc.fill_null(batch["doc_id"], 0), pc.is_null(batch["doc_id"]),
                   batch["text_hash"]]
            ids = [np.asarray(x.to_numpy(zero_copy_only=False)) for x in ids]
            h = [np.asarray(batch[c]) for c in KEY]
            new_key = np.r_[True, (h[0][1:] != h[0][:-1]) | (h[1][1:] != h[1][:-1])]
            new_doc = new_key | np.r_[True, np.any([x[1:] != x[:-1] for x in ids], axis=0)]
            starts = np.flatnonzero(new_key)
            docs_before = np.r_[0, np.cumsum(new_doc)]
            for a, b in zip(starts, np.r_[starts[1:], size]):
                now = (h[0][a], h[1][a])
                this_doc = tuple(x[a] for x in ids)
                if now != key:
                    yield from end(False)
                    first_run = key is None
                    key, doc, docs, head = now, None, 0, batch.slice(a, 1)
                old = docs
                docs += int(docs_before[b] - docs_before[a]) - (this_doc == doc)
                doc = tuple(x[b - 1] for x in ids)
                table = batch.slice(a, b - a)
                if keep == "first":
                    if old == 0:  # the run's first line: an earlier partition may have one
                        if first_run:
                            held.append(table.slice(0, 1))
                        table = table.slice(1)
                    if len(table):
                        yield rows(DROP, table)
                elif docs >= min_docs:
                    yield from (rows(DROP, t) for t in [*held, table])
                    held.clear()
                elif first_run or b == size or docs_before[b] - docs_before[a] > 0:
                    held.append(table)
        yield from end(True)
    return run


def dropped_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1) -> DataFrame:
    """doc_id, text_hash, pos, n_lines of the lines that go.

    keep "none": keys found in at least `min_docs` documents lose all their lines. keep "first": every
    line but the first of its key goes, by document id and position.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = written(lines(docs, min_chars), "lines")  # read twice: for the ranges, and to sort
    ordered = table.repartitionByRange(parts, *KEY, *DOC).sortWithinPartitions(*KEY, *DOC, "pos")
    streamed = written(ordered.mapInArrow(streaming(min_docs, keep), STREAMED), "runs")
    # two rows a partition at most
    ends = streamed.filter(F.col("kind") == COUNT).groupBy(*KEY) \
        .agg(F.sum("n").alias("docs"), F.min("part").alias("first_part"))
    settled = streamed.filter(F.col("kind") == OPEN).join(F.broadcast(ends), KEY)
    goes = F.col("part") > F.col("first_part") if keep == "first" else F.col("docs") >= min_docs
    columns = [*DOC, "pos", "n_lines"]
    return streamed.filter(F.col("kind") == DROP).select(*columns) \
        .unionByName(settled.filter(goes).select(*columns))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, bitmap of every document that loses lines. The bitmap is
    zlib-compressed, one bit per line, the first line in the highest bit, 1 for kept.

    `docs` needs doc_id and text; other columns are ignored. A null or empty text is one empty line.
    Rows that agree in doc_id and text are one document, a null doc_id is an id like others. An empty
    table gives no rows.
    """
    found = dropped_lines(docs, min_docs, keep, min_chars).groupBy(*DOC) \
        .agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))  # one document's lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, gone = [], batch["gone"].to_pylist()
            for n, places in zip(batch["n_lines"].to_pylist(), gone):
                bits = np.ones(n, np.uint8)
                bits[places] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in (*DOC, "n_lines")), pa.array([len(x) for x in gone], pa.int64()),
                 pa.array(maps, pa.binary())], names=[*DOC, "n_lines", "n_dropped", "bitmap"])

    return found.mapInArrow(run, "doc_id long, text_hash long, n_lines int, n_dropped long, bitmap binary")


def _kept(texts: pd.Series, maps: pd.Series) -> pd.Series:
    def one(text, bitmap):
        if bitmap is None:
            return None
        cut = text.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(cut))
        return "\n".join(line for line, bit in zip(cut, bits) if bit)
    return pd.Series([one(t, m) for t, m in zip(texts, maps)], dtype=object)


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of `docs` and kept_text, n_lines, n_dropped (with underscores before their names if
    `docs` has them): the other lines joined by \\n."""
    names = {c: free_name(docs, c) for c in ("kept_text", "n_lines", "n_dropped")}
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [free_name(docs, f"map_{c}") for c in ("id", "hash", "lines", "dropped", "bits")]
    map_id, map_hash, map_lines, map_dropped, map_bits = (F.col(c) for c in own)
    ids = F.col("doc_id").cast("long").eqNullSafe(map_id)
    met = docs.join(bitmaps.toDF(*own), ids & (F.xxhash64(text) == map_hash), "left")
    changed: Column = map_bits.isNotNull()
    kept = F.pandas_udf(_kept, "string")(F.when(changed, text), map_bits)  # only changed texts go to Python
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return met.withColumns({
        names["kept_text"]: F.coalesce(kept, text),
        names["n_lines"]: F.coalesce(map_lines, breaks).cast("long"),
        names["n_dropped"]: F.coalesce(map_dropped, F.lit(0)).cast("long"),
    }).drop(*own)
