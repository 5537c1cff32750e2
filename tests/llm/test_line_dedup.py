import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import lowered, no_documents, odd_documents
from conftest import rows
from pyspark.sql import functions as F

from pricelane.llm import line_dedup


def key_of(line):
    return lowered(line.strip(" \t\n\x0b\f\r"))


def plain(docs, min_docs, keep="none", min_chars=1):
    """doc_id -> kept lines; docs have distinct ids."""
    holders, first = defaultdict(set), {}
    for i, text in sorted(docs):
        for pos, line in enumerate((text or "").split("\n")):
            holders[key_of(line)].add(i)
            first.setdefault(key_of(line), (i, pos))

    def stays(i, pos, line):
        key = key_of(line)
        if len(key) < min_chars:
            return True
        return first[key] == (i, pos) if keep == "first" else len(holders[key]) < min_docs
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if stays(i, p, x)) for i, t in docs}


def made(seed, n=120):
    r = np.random.default_rng(seed)
    common = [" Home ", "HOME", "\tAll rights reserved\r", "", "  ", "é", "É", "x"]
    return [(i, "\n".join(str(r.choice(common)) if r.random() < 0.5 else f"line {r.integers(0, 60)}"
                          for _ in range(r.integers(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("partitions", ["1", "5", "40"])
def test_against_plain(spark, keep, partitions):
    docs = made(1)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        maps = line_dedup.keep_bitmaps(table, 10, keep)
        found = rows(line_dedup.without_lines(table, maps))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = plain(docs, 10, keep)
    assert {r["doc_id"]: r["kept_text"] for r in found} == expected
    for r in found:
        assert r["n_lines"] == len(r["text"].split("\n"))
        assert (r["n_dropped"] == 0) <= (r["kept_text"] == r["text"])


def test_hot_line_in_every_partition(spark):
    docs = [(i, f"hot\nown {i}") for i in range(500)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    found = rows(line_dedup.without_lines(table, line_dedup.keep_bitmaps(table)))
    assert all(r["kept_text"] == f"own {r['doc_id']}" and r["n_dropped"] == 1 for r in found)


def test_threshold_and_repeats_in_one_document(spark):
    docs = [(i, "nine") for i in range(9)] + [(100 + i, "ten\nten") for i in range(10)] + [(200, "many\n" * 30)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(line_dedup.without_lines(table, line_dedup.keep_bitmaps(table)))}
    assert found[3]["kept_text"] == "nine" and found[104]["kept_text"] == "" and found[104]["n_dropped"] == 2
    assert found[200]["n_dropped"] == 0 and found[200]["n_lines"] == 31


def test_bitmap(spark):
    table = spark.createDataFrame([(1, "a\nb\nc"), (2, "b\nd")], "doc_id long, text string")
    maps = rows(line_dedup.keep_bitmaps(table, min_docs=2), "doc_id")
    bits = [np.unpackbits(np.frombuffer(zlib.decompress(m["bitmap"]), np.uint8))[:m["n_lines"]].tolist() for m in maps]
    assert bits == [[1, 0, 1], [0, 1]]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs, min_docs=2))
    assert found.count() == docs.count()
    kept = {(r["doc_id"], r["_kept_text"]) for r in rows(found)}
    assert {(1, ""), (2, ""), (None, ""), (3, ""), (4, ""), (9, "\n\n\nshort\n")} <= kept
    assert line_dedup.keep_bitmaps(no_documents(spark)).count() == 0
    empty = no_documents(spark)
    assert line_dedup.without_lines(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def same_hash():
    """Two lines of 16 letters and digits with the same xxhash64 at Spark's seed."""
    p1, p2, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    part = lambda k: turn(k * p2, 31) * p1
    undo = lambda p: np.uint64(pow(int(p), -1, 1 << 64))
    random, letters = np.random.default_rng(0), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    heads = [np.frombuffer(h, "<u8") for h in (b"one line", b"two line")]
    states = [turn((np.full(1, 42 + 16, np.uint64) + p5) ^ part(h), 27) * p1 + p4 for h in heads]
    while True:
        tails = random.choice(letters, (1 << 20, 8)).view("<u8").ravel()
        others = turn((part(tails) ^ states[0] ^ states[1]) * undo(p1), 33) * undo(p2)
        fit = np.flatnonzero(np.isin(others.view(np.uint8).reshape(-1, 8), letters).all(1))
        if len(fit):
            return "one line" + tails[fit[:1]].tobytes().decode(), "two line" + others[fit[:1]].tobytes().decode()


def test_lines_with_one_hash_alike_are_two_keys(spark):
    pair = same_hash()
    docs = spark.createDataFrame([(i, pair[i % 2]) for i in range(12)], "doc_id long, text string")
    found = rows(line_dedup.lines(docs))
    assert len({r["h1"] for r in found}) == 1 and len({r["h2"] for r in found}) == 2
    assert line_dedup.keep_bitmaps(docs, min_docs=10).count() == 0
    assert line_dedup.keep_bitmaps(docs, min_docs=6).count() == 12
