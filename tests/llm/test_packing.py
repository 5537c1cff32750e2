import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import no_documents, odd_documents
from conftest import SMALL, rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelane.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = Tokenizer.from_file(PATH)


def plain_ids(text):
    return [*ENCODER.encode(text or "", add_special_tokens=False).ids, 1]


def plain_pieces(docs, limit):
    found = []
    for i, text in docs:
        ids = plain_ids(text)
        for piece in range(-(-len(ids) // limit)):
            part = ids[piece * limit:(piece + 1) * limit]
            found.append((i, piece, piece * limit, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(found, key=str)


def well_packed(found, limit):
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by_sequence)


def test_ids_and_places(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for limit in (4096, 300):
        found = rows(packing.packed_documents(docs, PATH, limit))
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        expected = plain_pieces([(r.doc_id, r.text) for r in docs.collect()], limit)
        assert sorted((tuple(r[n] for n in names) for r in found), key=str) == expected
        used = well_packed(found, limit)
        assert used <= 1.002 * -(-sum(r["length"] for r in found) // limit) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.sampled_from(
    ["it's we'll  9 99", "é ́", "a b\x1cc\x0bd", "ẞİİ", "\U0001f600\U0001f600 x", "ΣΑΣ σας"]))))
def test_word_by_word_ids(texts):
    import pyarrow as pa
    ids, ends = packing.WordTokenizer(PATH)(pa.array([t or "" for t in texts], pa.string()), 1)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [plain_ids(t) for t in texts]


def test_forgetting_words(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    encode = packing.WordTokenizer(PATH)
    for n in range(4):
        text = " ".join(f"word{i}" for i in range(n, n + 4))
        assert encode(pa.array([text]), 1)[0].tolist() == plain_ids(text)
        assert len(encode.words.known) <= 5


def test_streams_and_cells(spark):
    r = random.Random(1)
    table = spark.createDataFrame([(i, 0, 0, r.choice([3, 7, 50, 99, 100]), i) for i in range(2000)], packing.PIECES)
    found = rows(packing.pack(table, 100, open_bins=20, stream_bins=100))
    assert len({x["sequence_id"] >> 32 for x in found}) > 5 and len(found) == 2000
    assert well_packed(found, 100) <= 1.1 * sum(x["length"] for x in found) / 100


def plain_best_fit(lengths, limit, most):
    """(sequence, offset) of each length by a search through all open bins, of which the latest among equals."""
    open_, found, opened = [], [], 0  # [free, number], in the order in which they got their free space
    for length in lengths:
        fits = [b for b in open_ if b[0] >= length]
        if fits:
            least = min(b[0] for b in fits)
            best = [b for b in fits if b[0] == least][-1]
            open_.remove(best)
        else:
            if len(open_) >= most:
                least = min(b[0] for b in open_)
                open_.remove([b for b in open_ if b[0] == least][-1])
            best, opened = [limit, opened], opened + 1
        found.append((best[1], limit - best[0]))
        if best[0] > length:
            open_.append([best[0] - length, best[1]])
    return found


def test_streams_against_a_plain_best_fit(spark):
    r = random.Random(5)
    made = [(i, 0, 0, r.choice([r.randrange(1, 101), 100, 3]), i) for i in range(1500)]
    table = spark.createDataFrame(made, packing.PIECES).repartition(4)
    found = rows(packing.pack(table, 100, open_bins=6, stream_bins=200))
    tie = {x["doc_id"]: x["tie"] for x in rows(table.select("doc_id", F.xxhash64("doc_id", "piece", "ids_crc32").alias("tie")))}
    streams = {}
    for x in found:
        streams.setdefault(x["sequence_id"] >> 32, []).append(x)
    assert len(streams) > 2
    for own in streams.values():
        own.sort(key=lambda x: (-x["length"], tie[x["doc_id"]]))
        assert [(x["sequence_id"] & 0xFFFFFFFF, x["offset"]) for x in own] == plain_best_fit([x["length"] for x in own], 100, 6)


def test_best_fit_and_the_fullest_closes():
    bins = packing.OpenBins(10, 2)
    assert bins.put(6) == (0, 0) and bins.put(7) == (1, 0)
    assert bins.put(3) == (1, 7)  # 3 left fits better than 4
    assert bins.put(5) == (2, 0)  # bin 1 is full, bins 0 and 2 are open
    assert bins.put(8) == (3, 0)  # bin 0 has the least space and closes
    assert bins.put(4) == (2, 5)
    assert bins.open == 2 and bins.put(10) == (4, 0) and bins.open == 1


def test_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    parts = {}
    for r in rows(packing.sequences(docs, PATH, 512)):
        assert len(r["ids"]) <= 512
        for d in r["documents"]:
            parts[(d["doc_id"], d["piece"])] = r["ids"][d["offset"]:d["offset"] + d["length"]]
    for r in docs.collect():
        mine = [parts[k] for k in sorted(k for k in parts if k[0] == r.doc_id)]
        assert sum(mine, []) == plain_ids(r.text)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = rows(packing.packed_documents(docs, PATH))
    assert sorted((tuple(r[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found), key=str) \
        == plain_pieces([(r.doc_id, r.text) for r in docs.collect()], 4096)
    well_packed(found, 4096)
    assert packing.packed_documents(no_documents(spark), PATH).count() == 0
