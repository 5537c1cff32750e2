import random

import numpy as np
import pyarrow as pa
import xxhash
from cases import ODD, lowered, no_documents, odd_documents
from conftest import rows
from pyspark.sql import functions as F

from pricelane.llm import cells, simhash


def plain_fingerprint(text):
    words = lowered(text).encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(docs):
    """Row by row: (doc_id, fingerprint, component_id), by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(docs):
        ids = [d for d in (low.get(find(i)), doc) if d is not None]
        low[find(i)] = min(ids, default=None)
    return sorted(((doc, f"{fps[i]:016x}", low[find(i)]) for i, (doc, _) in enumerate(docs)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(df)), key=str)


def check(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = result(simhash.near_duplicates(table))
    assert found == plain(docs)
    return found


def edited(seed, groups, size):
    r, docs = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(2, 300))]
        for _ in range(size):
            words = list(base)
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = f"new{r.randrange(10 ** 9)}"
            docs.append(" ".join(words))
    return [(3 * i + 1, d) for i, d in enumerate(docs)]


def test_against_all_pairs(spark):
    found = check(spark, edited(1, 25, 8))
    assert len({c for _, _, c in found}) < len({f for _, f, _ in found})  # different fingerprints are linked


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = result(simhash.near_duplicates(docs))
    assert found == plain(ODD)
    assert {f for d, f, _ in found if d in (3, 4, 5)} == {"0" * 16}
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_rows_without_ids_and_repeated_ids(spark):
    check(spark, [(None, "alone here now"), (None, "with another one"), (4, "with another one"), (4, "something else again"),
                  (2, "something else again"), (2, "something else again"), (7, None)])


def test_long_texts_in_pieces():
    text = " ".join(f"w{i % 997}" for i in range(3000)).encode()
    whole = [h for part in simhash.shingle_hashes(text) for h in part]
    for size in (1, 7, 100, 10 ** 6):
        assert [h for part in simhash.shingle_hashes(text, size) for h in part] == whole
    assert simhash.fingerprint_of(text) == plain_fingerprint(text.decode())
    assert [list(simhash.shingle_hashes(t)) for t in (b"", b" \n ")] == [[], []]


# -- anchors ---------------------------------------------------------------------------------------

def near(r, count, flips):
    """Random fingerprints with neighbours up to `flips` bits away, all distinct."""
    base = [r.getrandbits(64) for _ in range(count)]
    more = []
    for fp in base:
        for _ in range(3):
            other = fp
            for bit in r.sample(range(64), r.randrange(1, flips + 1)):
                other ^= 1 << bit
            more.append(other)
    return np.array(sorted({*base, *more}), np.uint64)


def test_the_code_is_perfect():
    weights = {cost: p for cost, p in enumerate(simhash.PATTERNS)}
    assert (weights[0][1] == 1).all()  # one nearest anchor within radius 3 for every syndrome
    assert sum(len(p) for _, _, p in simhash.PATTERNS) == sum([1, 23, 253, 1771, 8855, 33649])


def test_every_close_pair_meets_at_one_of_its_homes():
    fps = near(random.Random(2), 400, 2)
    anchor, row, home = simhash.anchors(fps)
    assert sorted(row[home].tolist()) == list(range(len(fps)))
    at_home, visitors = dict(zip(row[home].tolist(), anchor[home].tolist())), {}
    for a, k in zip(anchor.tolist(), row.tolist()):
        visitors.setdefault(a, set()).add(k)
    close = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= 2, 1)).tolist()
    assert len(close) > 500
    for i, j in close:
        assert j in visitors[at_home[i]] or i in visitors[at_home[j]]
    assert len(row) < 50 * len(fps)


def links_of(spark, fps):
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    return [(r["low"], r["high"]) for r in rows(simhash.linked(df))]


def groups_of(values, links):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in links:
        root[find(a)] = find(b)
    found = {}
    for v in values:
        found.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, found.values()))


def test_links_connect_what_is_close(spark, monkeypatch):
    r = random.Random(3)
    # a dense cloud around one centre, and scattered pairs
    centre = r.getrandbits(64)
    cloud = {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(300)}
    fps = np.unique(np.r_[np.array(sorted(cloud), np.uint64), near(r, 60, 3)])
    signed = fps.view(np.int64).tolist()
    close = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= 2, 1))
    expected = groups_of(signed, [(signed[i], signed[j]) for i, j in close])
    for block in (2048, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = links_of(spark, fps)
        assert groups_of(signed, found) == expected
        assert all(bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2 for a, b in found)


def test_cells_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    seats = spark.range(3000).select(F.lit(5).cast("long").alias("anchor"), F.col("id").alias("fp"), (F.col("id") % 3 == 0).alias("home"))
    cells_ = simhash.dealt(seats).groupBy("anchor", "i", "j").count().collect()
    assert max(r["count"] for r in cells_) <= 64 * 3
    # blocks at home meet each other and the visitors; visitors do not meet
    assert {r.i for r in cells_} == set(range(16)) and max(r.j for r in cells_) == 16 + 32 - 1


def test_groups_of_a_stream():
    r = random.Random(6)
    values = sorted((r.randrange(4), r.choice("ab"), r.random()) for _ in range(300))
    batches, at = [], 0
    while at < len(values):
        part = values[at:at + r.randrange(1, 40)]
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["k", "l", "x"]))
        at += len(part)
    found = [g.to_pylist() for g in cells.groups(iter(batches), 2)]
    assert [tuple(row.values()) for g in found for row in g] == values
    assert len(found) == len({v[:2] for v in values}) and all(len({(x["k"], x["l"]) for x in g}) == 1 for g in found)


def test_seats_are_not_broadcast(spark, tmp_path):
    # a file of fingerprints says little about the many seats that are made of them
    r = random.Random(8)
    spark.createDataFrame([(r.getrandbits(64) - 2 ** 63,) for _ in range(300)], "fp long").write.parquet(str(tmp_path / "fps"))
    links = simhash.linked(spark.read.parquet(str(tmp_path / "fps")))
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
