from collections import Counter

import numpy as np
from cases import no_documents, odd_documents
from conftest import SMALL, rows
from pyspark.sql import functions as F

from pricelane.llm import sharding


def plain(found, shards, vnodes):
    """Row by row: rounds in which each shard takes rows in ring order while it has room."""
    points = sharding.ring(shards, vnodes)
    positions = np.array([p for p, _ in points])
    waiting = sorted((int(np.searchsorted(positions, r["position"])) % len(points), r["position"], r["tie"], r["i"])
                     for r in found)
    waiting = [(arc, n, arc, i) for n, (arc, _, _, i) in enumerate(waiting)]
    room = [len(found) // shards + (s < len(found) % shards) for s in range(shards)]
    placed = {}
    while waiting:
        left = []
        for at, n, arc, i in sorted(waiting, key=lambda w: (w[0], w[2], w[1])):
            shard = points[at][1]
            if room[shard]:
                room[shard] -= 1
                placed[i] = shard
            else:
                left.append((at, n, arc, i))
        waiting = []
        for at, n, arc, i in left:
            at = (at + 1) % len(points)
            while not room[points[at][1]]:
                at = (at + 1) % len(points)
            waiting.append((at, n, arc, i))
    return placed


def slots_are_gapless(found, shards):
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))
    sizes = [len(by_shard.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_against_row_by_row(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = rows(sharding.shards_of(docs, 7, vnodes=5))
    slots_are_gapless(found, 7)
    text = F.coalesce("text", F.lit(""))
    raw = rows(docs.select(F.col("doc_id").alias("i"), F.xxhash64(text).alias("position"),
                           F.xxhash64("doc_id", F.lit(0)).alias("tie")))
    assert {r["doc_id"]: r["shard"] for r in found} == plain(raw, 7, 5)


def test_cells_change_no_shard_sizes(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "same")
                                   .otherwise(F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = rows(sharding.shards_of(docs, 6))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    slots_are_gapless(found, 6)
    assert len({r["doc_id"] for r in found}) == 500


def test_sizes_and_odd_rows(spark):
    found = rows(sharding.shards_of(odd_documents(spark), 4))
    slots_are_gapless(found, 4)
    assert len(found) == odd_documents(spark).count()
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found)
    assert sizes[(3, 16, 0)] == 1 and sizes[(4, 16, 0)] == 1 and sizes[(2, 33 + 16, 3446906842)] in (0, 2)
    assert sharding.shards_of(no_documents(spark), 4).count() == 0


def test_equal_texts_lie_together(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 100).cast("string").alias("text"))
    found = rows(sharding.shards_of(docs, 5).join(docs, "doc_id"))
    shards = {}
    for r in found:
        shards.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(s) == 1 for s in shards.values()) >= 70


def test_walk_moves_only_what_overflows():
    points = sharding.ring(10)
    random = np.random.default_rng(0)
    keys = random.integers(-2 ** 63, 2 ** 63, 20_000)
    arcs = np.searchsorted([p for p, _ in points], keys) % len(points)
    counts = dict(Counter(arcs.tolist()))
    owners = [s for _, s in points]
    ranges = sharding.walk(counts, owners, [2000] * 10)
    assert sum(high - low for _, low, high, _, _ in ranges) == 20_000
    home = Counter(owners[a] for a in arcs)
    stayed = sum(high - low for arc, low, high, shard, _ in ranges if owners[arc] == shard)
    assert stayed >= sum(min(n, 2000) for n in home.values()) * 0.97


def test_a_new_shard_keeps_other_points():
    assert [x for x in sharding.ring(11) if x[1] < 10] == sharding.ring(10)


def test_written_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 5
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0


def on_partitions(spark, n, build):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        return rows(build())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def with_a_hot_text(spark):
    """A text that a third of 1,500 rows share, texts of 2 to 20 rows, and single ones."""
    return spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 3 == 1, F.concat(F.lit("group "), F.floor(F.sqrt("id")))).otherwise(F.concat(F.lit("own "), "id")).alias("text"))


def test_shards_do_not_depend_on_partitions(spark):
    docs = with_a_hot_text(spark)
    few, many = ({r["doc_id"]: (r["shard"], r["slot"]) for r in on_partitions(
        spark, n, lambda: sharding.shards_of(docs.repartition(n), 9, vnodes=4, cell_rows=64))} for n in (2, 31))
    assert few == many and len(few) == 1500


def test_groups_beside_a_hot_text_stay_whole(spark):
    docs = with_a_hot_text(spark)
    found = rows(sharding.shards_of(docs, 9, vnodes=4, cell_rows=64))
    slots_are_gapless(found, 9)
    text = {r["doc_id"]: r["text"] for r in rows(docs)}
    spread = {}
    for r in found:
        spread.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    cut = [t for t, own in spread.items() if len(own) > 1 and t != "hot"]
    # a full shard cuts one text at most, whatever the cells are
    assert len(cut) <= 9
    plain_ = {r["doc_id"]: r["shard"] for r in rows(sharding.shards_of(docs, 9, vnodes=4, cell_rows=4096))}
    whole = {}
    for doc, shard in plain_.items():
        whole.setdefault(text[doc], set()).add(shard)
    assert len(spread["hot"]) <= len(whole["hot"]) + 1


def test_a_hot_text_is_numbered_in_pieces(spark):
    made = spark.range(1000).select(F.lit(3).alias("arc"), F.lit(77).cast("long").alias("position"), F.xxhash64("id").alias("tie"))
    cells = sharding._in_cells(made, 1000, 64).groupBy("hot", "place", "piece").count().collect()
    assert len(cells) == 16 and max(r["count"] for r in cells) < 2 * 64 and {r["hot"] for r in cells} == {1}
