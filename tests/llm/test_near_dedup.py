import random
import re

import numpy as np
import pytest
from cases import ODD, lowered, no_documents, odd_documents
from conftest import rows

from pricelane.llm import components, near_dedup


def shingles(text):
    found = re.findall("[^\x20\x09-\x0D]+", lowered(text))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)}


def plain(docs, percent=85):
    """Row by row: (doc_id, n_shingles, component_id), by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(docs))


def check(spark, docs, percent=85):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = rows(near_dedup.near_duplicates(table, percent))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == plain(docs, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def edited(r, words, share):
    return [f"new{r.randrange(10 ** 9)}" if r.random() < share else w for w in words]


def made(seed, groups, size, share):
    r, docs = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(20, 200))]
        docs += [" ".join(edited(r, base, r.random() * share)) for _ in range(size)]
    r.shuffle(docs)
    return [(7 * i + 3, d) for i, d in enumerate(docs)]


def test_groups_at_all_similarities(spark):
    check(spark, made(1, 30, 6, 0.08))


def test_chain_of_edits(spark):
    r = random.Random(2)
    text, docs = [f"w{r.randrange(10 ** 6)}" for _ in range(300)], []
    for i in range(40):
        docs.append((100 - i, " ".join(text)))
        text = edited(r, text, 0.012)
    check(spark, docs)


def test_one_large_group_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    check(spark, made(3, 2, 120, 0.05), 85)


def test_small_sets_and_other_threshold(spark):
    r = random.Random(4)
    docs = [(i, " ".join(f"w{r.randrange(3)}" for _ in range(r.randrange(0, 9)))) for i in range(150)]
    check(spark, docs)
    check(spark, made(5, 10, 6, 0.06), 90)


def test_a_doc_id_on_several_texts(spark):
    base = [f"w{i}" for i in range(120)]
    other = [f"v{i}" for i in range(60)]
    docs = [(1, " ".join(base)), (5, " ".join(base + ["more"])), (5, " ".join(other)), (7, "nothing like the others at all here"),
            (8, " ".join(other[:-1] + ["changed"])), (9, " ".join(base[1:])), (9, " ".join(other[1:])), (4, " ".join(other + ["x"]))]
    check(spark, docs)
    table = spark.createDataFrame(docs[:4], "doc_id long, text string").repartition(2)
    assert sorted((r["doc_id"], r["text"]) for r in rows(near_dedup.without_near_duplicates(table))) == \
        sorted([docs[0], docs[2], docs[3]])


def test_rows_without_a_doc_id_are_linked(spark):
    base = [f"w{i}" for i in range(120)]
    docs = [(None, " ".join(base)), (6, " ".join(base + ["more"])), (None, " ".join(base[2:])),
            (None, "these words stand alone in the table"), (None, "these words stand alone in the table too")]
    found = rows(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in found) == sorted(
        map(str, [(None, 6, False), (6, 6, True), (None, 6, False), (None, None, True), (None, None, True)]))


def test_a_head_is_sent_once_per_cell(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    base = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(base[:i] + [f"n{i}"] + base[i + 1:])) for i in range(100)] + [(100, "far from all of the others here")]
    table = spark.createDataFrame(texts, "id long, text string")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 101)], "id long, head long")
    assert sorted((r["low"], r["high"]) for r in rows(near_dedup.verified(pairs, table, 85))) == [(0, i) for i in range(1, 100)]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = rows(near_dedup.near_duplicates(docs))
    assert len(found) == len(ODD)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by_id[2]] == [1, 1] and not by_id[2][0]["kept"]
    assert all(by_id[i][0]["n_shingles"] == 0 and by_id[i][0]["kept"] for i in (3, 4, 5))
    assert by_id[7][0]["n_shingles"] == 1 and by_id[8][0]["n_shingles"] == 1
    assert sorted(str(r["component_id"]) for r in by_id[None]) == ["1", "None"]
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and 2 not in {r["doc_id"] for r in rows(kept)}
    assert near_dedup.near_duplicates(no_documents(spark)).count() == 0
    assert near_dedup.without_near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize("similarity", [0.5, 0.85, 0.95])
def test_registers_agree_as_sets_do(similarity):
    random_, n = np.random.default_rng(6), 4000
    both = int(round(2 * n * similarity / (1 + similarity)))
    values = random_.integers(0, 2 ** 63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
    a, b = np.sort(values[:n]), np.sort(values[n - both:])
    share = np.mean([(x == y).mean() for x, y in [near_dedup.registers([a, b])]])
    assert abs(share - similarity) < 5 * (similarity * (1 - similarity) / near_dedup.REGISTERS) ** 0.5
    union = near_dedup.registers([np.union1d(a, b)])[0]
    assert (union == np.maximum(*near_dedup.registers([a, b]))).all()


def test_likelihood_keeps_similar_and_drops_far_pairs():
    ones = np.ones(3)
    same = np.array([0.85, 0.6, 0.2]) * near_dedup.REGISTERS
    half = (near_dedup.REGISTERS - same) / 2
    assert near_dedup.likely(half, half, 500 * ones, 500 * ones, 85).tolist() == [True, False, False]
    assert not near_dedup.likely(np.zeros(1), np.zeros(1), np.array([100.0]), np.array([50.0]), 85)[0]


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 200)] \
        + [tuple(sorted(r.sample(range(300, 400), 2))) for _ in range(60)]
    table = spark.createDataFrame(edges, "low long, high long")
    found = {x["id"]: x["root"] for x in rows(components.components(table))}
    root = {i: i for e in edges for i in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {i: found.get(i, i) for i in root} == root


def test_a_large_root_is_not_dealt_against_itself(spark):
    made = [(1, 3001, i, 0 if i < 3000 else i) for i in range(3001)]
    cells = near_dedup.dealt(spark.createDataFrame(made, "key long, size long, id long, root long"))
    assert cells.count() <= 3000 + 10


def test_different_roots_meet_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    groups = {1: [40, 1], 2: [30, 20, 1, 1], 3: [1] * 30, 4: [5, 2], 5: [50], 6: [9, 9]}
    made = [(key, sum(sizes), 10_000 * key + 100 * g + i, 10_000 * key + 100 * g)
            for key, sizes in groups.items() for g, n in enumerate(sizes) for i in range(n)]
    cells = {}
    for r in near_dedup.dealt(spark.createDataFrame(made, "key long, size long, id long, root long")).collect():
        cells.setdefault((r.key, r.i, r.j), []).append(r)
    met = [frozenset((a.id, b.id)) for c in cells.values() for a in c for b in c
           if a.root != b.root and (a.side == 0 and b.side == 1 or a.side == b.side == 2 and a.id < b.id)]
    wanted = {frozenset((a[2], b[2])) for a in made for b in made if a[0] == b[0] and a[3] != b[3]}
    assert len(met) == len(set(met)) and set(met) == wanted
