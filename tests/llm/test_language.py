import numpy as np
import pytest
from cases import no_documents, odd_documents
from conftest import rows
from pyspark.sql import functions as F

from pricelane.llm import language


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def filters(docs):
    return language.train(docs, language.learnable())


def test_held_out_accuracy(docs, filters):
    found = language.identified(docs, filters).filter(language.held_out() & (F.length("text") >= 20))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98


def test_filters_hold_every_kept_gram(filters):
    assert filters.languages == ["de", "en", "es", "fr"] and filters.false_rate.max() < 0.2


def plain_grams(text):
    """Letters in lower case with a boundary around each word, all runs of each order."""
    table = language.letters()
    words = "".join(chr(table[ord(c)]) if table[ord(c)] else " " for c in text).split()
    return [[g for w in words for g in (f" {w} "[i:i + n] for i in range(len(w) + 3 - n))] for n in language.ORDERS]


def test_grams_against_plain():
    texts = ["Hello, world!  é", "", "a", "...", "ab12cd\nab", "x y"]
    for (value, bounds), order in zip(language.grams(texts), range(len(language.ORDERS))):
        names = {}
        for i, text in enumerate(texts):
            expected = plain_grams(text)[order]
            assert bounds[i + 1] - bounds[i] == len(expected)
            for h, g in zip(value[bounds[i]:bounds[i + 1]], expected):
                assert names.setdefault(int(h), g) == g


def test_long_texts_in_segments(filters, monkeypatch):
    text = " ".join(["the and of to in is"] * 200)
    whole = language.predict([text, "was"], filters)
    monkeypatch.setattr(language, "SEGMENT", 50)
    assert "".join(language.segments(text)) == text
    cut = language.predict([text, "was"], filters)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1])


def test_odd_rows(spark, filters):
    docs = odd_documents(spark)
    found = language.identified(docs, filters)
    assert found.columns == [*docs.columns, "_lang_pred", "_score"]
    by_id = {r["doc_id"]: r for r in rows(found)}
    assert {i for i, r in by_id.items() if r["_lang_pred"] == "und"} >= {3, 4, 5, 10}
    assert all(0 <= r["_score"] <= 1 for r in by_id.values()) and by_id[10]["_score"] == 0
    kept = language.accepted(docs, filters)
    assert kept.columns == docs.columns and not {3, 4, 5, 10} & {r["doc_id"] for r in rows(kept)}
    assert language.identified(no_documents(spark), filters).count() == 0


def test_nothing_learned(spark, docs):
    none = language.train(no_documents(spark), F.lit(True))
    assert set(language.predict(["abc", None], none)[0]) == {"und"}
    nulls = docs.limit(5).withColumn("lang", F.lit(None).cast("string"))
    assert language.train(nulls, F.lit(True)).languages == []


def test_many_languages(spark):
    made = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}zz " * 5, f"l{i:03}") for i in range(150)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    filters = language.train(table, F.lit(True))
    assert len(filters.slots) == 3
    assert language.predict([t for _, t, _ in made], filters)[0] == [lang for _, _, lang in made]


def test_junk_and_unlearned_languages_are_not_accepted(spark, docs, filters):
    random = np.random.default_rng(0)
    word = lambda: "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), random.integers(3, 9)))
    junk = [" ".join(word() for _ in range(100)) for _ in range(50)]
    other = ["Ogni giorno il sole sorge sopra le montagne e illumina la valle dove vivono gli uomini",
             "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
             "Все люди рождаются свободными и равными в своем достоинстве и правах"]
    lost = " ".join(["qxzvwk"] * 2000) + " the"
    texts = [*junk, *other, lost]
    assert not language.recognised(texts, filters).any()
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert language.accepted(made, filters).count() == 0
    assert language.accepted(made, filters, least=0.0, deviations=0.0).count() >= 50


def test_learned_languages_are_accepted(docs, filters):
    lettered = [r.text for r in docs.select("text").collect() if language.has_letter(r.text)]
    assert language.recognised(lettered, filters).all()
    assert list(language.recognised(["The", "the of", "12 !", "", None], filters)) == [True, True, False, False, False]


def plain_sets(docs, min_count=2, rare=0.05):
    """The n-grams of each language in plain sets, from all rows of docs (text, lang)."""
    counts = {}
    for text, lang in docs:
        own = counts.setdefault(lang, {})
        for grams in plain_grams(text):
            for g in grams:
                own[g] = own.get(g, 0) + 1
    total = {lang: sum(own.values()) for lang, own in counts.items()}
    most = {}
    for lang, own in counts.items():
        for g, n in own.items():
            most[g] = max(most.get(g, 0), n / total[lang])
    return {lang: {g for g, n in own.items() if n >= min_count and n / total[lang] >= rare * most[g]} for lang, own in counts.items()}


def test_predictions_against_plain_sets(docs, filters):
    learned = docs.filter(language.learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    assert learned.groupBy("lang").count().agg(F.max("count")).first()[0] <= 1500  # so all of them are read
    sets = plain_sets([(r.text, r.lang) for r in learned.select("text", "lang").collect()])
    asked = [r.text for r in docs.filter(language.held_out()).select("text").collect()]
    said, _ = language.predict(asked, filters)
    corrected, n = language.summed_hits(asked, filters)
    same = 0
    for text, lang, hits, size in zip(asked, said, corrected, n):
        grams = [g for own in plain_grams(text or "") for g in own]
        assert size == len(grams)
        exact = np.array([sum(g in sets[k] for g in grams) for k in filters.languages])
        # what the filters count too much is chance, of which the expected number is taken off again
        spread = np.sqrt(size * filters.false_rate) / (1 - filters.false_rate)
        assert (abs(hits - exact) <= 8 * spread + 3 + 0.02 * size).all()
        best = filters.languages[int(exact.argmax())] if language.has_letter(text) else "und"
        margin = np.sort(exact)[-1] - np.sort(exact)[-2]
        same += best == lang
        assert best == lang or margin <= 8 * spread.max() + 3
    assert same >= 0.99 * len(asked)
