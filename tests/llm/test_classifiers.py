import random

import numpy as np
import pyarrow as pa
import pytest

from semdex.llm import language, queries, toxicity

ALPHABET = {"en": "the of and ing tion er", "de": "der sch ung und ein keit", "fr": "le eau tion ez é ou", "es": "ción el que ado ñ os"}


def prose(rng, lang, n=60):
    return " ".join("".join(rng.choices(ALPHABET[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, prose(rng, lang), lang, "s") for i in range(400) for lang in [rng.choice(list(ALPHABET))]]


def test_language(make, rows, odd_rows):
    model = language.train(make(rows[:200] + odd_rows))
    assert model.families.classes == ["germanic", "romance"]
    got = language.identify(make(rows + odd_rows), model).collect()
    assert len(got) == len(rows) + len(odd_rows)
    held = [r for r in got if r["doc_id"] is not None and 200 <= r["doc_id"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 8))
    assert all(0 <= r["score"] <= 1 for r in got)
    again = language.train(make(rows[:200] + odd_rows).repartition(6))
    assert (again.families.weights == model.families.weights).all()


def test_language_without_labels_or_with_one(make, rows):
    none = language.train(make(rows).limit(0))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(make(rows[:5]), none).collect()} == {("und", 0.0)}
    one = language.train(make([(1, "some text", "xx", "a"), (2, "more", None, "a")]))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(make(rows[:5]), one).collect()} == {("xx", 1.0)}
    assert language.identify(make(rows).limit(0), one).collect() == []


def test_features_stay_in_their_text():
    x = language.features(pa.array(["ab", "", None, "ab"]))
    assert np.allclose(x[0], x[3]) and not x[1].any() and not x[2].any()
    assert np.allclose(language.features(pa.array(["AB\tc"])), language.features(pa.array(["ab c"])))


def test_toxicity(spark, make, odd_rows):
    rng = random.Random(9)
    insults = ["grobian", "lumpenkerl", "fieserwicht"]
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.choice(list(ALPHABET)), 40).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", ",", "s"]))
        rows.append((1000 + i, " ".join(words), "en", "s"))
        if i % 2 == 0 or rng.random() < 0.4:
            labels.append((1000 + i, int(toxic)))
    table = spark.createDataFrame(labels + [(1000, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    docs = make(rows + odd_rows)
    model = toxicity.train(docs.filter("doc_id < 1600 OR doc_id IS NULL"), table.filter("doc_id < 1600 OR doc_id IS NULL"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    held = range(1600, 1900)
    assert sum(by[i] >= 0.7 for i in held if (i - 1000) % 6 == 0) / 50 > 0.9
    assert sum(by[i] >= 0.7 for i in held if (i - 1000) % 6) <= 2


def test_toxicity_without_positives(spark, make, rows):
    model = toxicity.train(make(rows[:20]), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(make(rows[:20]), model).collect()} == {0.0}
    assert toxicity.score(make(rows).limit(0), model).collect() == []


def test_risk_of_clean_texts_stays_non_negative():
    """Unlabelled rows that are all positives drive the uncorrected estimate below zero; weights stay bounded."""
    rows = [np.array([1, 2, 3], np.uint64)] * 20
    other = [np.array([k], np.uint64) for k in range(10, 200)]
    model = toxicity.fit(rows, rows + other, 0.3)
    assert np.isfinite(model.weights).all() and np.abs(model.weights).max() < 30


def test_held_out_rows_of_the_supplied_documents(spark):
    """What the models never saw: languages as given, and toxic texts ranked above the others."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = queries.op2_language_families(spark, sf_dir).filter("held_out AND lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL").collect()
    assert len(told) > 150 and sum(r["lang"] == r["lang_pred"] for r in told) >= 0.97 * len(told)
    sf_dir = "/root/testdata/sf0.1"
    scored = queries.op3_toxicity_pu(spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r["score"] for r in scored if r["toxic"] == k] for k in (1, 0))
    above = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert len(toxic) >= 100 and above >= 0.95
    assert sum(s >= 0.7 for s in toxic) >= 0.85 * len(toxic) and sum(s >= 0.7 for s in clean) <= 0.02 * len(clean)
