import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from semdex.llm import queries


def test_stages(spark, make, odd_rows):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices(["the", "of", "er", "ing", "tion", "and"], k=rng.randint(1, 3))) for _ in range(n))
    rows = odd_rows + [(100 + i, prose(40), "en", "ab"[i % 2]) for i in range(60)]
    rows += [(300, rows[-1][1], "en", "a"), (301, "%%% " * 40, "en", "a"), (302, "123 456", "en", "b")]
    docs = make(rows)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, None).cache()
        assert kept.schema.names == docs.schema.names, name
        if name != "mixing":
            assert kept.exceptAll(before).isEmpty(), name
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {1, 2, 3, 300, 301, 302}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, None)
    assert {r["doc_id"] for r in packed.collect()} == ids


def test_stages_of_nothing(spark, make, odd_rows):
    for rows in (make(odd_rows).limit(0), make([(None, None, None, None)])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, None)
            assert out.columns == rows.columns, name
            assert out.count() <= rows.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, make(odd_rows).limit(0), None).count() == 0


def test_stages_keep_rows_that_share_an_id_or_have_none(spark, make):
    """Other texts under one id, or none, are documents of their own; columns of the rules' names stay as they are."""
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choices(["the", "of", "er", "ing", "tion", "and"], k=rng.randint(1, 3))) for _ in range(40))
    rows = [(7, prose(), "en", "a") for _ in range(20)] + [(None, prose(), "en", "a") for _ in range(20)] + [(100 + i, prose(), "en", "a") for i in range(40)]
    docs = make(rows).withColumns({c: F.col("n_chars") for c in ("n_words", "kept", "rejected_by", "bucket", "copies", "_size")})
    texts = Counter(t for _, t, *_ in rows)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, None).cache()
        left = docs.collect()
        assert Counter(r["text"] for r in left) == texts, name
        assert all(r[c] == r["n_chars"] for r in left for c in ("n_words", "kept", "rejected_by", "bucket", "copies", "_size")), name
    mixed = Counter(r["text"] for r in corpus_pipeline.STAGES[3][1](spark, docs, None).collect())
    assert mixed == texts  # one source is taken once
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, None).filter("piece = 0")
    assert pieces.count() == len(rows)


def test_all_queries_are_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op"))
    assert numbers == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near-copies", "mixing", "packing"]
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    key = "vec_id" if "vector" in name else "doc_id"
    ours = queries.queries()[name](spark, sf_dir).toPandas().sort_values(key).reset_index(drop=True)
    theirs = con.sql(queries.oracle_sql()[name]).df().sort_values(key).reset_index(drop=True)
    for frame in (ours, theirs):  # a column of nulls has one type here and another there
        for c in frame.columns[frame.isna().all()]:
            frame[c] = None
    assert ours[sorted(ours.columns)].equals(theirs[sorted(theirs.columns)])
