import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from semdex.operators import search as search_module
from semdex.operators.embed import hashed
from semdex.operators.lsh import SimHash
from semdex.operators.search import search_stored
from semdex.plans import registered, stored, surface  # noqa: F401  the latter registers queries
from semdex.plans.registered import _IMPORTING, ORACLES, QUERIES, _import_blocks, _text_chunks
from semdex.streaming.files import SOURCE, StreamedIndex


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    ours, theirs = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(duck.sql(ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


def test_filters_reach_the_scan(spark, sf_dir):
    plan = QUERIES["knn_repo_filter"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "CartesianProduct" not in plan


def test_stored_searches_join_texts_to_results_alone(spark, sf_dir):
    """Without filters, nothing but the nearest vectors meets places and texts; and removal writes no part."""
    store = stored.stored(spark, sf_dir)
    found = search_stored(store.places(), store.vectors(), store.texts(), [0.1] * 64, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    texts = next(line for line in plan.split("\n") if "content" in line and "ReadSchema" in line)
    assert "embedding" not in texts and plan.count("TakeOrderedAndProject") >= 2
    assert all("content" not in line for line in plan.split("\n") if "ReadSchema" in line and "file_path" in line)
    before = {n: {p["chunks"], p["vectors"], p["bands"]} for n, p in store._manifest()["parts"].items()}
    reader = store.table("chunks")
    n = reader.count()
    assert store.remove_repo("repo1") > 0
    after = {n: set(p.values()) for n, p in store._manifest()["parts"].items()}
    assert after == {k: v for k, v in before.items() if k != "1"}
    assert reader.count() == n  # what was planned before the change still runs


def test_searches_ask_with_the_whole_query_set(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(search_module, "ROW_BLOCK", 64)
    monkeypatch.setattr(search_module, "QUERY_BLOCK", 3)
    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r["query_id"] for r in QUERIES["knn_query_set"](spark, sf_dir).collect()} == ids and len(ids) > 3
    items = {r["item_id"]: r["e"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id % 50 = 0").select("item_id", hashed(F.col("text")).alias("e")).collect()}
    chunks = _text_chunks(spark, sf_dir).select("id", "file_path", "line_start", "embedding").orderBy("id").collect()
    x = np.array([r["embedding"] for r in chunks], float)
    got = QUERIES["text_search"](spark, sf_dir).collect()
    assert {r["query_id"] for r in got} == set(items)
    for i, e in items.items():
        distance = np.linalg.norm(x - np.array(e, float) / (np.linalg.norm(e) or 1), axis=1).round(12)
        best = np.lexsort((np.arange(len(x)), distance))[:10]
        mine = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
        assert [r["score"] for r in mine] == pytest.approx([max(0, 1 - distance[j] / 2) for j in best], abs=2e-6)
        assert len({(r["path"], r["line"]) for r in mine}) == 10


def test_text_duplicates_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(150)] for _ in range(12)]
    texts = [" ".join(w if rng.random() > share else f"e{rng.randint(0, 400)}" for w in words) for words in base for share in (0, 0, 0.01, 0.03, 0.06)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = _text_chunks(spark, str(tmp_path)).select("id", "file_path", "embedding").collect()
    x = np.array([r["embedding"] for r in chunks])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    like = x @ x.T
    want = {tuple(sorted((chunks[i]["id"], chunks[j]["id"]))) for i, j in zip(*np.nonzero(like >= 0.95), strict=True) if chunks[i]["file_path"] != chunks[j]["file_path"]}
    found = {(r["id_a"], r["id_b"]): r["similarity"] for r in QUERIES["text_duplicates"](spark, str(tmp_path)).collect()}
    assert found.keys() == want
    assert any(v < 0.99 for v in found.values())


def test_text_duplicates_that_share_no_band_are_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registered, "SimHash", lambda bands, width, dim: SimHash(1, 24, dim))
    test_text_duplicates_equal_brute_force(spark, tmp_path)


def test_import_block_sees_whole_files(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in _import_blocks(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        own = text.removesuffix("\n").split("\n") if text else []
        assert got[i]["lines"] == [""] * (i % 8) + list(_IMPORTING) + own
        assert got[i]["block"]["line_start"] == 1 and got[i]["block"]["line_end"] == i % 8 + 5
        assert got[i]["block"]["content"].strip("\n") == "import a\nfrom b import (\n  c,\n)"


def test_a_stream_of_files(spark, tmp_path):
    from semdex.operators.embed import HashingProvider

    source, index = tmp_path / "in", StreamedIndex(spark, tmp_path / "index", HashingProvider())
    source.mkdir()
    spark.createDataFrame([("r", "a.py", 1.0, "x"), ("r", "b.py", 1.0, "y")], SOURCE).coalesce(1).write.mode("append").json(str(source))
    index.start(source, tmp_path / "cp").awaitTermination()
    assert {(r["file_path"], r["content"]) for r in index.chunks().collect()} == {("a.py", "x"), ("b.py", "y")}
    spark.createDataFrame([("r", "a.py", 2.0, "new"), ("r", "a.py", 1.5, "late"), ("r", "b.py", 0.5, "old")], SOURCE).coalesce(1).write.mode("append").json(str(source))
    index.start(source, tmp_path / "cp").awaitTermination()
    assert {(r["file_path"], r["content"]) for r in index.chunks().collect()} == {("a.py", "new"), ("b.py", "y")}
    before = index.chunks().count()
    index.apply(spark.createDataFrame([("r", "c.py", 1.0, "z")], SOURCE), 0)  # a batch that was written is skipped
    assert index.chunks().count() == before
    index.compact()
    assert {(r["file_path"], r["content"]) for r in index.chunks().collect()} == {("a.py", "new"), ("b.py", "y")}
    assert len(index._state()["parts"]) == 1


def test_scan_git_tracks_files_without_storing_them(spark, sf_dir, monkeypatch):
    roots = []
    real = stored.tree
    monkeypatch.setattr(stored, "tree", lambda *a: roots.append(real(*a)) or roots[0])
    got = {r["file_path"] for r in QUERIES["scan_git"](spark, sf_dir).collect()}
    assert got and all(int(os.path.basename(p).split(".")[0]) % 2 == 0 for p in got)
    objects = roots[0] / ".git/objects"
    assert objects.is_dir() and sum(p.is_file() for p in objects.rglob("*")) <= 1  # the empty one
