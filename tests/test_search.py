import math
import random

import numpy as np
import pytest

from semdex.errors import DimensionMismatchError
from semdex.functions import vectors
from semdex.operators import search as search_module
from semdex.operators.search import check_width, search, search_many, search_stored, search_stored_many

SCHEMA = "id long, repo string, file_path string, line_start int, content string, lang string, embedding array<float>"
ROWS = [
    (1, "a", "src/main.py", 10, "m", "python", [1.0, 0.0]),
    (2, "a", "src/other.ts", 20, "o", "typescript", [0.6, 0.4]),
    (3, "b", "pkg/main.py", 30, "p", "python", [0.0, 1.0]),
    (4, "b", "pkg/none", 40, "n", None, [-1.0, 0.0]),
]


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def paths(df):
    return [r["path"] for r in df.collect()]


def test_score_is_of_euclidean_distance(chunks):
    found = {r["path"]: r["score"] for r in search(chunks, [1.0, 0.0]).collect()}
    assert found["src/main.py"] == 1.0
    assert found["pkg/main.py"] == pytest.approx(1 - math.sqrt(2) / 2)
    assert found["src/other.ts"] == pytest.approx(1 - math.sqrt(0.32) / 2, abs=1e-7)


def test_filters_threshold_and_limit(chunks):
    assert paths(search(chunks, [1.0, 0.0], limit=2, threshold=0.7)) == ["src/main.py", "src/other.ts"]
    assert paths(search(chunks, [1.0, 0.0], repo="a", langs=["python"])) == ["src/main.py"]
    assert paths(search(chunks, [1.0, 0.0], path_glob="src/*.py")) == ["src/main.py"]
    assert paths(search(chunks, [1.0, 0.0], path_glob="SRC/*")) == []
    assert paths(search(chunks, [1.0, 0.0], limit=0)) == []
    assert paths(search(chunks, [1.0, 0.0], langs=[])) == paths(search(chunks, [1.0, 0.0]))


def test_filters_come_before_the_nearest_are_taken_unless_capped(chunks):
    assert paths(search(chunks, [1.0, 0.0], limit=1, repo="b")) == ["pkg/main.py"]
    assert paths(search(chunks, [1.0, 0.0], limit=1, repo="b", candidate_cap=2)) == []


def test_clamped_scores_are_ordered_by_name(spark):
    far = spark.createDataFrame([(1, "z", "f", 1, "", None, [9.0]), (2, "a", "f", 1, "", None, [5.0]), (3, "m", "f", 1, "", None, [3.0])], SCHEMA)
    assert [r["repo"] for r in search(far, [0.0], limit=3).collect()] == ["a", "m", "z"]
    assert [r["repo"] for r in search(far, [0.0], limit=2).collect()] == ["a", "m"]  # the two nearest, then by name
    assert {r["lang"] for r in search(far, [0.0]).collect()} == {""}


def test_many_queries(spark, chunks):
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id int, query array<float>")
    found = {(r["query_id"], r["rank"]): r["id"] for r in search_many(chunks, asked, 2).collect()}
    assert found == {(7, 1): 1, (7, 2): 2, (8, 1): 3, (8, 2): 2}


@pytest.mark.parametrize("filters", [{}, {"repo": "b"}, {"langs": ["go"], "path_glob": "src/*"}])
def test_many_stored_queries_find_what_each_finds_alone(spark, monkeypatch, filters):
    """Copies, equal and clamped scores, odd numbers and absent vectors, in blocks that are smaller than the ties."""
    monkeypatch.setattr(search_module, "ROW_BLOCK", 16)
    monkeypatch.setattr(search_module, "QUERY_BLOCK", 2)
    r = random.Random(3)
    some = [[r.uniform(-1, 1) for _ in range(5)] for _ in range(12)] + [[3.0 + i, 0.0, 0.0, 0.0, 0.0] for i in range(3)] + [[math.nan] * 5, [math.inf] * 5, None]
    rows = [(i, r.choice("abc"), f"{r.choice(['src', 'x'])}/f{r.randint(0, 3)}", r.randint(1, 3), f"t{i}", r.choice(["go", "c", None]), r.choice(some)) for i in range(240)]
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    stored = chunks.drop("content", "embedding"), chunks.select("id", "embedding"), chunks.select("id", "content")
    asked = [(10 * i, v, t) for i, (v, t) in enumerate([(v, 0.0) for v in (*some[:2], some[13], [0.0] * 5, [-9.0] * 5)] + [(some[0], 0.6)])]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>, threshold double")
    got = search_stored_many(*stored, queries, 9, **filters).orderBy("query_id", "rank").drop("rank").collect()
    for i, v, t in asked:
        alone = [tuple(x) for x in search_stored(*stored, v, 9, t, **filters).collect()]
        assert alone and repr([tuple(x)[1:] for x in got if x["query_id"] == i]) == repr(alone)  # NaN, too
    assert {len([x for x in got if x["query_id"] == i]) for i, *_ in asked} >= {9}
    chunks.unpersist()


def test_exact_distances_in_slices(spark, monkeypatch):
    monkeypatch.setattr(search_module, "EXACT_AT_ONCE", 100)
    r = np.random.default_rng(3)
    x, q = r.normal(size=(30, 40)), r.normal(size=(3, 40))
    of, at = np.repeat(np.arange(3), 30), np.tile(np.arange(30), 3)
    pairs = spark.createDataFrame([(q[i].tolist(), x[j].tolist()) for i, j in zip(of, at, strict=True)], "q array<double>, x array<double>")
    assert search_module._exact(x, q, of, at).tolist() == [d for (d,) in pairs.select(vectors.l2(pairs.x, pairs.q)).collect()]


def test_width_guard():
    check_width(None, [1.0])
    with pytest.raises(DimensionMismatchError):
        check_width(3, [1.0, 2.0])
