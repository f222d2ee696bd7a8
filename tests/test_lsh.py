import numpy as np
import pytest

from semdex.operators.duplicates import find_duplicates
from semdex.operators.lsh import SimHash, candidates, verified

SCHEMA = "id long, repo string, file_path string, line_start int, line_end int, content string, lang string, embedding array<float>"


def test_bits_and_bytes():
    planes = [[1, 0], [0, 1], [1, 1], [1, -1], [-1, 1], [-1, -1]]
    lsh = SimHash(2, 3, 2, planes=np.array(planes))
    assert lsh.bits([[1, 1], [1, -1]]).astype(int).tolist() == [[[1, 1, 1], [1, 1, 0]], [[1, 0, 1], [1, 0, 1]]]
    assert lsh.bands([[1, 1]]).tolist() == [[[0b11100000], [0b11000000]]]
    assert SimHash(1, 9, 2).bands([[0, 0]]).tolist() == [[[0xFF, 0x80]]]  # a zero vector sets all bits
    assert lsh.bits(np.zeros((0, 2))).shape == (0, 2, 3)


def test_planes_follow_from_the_seed_and_survive_storage():
    a, b = SimHash(dim=4), SimHash(dim=4)
    assert a.planes.shape == (72, 4)
    assert (a.planes == b.planes).all()
    assert (SimHash.planes_from(a.to_bytes()) == a.planes).all()
    with pytest.raises(ValueError):
        SimHash(dim=4).bits([[1.0, 2.0]])


def test_candidates_once_each(spark):
    rows = [(1, [b"a", b"x"]), (2, [b"a", b"y"]), (3, [b"a", b"x"]), (4, [b"z", b"q"])]
    signed = spark.createDataFrame(rows, "chunk_id long, bands array<binary>")
    assert sorted(map(tuple, candidates(signed).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_verification_is_inclusive_and_zero_is_unlike_all(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "id_a long, id_b long")
    found = {(r[0], r[1]): r[2] for r in verified(pairs, vectors, 0.7).collect()}
    assert found == {(1, 2): pytest.approx(0.70710678), (2, 3): pytest.approx(0.70710678)}
    assert (1, 4) in {(r[0], r[1]) for r in verified(pairs, vectors, 0.0).collect()}


@pytest.fixture
def chunks(spark):
    rows = [
        (1, "r", "src/a.py", 1, 2, "A", "python", [1.0, 0.0]), (2, "r", "src/b.py", 3, 4, "B", "python", [1.0, 0.0]),
        (3, "r", "src/a.py", 10, 12, "C", None, [1.0, 0.0]), (4, "s", "src/a.py", 1, 2, "D", "python", [1.0, 0.0]),
        (5, "s", "lib/z.py", 1, 2, "E", "python", [0.0, 0.0]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [(r["id_a"], r["id_b"]) for r in df.collect()]


def test_duplicates_order_limit_filters(chunks):
    lsh = SimHash(dim=2)
    assert ids(find_duplicates(chunks, lsh, threshold=0.99)) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert ids(find_duplicates(chunks, lsh, threshold=0.99, limit=2)) == [(1, 2), (1, 3)]
    assert ids(find_duplicates(chunks, lsh, threshold=0.99, limit=0)) == []
    assert ids(find_duplicates(chunks, lsh, ["r"], threshold=0.99, cross_file_only=True)) == [(1, 2), (2, 3)]
    assert (3, 4) in ids(find_duplicates(chunks, lsh, threshold=0.99, cross_file_only=True))  # the same path of two repos
    assert ids(find_duplicates(chunks, lsh, path_globs=["src/b*", "src/a*"], repos=["s"], threshold=0.9)) == []
    assert ids(find_duplicates(chunks, lsh, repos=[], threshold=0.9)) == []
    assert ids(find_duplicates(chunks, lsh, path_globs=[], threshold=0.9)) == []


def test_duplicate_records(chunks):
    first = find_duplicates(chunks, SimHash(dim=2), threshold=0.99, limit=2).collect()[1]
    assert first["chunk_b"].asDict() == {"repo": "r", "path": "src/a.py", "line_start": 10, "line_end": 12, "snippet": "C", "lang": ""}
    assert first["similarity"] == pytest.approx(1.0)


def test_a_complete_comparison_sends_each_vector_for_its_parts_alone(spark, monkeypatch):
    """Groups that share all bands, several parts and blocks: all pairs with their places, once, over one exchange."""
    for name, value in (("WHOLE_PART", 60), ("BLOCK_ROWS", 16), ("BLOCK_COLUMNS", 24)):
        monkeypatch.setattr("semdex.operators.lsh." + name, value)
    monkeypatch.setattr("semdex.operators.duplicates.WHOLE_PART", 60)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((40, 8)), 5, 0) + rng.standard_normal((200, 8)) * 0.1
    rows = [(i, f"r{i % 2}", f"f{i // 3}", 1, 1, "t", None, [float(v) for v in e]) for i, e in enumerate(x)]
    chunks = spark.createDataFrame(rows, "id long, repo string, file_path string, line_start int, line_end int, content string, lang string, embedding array<double>").localCheckpoint()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b): (x[a] @ x[b], rows[a][1:3], rows[b][1:3]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True) if rows[a][1:3] != rows[b][1:3]}
    monkeypatch.setattr(SimHash, "sign", None)
    found = find_duplicates(chunks, SimHash(dim=8), cross_file_only=True, threshold=0.9, limit=None, complete=True, places_only=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = found.collect()
    assert len(got) == len(want) > 300
    for r in got:
        sim, a, b = want[r["id_a"], r["id_b"]]
        assert r["similarity"] == pytest.approx(sim, abs=1e-9) and tuple(r["chunk_a"]) == a and tuple(r["chunk_b"]) == b
    whole = find_duplicates(chunks, SimHash(dim=8), cross_file_only=True, threshold=0.9, limit=7, complete=True).collect()
    assert [(r["id_a"], r["id_b"]) for r in whole] == sorted(want, key=lambda k: (-want[k][0], k))[:7] and whole[0]["chunk_a"]["snippet"] == "t"
