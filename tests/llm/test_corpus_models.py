import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from semdex.llm import ctw, ngram_join, queries, vector_graph
from semdex.llm.common import global_rank, remainder
from semdex.llm.graph import components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
W = re.compile(r"[^\x20\x09-\x0D]+")


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in want if n not in got)
    assert components(spark.createDataFrame(links, "a long, b long").limit(0)).collect() == []


def test_roots_of_links_in_any_order():
    assert ngram_join._roots(4, np.array([1, 2, 0]), np.array([2, 3, 3])).tolist() == [0, 0, 0, 0]
    rng = np.random.default_rng(4)
    for n in (30, 300):
        for _ in range(30):
            a, b = rng.integers(0, n, (2, n * 2 // 3))
            assert ngram_join._roots(n, a, b).tolist() == list(classes(range(n), zip(a.tolist(), b.tolist(), strict=True)).values())


def test_blocks_of_near_copies_hold_no_list_of_their_pairs(monkeypatch):
    """Eight tasks of two parts of 900 near copies each come as one batch: 6.5 million pairs survive."""
    monkeypatch.setattr(ngram_join, "stream", lambda rows, run, schema: run)
    need, n = ngram_join.least_matches(), 900
    sig = np.arange(ngram_join.HASHES, dtype=np.uint32).tobytes()
    task, side, rep = np.repeat(np.arange(8), 2 * n), np.tile(np.repeat([0, 1], n), 8), np.tile(np.arange(2 * n), 8)
    batch = pa.RecordBatch.from_arrays([pa.array(task), pa.array(side), pa.array(rep), pa.array([sig] * len(rep), pa.binary())], ["task", "side", "rep", "signature"])
    run = ngram_join.candidate_links(MagicMock(), need)
    tracemalloc.start()
    try:
        found = [x for out in run(iter([batch])) for x in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert Counter(found) == {(i, 0): 8 for i in range(1, 2 * n)}
    assert peak < 64 << 20


def test_global_rank(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", i * 7 % 100, i) for i in range(3000)] + [(None, 1, -1)]
    got = global_rank(spark.createDataFrame(rows, "g string, v long, i long"), ["g"], ["v", "i"], total="n").collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["rank"], r["v"], r["i"], r["n"]))
    for rs in by.values():
        rs.sort()
        assert [r[0] for r in rs] == list(range(len(rs))) and {r[3] for r in rs} == {len(rs)}
        assert [r[1:3] for r in rs] == sorted(r[1:3] for r in rs)


def grams(text):
    w = W.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def family(rng, n, words):
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("part", [1024, 16])
def test_ngram_join_equals_brute_force(make, odd_rows, monkeypatch, part):
    """Small parts put every group through blocks."""
    monkeypatch.setattr(ngram_join, "PART", part)
    rng = random.Random(part)
    texts = [t for k in (1, 2, 3, 60) for _ in range(4) for t in family(rng, k, 80)] + ["Same Words here are Five", "same words here are five", "x y", "X y", "x z"] * 2
    rows = odd_rows + [(1000 + i, t, "en", "a") for i, t in enumerate(texts)]
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(make(rows)).collect()]
    sets = [(i, grams(t)) for i, t, *_ in rows if i is not None]
    links, degree = [], Counter()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and len(a & b) * 5 >= 4 * len(a | b):
                links.append((i, j))
                degree[x] += 1
    for x, (_, a) in enumerate(sets):
        degree[x] = sum(1 for y, (_, b) in enumerate(sets) if x != y and a and b and len(a & b) * 5 >= 4 * len(a | b))
    want = classes({i for i, _ in sets}, links)
    expected = Counter((i, want[i], degree[x]) for x, (i, _) in enumerate(sets))
    expected[None, None, 0] += 1
    assert Counter(got) == expected
    kept = ngram_join.keep_one(make(rows))
    assert kept.columns == make(rows).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in rows if i is None or want[i] == i)


def test_ids_that_repeat_with_other_texts(make):
    """A ~ B and B ~ C but not A ~ C, where one id has A and B; and an id that only repetition leads to."""
    words = [f"w{i}" for i in range(100)]
    a, b, c = " ".join([*(f"a{i}" for i in range(10)), *words[10:]]), " ".join(words), " ".join([*words[:90], *(f"c{i}" for i in range(10))])
    sets = [grams(x) for x in (a, b, c)]
    like = lambda x, y: len(x & y) * 5 >= 4 * len(x | y)
    assert like(sets[0], sets[1]) and like(sets[1], sets[2]) and not like(sets[0], sets[2])
    other = " ".join(f"o{i}" for i in range(50))
    for rows in ([(5, a), (5, b), (9, c)], [(5, b), (5, a), (9, c), (5, a)]):
        rows = rows + [(21, other), (20, other), (21, "alone"), (21, "")]
        got = Counter(tuple(r) for r in ngram_join.join(make([(i, t, "en", "a") for i, t in rows]).coalesce(1)).collect())
        texts = Counter(t for _, t in rows)
        degree = {a: texts[a] + texts[b] - 1, b: texts[a] + texts[b] + texts[c] - 1, c: texts[b] + texts[c] - 1, other: 1, "alone": 0, "": 0}
        assert got == Counter((i, 5 if i < 20 else 20, degree[t]) for i, t in rows)


def test_pruning_keeps_pairs_at_the_threshold():
    need = ngram_join.least_matches()
    t = 0.8
    for n in range(7, 64, 7):
        lost = sum(math.comb(n, m) * t**m * (1 - t) ** (n - m) for m in range(need[n]))
        assert lost < 1e-5
    assert need[63] > 20  # and drops pairs far below it
    assert ngram_join.least_matches(Fraction(1, 2))[63] < need[63]


def test_join_of_nothing(make):
    assert ngram_join.join(make([(1, "x", "en", "a")]).limit(0)).collect() == []


def slow_ctw(training):
    """Context-tree weighting from its definition: a probability for each bit from counts of all depths."""
    counts = defaultdict(lambda: [0, 0])
    for text in training:
        data = b"\0\0" + text + b"\0"
        for i in range(2, len(data)):
            for d in range(3):
                context, node = data[i - d : i], 1
                for k in range(7, -1, -1):
                    bit = data[i] >> k & 1
                    counts[context, node][bit] += 1
                    node = node * 2 + bit
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(context, node):
        key = context, node
        if key not in memo:
            own = kt(*counts[key]) if key in counts else 0.0
            if len(context) == 2:
                memo[key] = own
            else:
                below = sum(weighted(bytes([c]) + context, node) for c in range(256) if (bytes([c]) + context, node) in counts)
                memo[key] = np.logaddexp(own, below) - math.log(2)
        return memo[key]

    def chance(context, node, depth=0):
        sub = context[2 - depth :]
        a, b = counts[sub, node] if (sub, node) in counts else (0, 0)
        own = (b + 0.5) / (a + b + 1)
        if depth == 2:
            return own
        stay = math.exp((kt(a, b) if a + b else 0.0) - math.log(2) - weighted(sub, node))
        return stay * own + (1 - stay) * chance(context, node, depth + 1)

    def score(text):
        data, total = b"\0\0" + text + b"\0", 0.0
        for i in range(2, len(data)):
            node = 1
            for k in range(7, -1, -1):
                p, bit = chance(data[i - 2 : i], node), data[i] >> k & 1
                total += math.log10(p if bit else 1 - p)
                node = node * 2 + bit
        return total

    return score


def test_ctw_equals_its_definition(make):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["abra", "Kad", "é", "x"]) for _ in range(rng.randint(0, 6))), "en", "a") for i in range(14)] + [(99, None, None, None)]
    held = F.col("doc_id") % 4 == 2
    got = {r["doc_id"]: r for r in ctw.score(make(rows), F.coalesce(held, F.lit(False))).collect()}
    low = {i: (t or "").translate(LOW) for i, t, *_ in rows}
    score = slow_ctw([low[i].encode() for i in low if i % 4 != 2])
    training = Counter(w for i in low if i % 4 != 2 for w in [*W.findall(low[i]), None])
    n, v = sum(training.values()), len(training)
    for i, text in low.items():
        tokens = [*W.findall(text), None]
        assert got[i]["score"] == pytest.approx(score(text.encode()), abs=1e-9)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((training[w] + 1) / (n + v + 1)) for w in tokens), abs=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(training[w] > 0 for w in tokens), n)


@pytest.mark.parametrize("depth", [3, 4, 6])
def test_deep_ctw_equals_its_definition(make, depth):
    """One decision after another, by a plain recursion over suffixes of any length."""
    rng = random.Random(depth)
    rows = [(i, " ".join(rng.choice(["abra", "Kadabra", "é", "x"]) for _ in range(rng.randint(0, 6))), "en", "a") for i in range(14)] + [(99, None, None, None), (98, "unseen", "en", "a")]
    low = {i: (t or "").translate(LOW).encode() for i, t, *_ in rows}
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    decisions = lambda byte: [((1 << k) | byte >> (8 - k), byte >> (7 - k) & 1) for k in range(8)]
    for data in (bytes(depth) + low[i] + b"\0" for i in low if i % 4 != 2):
        for at in range(depth, len(data)):
            for d in range(depth + 1):
                for node, bit in decisions(data[at]):
                    counts[data[at - d : at], node][bit] += 1
                    if d:
                        children[data[at - d + 1 : at], node].add(data[at - d : at])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(context, node):
        own = kt(*counts.get((context, node), (0, 0)))
        return own if len(context) == depth else np.logaddexp(own, sum(weighted(c, node) for c in children.get((context, node), ()))) - math.log(2)

    def one(context, node, d=0):
        sub = context[depth - d :]
        a, b = counts.get((sub, node), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        stay = 1.0 if d == depth else math.exp(kt(a, b) - math.log(2) - weighted(sub, node))
        return own if d == depth else stay * own + (1 - stay) * one(context, node, d + 1)

    got = {r["doc_id"]: r["score"] for r in ctw.score(make(rows), F.col("doc_id") % 4 == 2, depth).collect()}
    for i in (2, 6, 98, 99, 3):
        data = bytes(depth) + low[i] + b"\0"
        chances = ((one(data[at - depth : at], node), bit) for at in range(depth, len(data)) for node, bit in decisions(data[at]))
        assert got[i] == pytest.approx(sum(math.log10(p if bit else 1 - p) for p, bit in chances), abs=1e-9)


def test_ctw_query_uses_long_contexts(spark, tmp_path):
    """The last byte depends on the first, which two bytes of context can't see."""
    rows = [(i, ("bxxxc " if i % 2 else "dxxxe ") * 20, "en", "a", 0) for i in range(40)]
    probes = [i for i in range(1000, 1060) if zlib.crc32(str(i).encode()) % 7 == 2]  # held out
    rows += [(i, "bxxxc" if i == probes[0] else "bxxxe", "en", "a", 0) for i in probes[:2]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.op9_ctw_score(spark, str(tmp_path)).collect()}
    assert got[probes[0]] > got[probes[1]] + 0.5


def test_ctw_scores_a_chunk_in_little_memory(make, monkeypatch):
    """Six megabytes of text are scored a megabyte at a time, and no task gets the tables of the trees' top."""
    sent, real = [], ctw.stream
    monkeypatch.setattr(ctw, "stream", lambda rows, run, schema: sent.append((rows, run)) or real(rows, run, schema))
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=18000)), "en", "a") for i in range(60)] + [(60, None, "en", "a")]
    ctw.score(make(docs).coalesce(1), F.col("doc_id") % 4 == 2, 5)
    rows, run = sent[-1]
    batches = rows.toArrow().to_batches()
    assert max(sum(r["sizes"]) for b in batches for r in b.to_pylist()) > ctw.CHUNK_TEXT
    tracemalloc.start()
    try:
        found = [r for b in run(iter(batches)) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6
    assert len(cloudpickle.dumps(run)) < 100_000
    assert sorted(r["doc_id"] for r in found) == list(range(61))
    monkeypatch.setattr(ctw, "TEXT_BYTES", 1 << 30)
    assert found == [r for b in run(iter(batches)) for r in b.to_pylist()]


def test_ctw_is_a_distribution():
    code, n = np.array([(97 << 8) | 98, (97 << 16) | (98 << 8) | 99, 97], np.int64), np.array([5, 2, 3])
    model = ctw.Model(code, n)
    assert np.allclose((10.0 ** model.table.reshape(-1, 256)).sum(1), 1)


def test_ctw_edges(make, odd_rows):
    assert len(ctw.score(make(odd_rows), remainder("doc_id", 7) == 2).collect()) == len(odd_rows)
    untrained = ctw.score(make(odd_rows), F.lit(True)).collect()
    assert {r["n_known"] for r in untrained} == {0}
    assert next(r["score"] for r in untrained if r["doc_id"] == 1) == pytest.approx(-8 * math.log10(2))
    assert ctw.score(make(odd_rows).limit(0), F.lit(False)).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", 3) for i, e, label in rows], "vec_id long, embedding array<float>, label int, rep string, copies int")


@pytest.mark.parametrize(("cluster", "part"), [(1000, 1024), (60, 32)])
def test_vector_links(spark, monkeypatch, cluster, part):
    monkeypatch.setattr(vector_graph, "CLUSTER", cluster)
    monkeypatch.setattr(vector_graph, "PART", part)
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for label in (1, 2):
        base = rng.standard_normal((40, 16))
        for b in base:
            for _ in range(int(rng.integers(1, 8))):
                rows.append((at, [float(x) for x in np.float32(b + rng.standard_normal(16) * 0.07)], label))
                at += 1
        centre = rng.standard_normal(16)
        for _ in range(90):  # a dense group
            rows.append((at, [float(x) for x in np.float32(centre + rng.standard_normal(16) * 0.05)], label))
            at += 1
    rows += [(at, rows[0][1], 1), (at + 1, rows[0][1], 2), (at + 2, None, 1), (at + 3, [0.0] * 16, 1), (at + 4, [float("nan")] * 16, 1), (at + 5, rows[0][1], None), (at + 6, [1.0, None], 1), (at + 7, [1.0, 2.0], 1), (at + 8, [], 1)]
    ok = {i: np.array(e) for i, e, label in rows if e and label is not None and None not in e and np.isfinite(e).all() and any(e)}
    label = {i: lab for i, _, lab in rows}
    ids = sorted(ok)
    exact = {(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / math.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.98}
    found, recall = vector_graph.links(vectors(spark, rows))
    got = {r["vec_id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    degree = Counter(x for e in exact for x in e)
    assert all(got[i]["n_links"] <= degree[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * 2 * len(exact)
    assert recall >= 0.97
    want = classes(got, exact)
    assert sum(got[i]["component_id"] == want[i] for i in got) >= 0.99 * len(got)


def test_audit_sees_small_groups_beside_a_dense_one(spark):
    """Pairs that weren't found count, though one dense group has nearly all links."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x)
    centre, at, rows = unit(rng.standard_normal(32)), 0, []
    for _ in range(700):
        rows.append((at, [float(x) for x in np.float32(centre + rng.standard_normal(32) * 0.005)], 1))
        at += 1
    for i in range(1300):
        b = unit(rng.standard_normal(32))
        for _ in range(2 if i < 100 else 1):
            rows.append((at, [float(x) for x in np.float32(b + rng.standard_normal(32) * 0.005)], 1))
            at += 1
    table = spark.createDataFrame([(i, e, label, len(e), 1) for i, e, label in rows], "rep long, embedding array<float>, label int, width int, copies long")
    exact, _ = vector_graph._audit(table, 0.98)
    exact = exact.cache()
    lost = spark.createDataFrame([(i, 699 if i < 700 else 0) for i in range(at)], "rep long, links long")
    kept = spark.createDataFrame([(i, 699 if i < 700 else int(i < 900)) for i in range(at)], "rep long, links long")
    assert exact.filter("exact > 0 AND rep >= 700").count() >= 60
    assert vector_graph._recall(exact, lost) < 0.5
    assert vector_graph._recall(exact, kept) == pytest.approx(1)
    assert vector_graph._recall(exact.filter("exact = 0"), kept) is None


def test_two_levels_of_centroids(spark, monkeypatch):
    """With few centroids at a time, cells are divided again; clusters stay small and links are found."""
    for name, value in (("CLUSTER", 40), ("MOST_CENTROIDS", 5), ("ASSIGNED", 60)):
        monkeypatch.setattr(vector_graph, name, value)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((300, 16)))
    x = np.concatenate([base, unit(base[:150] + rng.standard_normal((150, 16)) * 0.01)]).astype(np.float32)
    table = vectors(spark, [(i, [float(v) for v in e], i % 2) for i, e in enumerate(x)] + [(900, [1.0, 2.0], 1)])
    sizes = []
    refined = vector_graph._refined

    def watched(placed):
        out = refined(placed)
        sizes.append(out.select("label", F.explode("clusters").alias("c")).groupBy("label", "c").count().count())
        return out

    monkeypatch.setattr(vector_graph, "_refined", watched)
    found, recall = vector_graph.links(table)
    y = unit(x.astype(float))
    near = (y @ y.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(near, False)
    links = {r["vec_id"]: r["n_links"] for r in found.collect()}
    assert len(links) == len(x) + 1 and sizes[0] > 10
    assert recall >= 0.97 and sum(links[i] for i in range(len(x))) >= 0.97 * near.sum() > 100


def test_vectors_that_share_an_id(spark):
    """Each row has the links of its own vector; an id that stands for two vectors doesn't link them."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    like = lambda v: [x + 0.01 for x in v]
    rows = [(5, a, 1), (5, b, 1), (7, like(a), 1), (6, like(b), 1), (8, like(a), 2), (None, a, 1), (9, b, 1), (9, b, 1)]
    found, recall = vector_graph.links(vectors(spark, rows))
    got = Counter(tuple(r) for r in found.collect())
    assert got == Counter([(5, 1, 5), (5, 3, 5), (7, 1, 5), (6, 3, 5), (8, 0, 8), (None, 0, None), (9, 3, 5), (9, 3, 5)]) and recall == 1


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "range_pairs", lambda *a, **k: iter(()))
    with pytest.raises(vector_graph.RecallError):
        vector_graph.links(vectors(spark, [(i, [1.0, i / 1000], 1) for i in range(20)]))


def test_dense_groups_at_production_size(spark):
    """A third of the vectors are one dense group, dealt over parts; planted pairs and triples beside it."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    dense = unit(unit(rng.standard_normal(24)) + rng.standard_normal((2600, 24)) * 0.004)
    loose = unit(rng.standard_normal((2600, 24)))
    planted = unit(np.concatenate([loose[:200], loose[:100]]) + rng.standard_normal((300, 24)) * 0.004)
    x = np.concatenate([dense, loose, planted]).astype(np.float32)
    found, recall = vector_graph.links(vectors(spark, [(i, [float(v) for v in e], 1) for i, e in enumerate(x)]))
    y = unit(x.astype(float))
    near = y @ y.T >= 0.98
    np.fill_diagonal(near, False)
    links = {r["vec_id"]: r["n_links"] for r in found.collect()}
    assert recall >= 0.97
    assert sum(min(links[i], n) for i, n in enumerate(near.sum(1))) >= 0.99 * near.sum()
    small = [i for i in range(2600, len(x)) if near[i].any()]
    assert len(small) >= 500 and np.mean([links[i] == near[i].sum() for i in small]) >= 0.97
    assert all(links[i] <= n for i, n in enumerate(near.sum(1)))


def test_vectors_of_nothing(spark):
    found, recall = vector_graph.links(vectors(spark, [(1, [1.0], 1)]).limit(0))
    assert found.collect() == [] and recall == 1.0


def test_planted_vectors_have_every_link(spark, monkeypatch, tmp_path):
    """Vectors that lie evenly in all directions: the nearest centroids of a pair often differ."""
    monkeypatch.setattr(vector_graph, "CLUSTER", 40)
    base = np.random.default_rng(6).standard_normal((500, 64)).astype(np.float32)
    spark.createDataFrame([(i, [float(v) for v in e], i % 2) for i, e in enumerate(base)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    wide, turned = base.astype(np.float64), np.roll(base, -1, 1).astype(np.float64)
    x = np.concatenate([base, *((wide + by * turned).astype(np.float32) for by in (0.1, 0.3))]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = np.concatenate([np.arange(500) + k * 1_000_000_000 for k in range(3)]), np.tile(np.arange(500) % 2, 3)
    pairs = [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(np.triu((x @ x.T >= 0.98) & (label[:, None] == label), 1)), strict=True)]
    degree, want = Counter(v for e in pairs for v in e), classes(ids.tolist(), pairs)
    got = queries.vector_graph_planted(spark, str(tmp_path)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(i, degree[i], want[i]) for i in want} and len(pairs) > 500


def test_every_link_is_found_without_more_clusters(spark, monkeypatch):
    """An exact check in several parts finds what a blind search misses; a vector is in no more clusters for it."""
    monkeypatch.setattr(vector_graph, "CLUSTER", 40)
    monkeypatch.setattr(vector_graph, "COMPARED", 60)
    monkeypatch.setattr(vector_graph, "range_pairs", lambda *a, **k: iter(()))
    most, real = [], vector_graph._clusters
    monkeypatch.setattr(vector_graph, "_clusters", lambda *a: most.append(real(*a)) or most[-1])
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((80, 16)), 5, 0) + rng.standard_normal((400, 16)) * 0.12
    rows = [(i, [float(v) for v in np.float32(e)], i % 2) for i, e in enumerate(x)] + [(400 + i, [float(v) for v in np.float32(x[i])], i % 2) for i in range(3)]
    y = np.array([r[1] for r in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu((y @ y.T >= 0.98) & (label[:, None] == label), 1)), strict=True)]
    degree, want = Counter(v for e in pairs for v in e), classes(list(range(len(rows))), pairs)
    found, recall = vector_graph.links(vectors(spark, rows), complete=True)
    assert {tuple(r) for r in found.collect()} == {(i, degree[i], want[i]) for i in want} and len(pairs) > 100 and recall == 1
    assert len(most) == 1 and most[0].selectExpr("max(size(clusters))").first()[0] == 2
