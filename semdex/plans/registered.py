"""Queries over the supplied tables, one or more for each operator, with DuckDB SQL where there is any.

Floats are rounded to six digits on both sides, and every limit has a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunk as C
from ..operators import diff as D
from ..operators.duplicates import find_duplicates
from ..operators.embed import HashingProvider, embed_rows, hashed, hashed_entries
from ..operators.lsh import SimHash, candidates, exploded, similar_exact, verified
from ..operators.search import search, search_blocks, search_many
from ..sources.scan import BINARY_SUFFIXES, IGNORED_FOLDERS, wanted
from .corpus import FILES, VECTOR_CHUNKS, files, table, vector_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_QUERY_VECTOR = 7
_WIDTH = 64


def registered(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _vector(spark: SparkSession, sf_dir: str, of: int = _QUERY_VECTOR) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == of).select("embedding").first()[0]]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_SCORED = f"""WITH {VECTOR_CHUNKS}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {_QUERY_VECTOR}),
d AS (SELECT vc.*, list_distance(e * 1, v) AS dist FROM vc, q)""".replace("e * 1", "e")
_RESULT = "repo, file_path AS path, line_start AS line, round(greatest(0, 1 - dist / 2), 6) AS score, content AS snippet, lang"
_ORDER = "ORDER BY greatest(0, 1 - dist / 2) DESC, repo, file_path, line_start, id"


def _knn(where: str, limit: int, threshold: float = 0.0, nearest: int | None = None) -> str:
    rows = f"(SELECT * FROM d ORDER BY dist, id LIMIT {nearest})" if nearest else "d"
    return f"{_SCORED} SELECT {_RESULT} FROM {rows} WHERE ({where}) AND greatest(0, 1 - dist / 2) >= {threshold} {_ORDER} LIMIT {limit}"


@registered(_knn("true", 10, nearest=10))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search(vector_chunks(spark, sf_dir), _vector(spark, sf_dir), limit=10), "score")


@registered(_knn("true", 50, 0.34, 50))
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search(vector_chunks(spark, sf_dir), _vector(spark, sf_dir), limit=50, threshold=0.34), "score")


@registered(_knn("repo = 'repo3'", 10))
def knn_repo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search(vector_chunks(spark, sf_dir), _vector(spark, sf_dir), repo="repo3"), "score")


@registered(_knn("lang IN ('python', 'go')", 10))
def knn_lang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search(vector_chunks(spark, sf_dir), _vector(spark, sf_dir), langs=["python", "go"]), "score")


@registered(_knn("file_path GLOB 'src/m[1-3]/*.p?'", 10))
def knn_path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search(vector_chunks(spark, sf_dir), _vector(spark, sf_dir), path_glob="src/m[1-3]/*.p?"), "score")


@registered(_knn("repo = 'repo3' AND lang IN ('python', 'java') AND file_path GLOB 'src/*'", 5, 0.3))
def knn_all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search(vector_chunks(spark, sf_dir), _vector(spark, sf_dir), 5, 0.3, "repo3", ["python", "java"], "src/*"), "score")


@registered(_knn("repo = 'repo3'", 10, nearest=100))
def knn_capped_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search(vector_chunks(spark, sf_dir), _vector(spark, sf_dir), repo="repo3", candidate_cap=100), "score")


@registered(_knn("lang = 'java'", 12).replace("list_distance(e, v)", "list_distance(list_transform(e, lambda x: x * 3), v)"))
def knn_score_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far vectors: all scores are 0, so names decide."""
    far = vector_chunks(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 3))
    return _rounded(search(far, _vector(spark, sf_dir), limit=12, langs=["java"]), "score")


@registered("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query_id, vec_id AS id, list_distance(embedding::DOUBLE[], v) AS d, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(embedding::DOUBLE[], v), vec_id) AS rank FROM embeddings, q)
SELECT query_id, id, round(greatest(0, 1 - d / 2), 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def knn_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 is a query, by expressions alone."""
    return _rounded(search_many(vector_chunks(spark, sf_dir), _asked(spark, sf_dir), 5), "score")


@registered("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query_id, vec_id AS id, list_distance(embedding::DOUBLE[], v) AS d, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(embedding::DOUBLE[], v), vec_id) AS rank FROM embeddings, q)
SELECT query_id, id, round(greatest(0, 1 - d / 2), 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def knn_query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in blocks of queries and rows, for queries of any number."""
    return _rounded(search_blocks(vector_chunks(spark, sf_dir), _asked(spark, sf_dir), 5), "score")


@registered("""
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.3""")
def cosine_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_chunks(spark, sf_dir).select(F.col("id").alias("chunk_id"), "embedding")
    return _rounded(similar_exact(vectors, 0.3), "similarity")


def _lsh() -> SimHash:
    return SimHash(dim=_WIDTH)


def _planes() -> str:
    rows = ", ".join(f"({i}, [{', '.join(repr(float(x)) for x in p)}]::DOUBLE[])" for i, p in enumerate(_lsh().planes))
    return f"planes AS (SELECT * FROM (VALUES {rows}) t(i, p))"


_BANDS = f"""{_planes()}, bits AS (SELECT vec_id AS id, i // 6 AS band, i % 6 AS k, CASE WHEN list_dot_product(embedding::DOUBLE[], p) >= 0 THEN 1 ELSE 0 END AS bit FROM embeddings, planes),
bands AS (SELECT id, band, sum(bit * (1 << (7 - k)::INT))::INT AS hash FROM bits GROUP BY id, band)"""
_CANDIDATES = f"{_BANDS}, cand AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM bands a JOIN bands b ON a.band = b.band AND a.hash = b.hash AND a.id < b.id)"


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh().sign(vector_chunks(spark, sf_dir).select(F.col("id").alias("chunk_id"), "embedding"))


def _byte(hash_column: str) -> F.Column:
    return F.conv(F.hex(hash_column), 16, 10).cast("int")


@registered(f"WITH {_BANDS} SELECT id AS chunk_id, band::INT AS band_idx, hash AS band_hash FROM bands")
def simhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(_signed(spark, sf_dir)).withColumn("band_hash", _byte("band_hash"))


@registered(f"WITH {_BANDS} SELECT band::INT AS band_idx, hash AS band_hash, count(*)::BIGINT AS n FROM bands GROUP BY ALL")
def lsh_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bands(spark, sf_dir).groupBy("band_idx", "band_hash").agg(F.count(F.lit(1)).alias("n"))


@registered(f"WITH {_CANDIDATES} SELECT id_a, id_b FROM cand")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(_signed(spark, sf_dir))


def _within(where: str) -> str:
    return f"WITH {VECTOR_CHUNKS}, {_CANDIDATES} SELECT id_a, id_b FROM cand JOIN vc a ON a.id = id_a JOIN vc b ON b.id = id_b WHERE {where}"


@registered(_within("a.repo IN ('repo1', 'repo2') AND b.repo IN ('repo1', 'repo2')"))
def lsh_candidates_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_chunks(spark, sf_dir).filter(F.col("repo").isin("repo1", "repo2"))
    return candidates(_lsh().sign(rows.select(F.col("id").alias("chunk_id"), "embedding")))


@registered(_within("(a.file_path GLOB 'src/m1/*' OR a.file_path GLOB '*.py') AND (b.file_path GLOB 'src/m1/*' OR b.file_path GLOB '*.py')"))
def lsh_candidates_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.globs import matches

    rows = vector_chunks(spark, sf_dir).filter(matches(F.col("file_path"), ["src/m1/*", "*.py"]))
    return candidates(_lsh().sign(rows.select(F.col("id").alias("chunk_id"), "embedding")))


def _duplicates(threshold: float, where: str = "true", limit: int | None = None) -> str:
    return f"""WITH {VECTOR_CHUNKS}, {_CANDIDATES},
    s AS (SELECT id_a, id_b, list_cosine_similarity(a.e, b.e) AS sim, a.repo AS repo_a, b.repo AS repo_b, a.file_path AS path_a, b.file_path AS path_b
      FROM cand JOIN vc a ON a.id = id_a JOIN vc b ON b.id = id_b WHERE {where})
    SELECT id_a, id_b, round(sim, 6) AS similarity, repo_a, repo_b, path_a, path_b FROM s WHERE sim >= {threshold} ORDER BY sim DESC, id_a, id_b {f"LIMIT {limit}" if limit else ""}"""


def _found(df: DataFrame) -> DataFrame:
    names = {"repo_a": "chunk_a.repo", "repo_b": "chunk_b.repo", "path_a": "chunk_a.path", "path_b": "chunk_b.path"}
    return _rounded(df, "similarity").select("id_a", "id_b", "similarity", *[F.col(v).alias(k) for k, v in names.items()])


@registered(_duplicates(0.3))
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(find_duplicates(vector_chunks(spark, sf_dir), _lsh(), threshold=0.3, limit=None))


@registered(_duplicates(0.25, "a.repo <> b.repo OR a.file_path <> b.file_path"))
def duplicates_cross_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(find_duplicates(vector_chunks(spark, sf_dir), _lsh(), threshold=0.25, cross_file_only=True, limit=None))


@registered(_duplicates(0.25, limit=20))
def duplicates_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(find_duplicates(vector_chunks(spark, sf_dir), _lsh(), threshold=0.25, limit=20))


@registered(_duplicates(0.2, "a.repo IN ('repo1', 'repo4') AND b.repo IN ('repo1', 'repo4') AND a.file_path GLOB 'src/*' AND b.file_path GLOB 'src/*'"))
def duplicates_multi_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(find_duplicates(vector_chunks(spark, sf_dir), _lsh(), ["repo1", "repo4"], ["src/*"], threshold=0.2, limit=None))


@registered("""WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END AS e FROM embeddings)
SELECT a.id AS id_a, b.id AS id_b, round(CASE WHEN a.id % 3 = 0 OR b.id % 3 = 0 THEN 0.0 ELSE list_cosine_similarity(a.e, b.e) END, 6) AS similarity FROM v a JOIN v b ON b.id = a.id + 1""")
def cosine_zero_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the next one; a third of the vectors are zero, and have the cosine 0 with any."""
    rows = vector_chunks(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")).alias("embedding"))
    pairs = rows.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b")).join(rows.select(F.col("id").alias("id_b")), "id_b")
    return _rounded(verified(pairs, rows.withColumnRenamed("id", "chunk_id"), -1.0), "similarity")


@registered(f"""WITH {_CANDIDATES}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.3)
SELECT count(*)::BIGINT AS exact, count(c.id_a)::BIGINT AS found FROM x LEFT JOIN cand c USING (id_a, id_b)""")
def exact_lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsh_candidates(spark, sf_dir).withColumn("hit", F.lit(1))
    return cosine_pairs_exact(spark, sf_dir).join(found, ["id_a", "id_b"], "left").agg(F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"))


@registered(f"WITH {FILES} SELECT file_path, length FROM f WHERE length <= 102400 AND file_path NOT LIKE '%.dat'")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(wanted(F.col("file_path"), F.col("length"), F.col("content").cast("binary"))).select("file_path", "length")


@registered(f"WITH {FILES} SELECT file_path, CASE lower(regexp_extract(file_path, '[.]([a-zA-Z]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'yml' THEN 'yaml' ELSE 'text' END AS lang FROM f")
def detect_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_path", T.language(F.col("file_path")).alias("lang"))


#: Paths of every known ending in turn, in either case, and of some that aren't known.
_ENDINGS = [e for k in T.LANGUAGES for e in (f"main{k}", f"a/B{k.upper()}")] + ["Makefile", ".py", "a.py/b", "x.py.bak", "a.b/c.TXT"]


def _picked(values: list, at: str) -> str:
    """One of a list by a row's number, in DuckDB."""
    return f"{values}[({at} % {len(values)} + 1)::INT]"


@registered(f"SELECT doc_id, {_picked([T.LANGUAGES.get('.' + e.rsplit('.', 1)[-1].lower(), 'text') if '.' in e.rsplit('/', 1)[-1][1:] else 'text' for e in _ENDINGS], 'doc_id')} AS lang FROM documents")
def lang_by_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % len(_ENDINGS)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.language(path).alias("lang"))


#: Paths that are never scanned, whatever is in them, and some that are like them.
_UNWANTED = [f"src/a{e}" for e in BINARY_SUFFIXES] + [f"src/A{e.upper()}" for e in BINARY_SUFFIXES] + [f"{f}/a.py" for f in IGNORED_FOLDERS] + [f"src/{f}/b/a.py" for f in IGNORED_FOLDERS]
_WANTED = [f"src/a{e}.txt" for e in BINARY_SUFFIXES[:12]] + [f"{f}s/a.py" for f in IGNORED_FOLDERS] + [f"src/{f}.py" for f in IGNORED_FOLDERS] + ["a.py", "png", "src/.gitignore"]


@registered(f"SELECT doc_id, {_picked(_WANTED, 'doc_id')} AS path FROM documents WHERE strlen(text) <= 102400")
def scan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document at a path that is scanned and at one that isn't."""
    docs = table(spark, sf_dir, "documents")
    at = lambda paths: F.get(F.array(*map(F.lit, paths)), (F.col("doc_id") % len(paths)).cast("int"))
    rows = docs.withColumn("path", F.explode(F.array(at(_WANTED), at(_UNWANTED))))
    return rows.filter(wanted(F.col("path"), F.octet_length("text"), F.col("text").cast("binary"))).select("doc_id", "path")


@registered(f"WITH {FILES} SELECT CASE lower(regexp_extract(file_path, '[.]([a-zA-Z]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'yml' THEN 'yaml' ELSE 'text' END AS lang, count(*)::BIGINT AS n FROM f GROUP BY 1")
def lang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_lang(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def _windows_sql(most: int, step: int) -> str:
    return f"""WITH {FILES}, l AS (SELECT file_path, CASE WHEN content = '' OR content IS NULL THEN []::VARCHAR[] WHEN ends_with(content, chr(10)) THEN list_slice(string_split(content, chr(10)), 1, len(string_split(content, chr(10))) - 1) ELSE string_split(content, chr(10)) END AS lines FROM f),
    s AS (SELECT file_path, lines, unnest(generate_series(0, greatest(0, ceil((len(lines) - {most}) / {step}.0)::BIGINT) * {step}, {step})) AS s FROM l WHERE len(lines) > 0)
    SELECT file_path, (s + 1)::INT AS line_start, least(len(lines), s + {most})::INT AS line_end, md5(trim(array_to_string(list_slice(lines, s + 1, s + {most}), chr(10)), chr(10))) AS content FROM s"""


def _line_windows(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    out = C.chunk_files(files(spark, sf_dir).select("file_path", "content"), parser=None, most=most)
    return out.select("file_path", "line_start", "line_end", F.md5("content").alias("content"))


@registered(_windows_sql(80, 40))
def line_windows_80_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_windows(spark, sf_dir, 80)


@registered(_windows_sql(4, 2))
def line_windows_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_windows(spark, sf_dir, 4)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file cut into pieces of 1 to 13 lines, by a rule."""
    rows = files(spark, sf_dir).select("doc_id", T.lines(F.col("content")).alias("lines")).filter(F.size("lines") > 0)
    size = F.col("doc_id") % 5 + 1
    starts = F.sequence(F.lit(0), F.size("lines") - 1, size.cast("int"))
    piece = lambda s: C._segment(s + 1, F.least(F.size("lines"), s + size), T.joined(F.slice("lines", s + 1, size.cast("int"))))
    return rows.withColumn("segments", F.transform(starts, piece))


@registered(f"""WITH RECURSIVE {FILES}, l AS (SELECT doc_id, (CASE WHEN ends_with(content, chr(10)) THEN len(string_split(content, chr(10))) - 1 ELSE len(string_split(content, chr(10))) END)::INT AS n, (doc_id % 5 + 1)::INT AS size FROM f WHERE content <> ''),
p AS (SELECT doc_id, ((n - 1) // size + 1)::INT AS pieces, n, size FROM l),
r AS (SELECT doc_id, n, size, pieces, 2 AS i, 1 AS bs, least(n, size)::INT AS be, []::STRUCT(s INT, e INT)[] AS done FROM p
  UNION ALL SELECT doc_id, n, size, pieces, i + 1,
    CASE WHEN be - bs + 1 < 4 THEN bs ELSE (i - 1) * size + 1 END, least(n, i * size)::INT,
    CASE WHEN be - bs + 1 < 4 THEN done ELSE list_append(done, {{'s': bs, 'e': be}}) END FROM r WHERE i <= pieces),
e AS (SELECT doc_id, CASE WHEN len(done) > 0 AND be - bs + 1 < 4 THEN list_append(list_slice(done, 1, len(done) - 1), {{'s': done[-1].s, 'e': be}}) ELSE list_append(done, {{'s': bs, 'e': be}}) END AS segs FROM r WHERE i = pieces + 1),
x AS (SELECT doc_id, unnest(list_transform(segs, lambda x: x.s)) AS line_start, unnest(list_transform(segs, lambda x: x.e)) AS line_end FROM e),
t AS (SELECT doc_id, string_split(content, chr(10)) AS lines, (doc_id % 5 + 1)::INT AS size FROM f),
m AS (SELECT doc_id, line_start, line_end, list_transform(generate_series((line_start - 1) // size, (line_end - 1) // size), lambda k: trim(array_to_string(list_slice(lines, k * size + 1, least(line_end, (k + 1) * size)), chr(10)), chr(10))) AS pieces FROM x JOIN t USING (doc_id))
SELECT doc_id, line_start, line_end, md5(trim(array_to_string(list_filter(pieces, lambda p: p <> ''), chr(10)), chr(10))) AS content FROM m""")
def merge_small_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _segments(spark, sf_dir).select("doc_id", F.explode(C.merge_small(F.col("segments"), 4)).alias("s"))
    return merged.select("doc_id", "s.line_start", "s.line_end", F.md5("s.content").alias("content"))


_IMPORTING = ("import a", "from b import (", "  c,", ")", "", "x = 1", "import late")


@registered("SELECT doc_id, (doc_id % 8)::INT AS blanks, (doc_id % 8 + 5)::INT AS line_end FROM documents")
def import_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file gets leading blank lines and an import block; a block counts from line 1."""
    return _import_blocks(spark, sf_dir).select("doc_id", (F.col("doc_id") % 8).cast("int").alias("blanks"), F.col("block.line_end").alias("line_end"))


def _import_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines, block): each file's own lines after those put before them, and the block found."""
    own = F.coalesce(T.lines(F.col("content")), F.array().cast("array<string>"))
    put = F.concat(F.array_repeat(F.lit(""), (F.col("doc_id") % 8).cast("int")), F.array(*map(F.lit, _IMPORTING)), own)
    rows = files(spark, sf_dir).select("doc_id", put.alias("lines"))
    return rows.withColumn("block", C.import_block(F.col("lines"), F.lit("python")))


@registered("""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS w FROM documents),
h AS (SELECT doc_id, md5(w) AS h FROM w),
b AS (SELECT doc_id, (((instr('0123456789abcdef', h[1]) - 1) * 16 + instr('0123456789abcdef', h[2]) - 1) % 64)::INT AS bucket, CASE WHEN instr('0123456789abcdef', h[3]) <= 8 THEN 1.0 ELSE -1.0 END AS v FROM h)
SELECT doc_id, bucket, sum(v)::DOUBLE AS v FROM b GROUP BY ALL HAVING sum(v) <> 0""".replace("\x0b", "\\x0b").replace("\f", "\\f").replace("\t", "\\t").replace("\n\\x0b", "\\n\\x0b").replace("\r]", "\\r]"))
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_entries(files(spark, sf_dir), "doc_id")


def _text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all documents with their unit vectors of hashed words."""
    rows = files(spark, sf_dir).select("doc_id", "repo", "file_path", "content")
    out = C.chunk_files(rows, parser=None).withColumn("id", F.col("doc_id") * 1_000_000 + F.col("line_start"))
    out = embed_rows(out, HashingProvider(), "id").withColumnRenamed("embedding", "_e")
    size = V.norm(F.col("_e"))
    return out.withColumn("_n", size).withColumn("embedding", F.transform("_e", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x))).drop("_e", "_n")


#: The same in DuckDB: tc, and q, the queries.
_HASHED = """{name}w AS (SELECT id, unnest(list_filter(regexp_split_to_array(content, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS w FROM {rows}),
{name}b AS (SELECT id, ((instr('0123456789abcdef', md5(w)[1]) - 1) * 16 + instr('0123456789abcdef', md5(w)[2]) - 1) % 64 AS i, sum(CASE WHEN instr('0123456789abcdef', md5(w)[3]) <= 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM {name}w GROUP BY ALL),
{name}n AS (SELECT id, sqrt(sum(v * v)) AS n FROM {name}b GROUP BY 1),
{name} AS (SELECT r.id, list(coalesce(v, 0.0) / (CASE WHEN coalesce(n, 0) > 0 THEN n ELSE 1 END) ORDER BY g.i) AS e FROM {rows} r CROSS JOIN range(64) g(i) LEFT JOIN {name}b b ON b.id = r.id AND b.i = g.i LEFT JOIN {name}n k ON k.id = r.id GROUP BY r.id)"""
_TEXT_CHUNKS = f"""{_windows_sql(80, 40).split("SELECT file_path, (s + 1)")[0].rstrip()},
c AS (SELECT f.doc_id * 1000000 + s + 1 AS id, f.repo, s.file_path, (s + 1)::INT AS line_start, trim(array_to_string(list_slice(lines, s + 1, s + 80), chr(10)), chr(10)) AS content FROM s JOIN f USING (file_path)),
{_HASHED.format(name="tc", rows="c")}"""


@registered(f"""{_TEXT_CHUNKS}, items AS (SELECT item_id AS id, text AS content FROM benchmark WHERE item_id % 50 = 0), {_HASHED.format(name="q", rows="items")},
d AS (SELECT q.id AS query_id, c.*, list_distance(tc.e, q.e) AS dist FROM c JOIN tc USING (id), q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rank FROM d)
SELECT query_id, rank::INT AS rank, repo, file_path AS path, line_start AS line, round(greatest(0, 1 - dist / 2), 6) AS score, content AS snippet,
  CASE lower(regexp_extract(file_path, '[.]([a-zA-Z]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'yml' THEN 'yaml' ELSE 'text' END AS lang FROM r WHERE rank <= 10""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item whose id is divisible by 50 as a query, over all chunks of all documents."""
    chunks, e = _text_chunks(spark, sf_dir), F.col("e")
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), hashed(F.col("text")).alias("e"))
    asked = asked.select("query_id", F.when(V.norm(e) > 0, F.transform(e, lambda x: x / V.norm(e))).otherwise(e).alias("query"))
    records = chunks.select("id", "repo", F.col("file_path").alias("path"), F.col("line_start").alias("line"), F.col("content").alias("snippet"), F.coalesce("lang", F.lit("")).alias("lang"))
    found = search_blocks(chunks, asked, 10).join(records, "id")
    return _rounded(found, "score").select("query_id", "rank", "repo", "path", "line", "score", "snippet", "lang")


@registered(f"""{_TEXT_CHUNKS}, p AS (SELECT a.id AS id_a, b.id AS id_b, list_dot_product(a.e, b.e) AS sim FROM tc a JOIN tc b ON a.id < b.id WHERE list_dot_product(a.e, b.e) >= 0.95)
SELECT id_a, id_b, round(sim, 6) AS similarity, a.repo AS repo_a, b.repo AS repo_b, a.file_path AS path_a, b.file_path AS path_b FROM p JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE a.file_path <> b.file_path""")
def text_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate chunks of real text, at the reference library's threshold.

    At a cosine of 0.95 a sign bit agrees with a chance of 1 - acos(0.95) / pi = 0.899, a band of 12
    bits with 0.278, so a pair misses all 32 bands with a chance of 3 in 100,000. All vectors are
    compared, so that no such pair is lost. Chunks are written first, without their texts, as they are
    counted and read.
    """
    from .stored import scratch  # which imports this module

    at = scratch(spark, "text-chunks")
    _text_chunks(spark, sf_dir).select("id", "repo", "file_path", "embedding").write.parquet(at)
    found = find_duplicates(spark.read.parquet(at), SimHash(32, 12, _WIDTH), cross_file_only=True, threshold=0.95, limit=None, complete=True, places_only=True)
    return _found(found)


_DIFF = f"""WITH {FILES}, idx AS (
  SELECT file_path, CASE WHEN doc_id % 5 = 1 THEN mtime + 1 ELSE mtime END AS mtime FROM f WHERE doc_id % 5 <> 0
  UNION ALL SELECT 'gone/' || doc_id, mtime FROM f WHERE doc_id % 7 = 0),
d AS (SELECT coalesce(f.file_path, idx.file_path) AS file_path, CASE WHEN idx.file_path IS NULL THEN 'new' WHEN f.file_path IS NULL THEN 'removed' WHEN abs(f.mtime - idx.mtime) > 1e-9 THEN 'changed' ELSE 'unchanged' END AS status
  FROM f FULL JOIN idx ON f.file_path = idx.file_path)"""


@registered(f"{_DIFF} SELECT * FROM d")
def file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = files(spark, sf_dir).select("doc_id", "file_path", "mtime")
    then = now.filter("doc_id % 5 <> 0").select("file_path", F.when(F.col("doc_id") % 5 == 1, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"))
    then = then.union(now.filter("doc_id % 7 = 0").select(F.concat(F.lit("gone/"), "doc_id"), "mtime"))
    return D.diff_files(now, then)


@registered(f"{_DIFF} SELECT file_path FROM d WHERE status IN ('new', 'changed')")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_diff(spark, sf_dir).filter(F.col("status").isin("new", "changed")).select("file_path")


@registered(f"{_DIFF} SELECT file_path FROM d WHERE status = 'removed'")
def removed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_diff(spark, sf_dir).filter("status = 'removed'").select("file_path")


@registered(f"WITH {VECTOR_CHUNKS} SELECT file_path, max(id)::DOUBLE AS mtime FROM vc GROUP BY 1")
def indexed_mtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.indexed_files(vector_chunks(spark, sf_dir).withColumn("file_mtime", F.col("id").cast("double")))


@registered(f"WITH {VECTOR_CHUNKS} SELECT id, repo, file_path FROM vc WHERE NOT (repo = 'repo1' AND file_path LIKE 'src/m1/%')")
def delete_chunks_for_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_chunks(spark, sf_dir).select("id", "repo", "file_path")
    return D.without_files(rows, rows.filter((F.col("repo") == "repo1") & F.col("file_path").like("src/m1/%")), ("repo", "file_path")).select("id", "repo", "file_path")


@registered(f"WITH {VECTOR_CHUNKS} SELECT id, repo FROM vc WHERE repo <> 'repo2'")
def remove_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_chunks(spark, sf_dir).select("id", "repo")
    return D.without_files(rows, rows.filter("repo = 'repo2'"), ("repo",)).select("id", "repo")


@registered(f"WITH {VECTOR_CHUNKS} SELECT repo, count(DISTINCT file_path)::BIGINT AS file_count, count(*)::BIGINT AS chunk_count FROM vc GROUP BY 1")
def repo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.repo_stats(vector_chunks(spark, sf_dir), "repo")


@registered(f"WITH {VECTOR_CHUNKS} SELECT count(*) > 0 AS has_chunks, count(DISTINCT repo)::BIGINT AS repos FROM vc")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_stats(spark, sf_dir).agg(F.coalesce(F.bool_or(F.col("chunk_count") > 0), F.lit(False)).alias("has_chunks"), F.count(F.lit(1)).alias("repos"))


@registered(f"WITH {VECTOR_CHUNKS} SELECT DISTINCT file_path FROM vc WHERE repo = 'repo1'")
def repo_file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_chunks(spark, sf_dir).filter("repo = 'repo1'").select("file_path").distinct()


@registered("""WITH r AS (SELECT n_name AS name, '/w/' || n_nationkey AS path FROM nation UNION ALL SELECT r_name, '/w/7/' || CASE r_regionkey WHEN 2 THEN 'sub' ELSE 's' || r_regionkey END FROM region)
SELECT arg_max(name, length(path)) AS name, 'dir/*' AS glob FROM r WHERE starts_with('/w/7/sub/dir', path || '/')""")
def repo_from_cwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("/w/"), "n_nationkey").alias("path"))
    below = F.when(F.col("r_regionkey") == 2, F.lit("sub")).otherwise(F.concat(F.lit("s"), "r_regionkey"))
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("/w/7/"), below).alias("path"))
    return D.repo_at(nations.union(regions), "/w/7/sub/dir")


@registered("SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1")
def meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("version"))
    return D.upsert(rows).select("key", "value")


@registered(f"WITH {VECTOR_CHUNKS} SELECT repo, file_path, line_start, 100 + row_number() OVER (ORDER BY repo, file_path, line_start) AS id FROM vc")
def chunk_id_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.assign_ids(vector_chunks(spark, sf_dir).drop("id"), 100, ("repo", "file_path")).select("repo", "file_path", "line_start", "id")


@registered(_knn("true", 10, nearest=10).replace(_RESULT, "printf('%s:%s:%d  %.2f', repo, file_path, line_start, greatest(0, 1 - dist / 2)) AS line"))
def render_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(vector_chunks(spark, sf_dir), _vector(spark, sf_dir), limit=10)
    return found.select(T.compact(F.col("repo"), F.col("path"), F.col("line"), F.col("score")).alias("line"))


@registered("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, md5(string_agg(printf('%4d | %s', i + 4, line), chr(10) ORDER BY i)) AS block FROM l GROUP BY doc_id""")
def render_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", F.md5(T.numbered(F.col("content"), F.lit(5))).alias("block"))


@registered(f"WITH {VECTOR_CHUNKS}, r AS (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY id DESC) AS k FROM vc) SELECT repo, id FROM r WHERE k <= 3")
def latest_chunks_per_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_chunks(spark, sf_dir).select("repo", "id", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("id").desc())).alias("k"))
    return rows.filter("k <= 3").select("repo", "id")
