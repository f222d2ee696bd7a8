"""Queries over a stored index and over files on disk: what the store, the scan and the indexing run do.

The index holds the supplied vectors as chunks of three repositories; files are the supplied documents.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SemdexError
from ..operators import diff as D
from ..operators.chunk import chunk_files, readable
from ..operators.embed import HashingProvider, Provider
from ..operators.lsh import SimHash, exploded
from ..sources.scan import scan_files
from ..sources.store import Store
from .corpus import FILES, files, table, vector_chunks
from .index import index_duplicates, index_repo, search_index
from .registered import _BANDS, _QUERY_VECTOR, _WIDTH, _byte, _planes, _rounded, _vector, _windows_sql, registered

REPOS = (1, 2, 3)
#: The index in DuckDB.
_S = """s AS (SELECT vec_id AS id, label % 3 + 1 AS repo_id, 'repo' || (label % 3 + 1) AS repo, 'src/m' || (vec_id % 7) || '/f' || (vec_id % 50) || '.' || ['py', 'java', 'go', 'txt'][(vec_id % 4 + 1)::INT] AS file_path,
  vec_id::INT AS line_start, 'chunk ' || vec_id AS content, ['python', 'java', 'go', 'text'][(vec_id % 4 + 1)::INT] AS lang, embedding::DOUBLE[] AS e FROM embeddings)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's place: below spark.checkpoint.dir if that is set, else of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="semdex-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, scratch(spark, "index"))
    registry = spark.createDataFrame([(i, f"repo{i}", f"/w/{i}", None) for i in REPOS], "id long, name string, path string, indexed_at timestamp")
    rows = vector_chunks(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3 + 1).cast("long").alias("repo_id")), "id")
    rows = rows.withColumn("file_mtime", F.col("id").cast("double"))
    lsh = SimHash(dim=_WIDTH)
    signed = exploded(lsh.sign(rows.select(F.col("id").alias("chunk_id"), "embedding")))
    parts = {}
    for i in REPOS:
        own = rows.filter(F.col("repo_id") == i)
        vectors = own.select(F.col("id").alias("chunk_id"), "repo_id", "embedding")
        parts[i] = {"chunks": own, "vectors": vectors, "bands": signed.join(vectors.select("chunk_id", "repo_id"), "chunk_id")}
    store.commit(store.lsh_meta(lsh) | {"highest_repo": str(REPOS[-1])}, registry, parts)
    return store


_SHARED: dict[tuple[str, str], Store] = {}


def shared(spark: SparkSession, sf_dir: str) -> Store:
    """One such index for all queries of a session that only read it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _SHARED:
        _SHARED[key] = stored(spark, sf_dir)
    return _SHARED[key]


class Fixed(Provider):
    """Gives one vector for any text."""

    def __init__(self, vector: list[float]):
        self.vector = vector

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.vector for _ in texts]


def _search_sql(where: str, limit: int, threshold: float = 0.0) -> str:
    rows = f"(SELECT * FROM d ORDER BY dist, id LIMIT {limit})" if where == "true" else "d"
    return f"""WITH {_S}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {_QUERY_VECTOR}), d AS (SELECT s.*, list_distance(e, v) AS dist FROM s, q)
    SELECT repo, file_path AS path, line_start AS line, round(greatest(0, 1 - dist / 2), 6) AS score, content AS snippet, lang FROM {rows} WHERE ({where}) AND greatest(0, 1 - dist / 2) >= {threshold}
    ORDER BY greatest(0, 1 - dist / 2) DESC, repo, file_path, line_start, id LIMIT {limit}"""


@registered(_search_sql("true", 25))
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors are found before places and texts are joined."""
    return _rounded(search_index(shared(spark, sf_dir), Fixed(_vector(spark, sf_dir)), "any", 25), "score")


@registered(_search_sql("repo = 'repo2' AND lang IN ('go', 'python') AND file_path GLOB 'src/m[0-4]/*'", 15, 0.25))
def index_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search_index(shared(spark, sf_dir), Fixed(_vector(spark, sf_dir)), "any", 15, 0.25, "/w/2", ["go", "python"], "src/m[0-4]/*"), "score")


def _pairs_sql(threshold: float, where: str = "true") -> str:
    return f"""WITH {_S}, {_BANDS}, cand AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM bands a JOIN bands b ON a.band = b.band AND a.hash = b.hash AND a.id < b.id),
    p AS (SELECT id_a, id_b, list_cosine_similarity(a.e, b.e) AS sim, a.repo AS repo_a, b.repo AS repo_b, a.content AS text_a, b.content AS text_b FROM cand JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b WHERE {where})
    SELECT id_a, id_b, round(sim, 6) AS similarity, repo_a, repo_b, text_a, text_b FROM p WHERE sim >= {threshold}"""


def _pairs(df: DataFrame) -> DataFrame:
    names = {"repo_a": "chunk_a.repo", "repo_b": "chunk_b.repo", "text_a": "chunk_a.snippet", "text_b": "chunk_b.snippet"}
    return _rounded(df, "similarity").select("id_a", "id_b", "similarity", *[F.col(v).alias(k) for k, v in names.items()])


@registered(_pairs_sql(0.25))
def index_duplicates_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored signatures, verified in blocks; texts join the pairs that are left."""
    return _pairs(index_duplicates(shared(spark, sf_dir), threshold=0.25, limit=None))


@registered(_pairs_sql(0.2, "a.repo = 'repo3' AND b.repo = 'repo3' AND a.file_path GLOB '*.go' AND b.file_path GLOB '*.go'"))
def index_duplicates_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(index_duplicates(shared(spark, sf_dir), ["repo3"], ["*.go"], threshold=0.2, limit=None))


@registered(f"""WITH {_S} SELECT repo_id AS id, repo AS name, '/w/' || repo_id AS path, count(DISTINCT file_path)::BIGINT AS file_count, count(*)::BIGINT AS chunk_count, (row_number() OVER (ORDER BY repo))::INT AS place FROM s GROUP BY repo_id, repo""")
def store_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry in order of names, with counts that are worked out from the chunks."""
    rows = [(*r, i + 1) for i, r in enumerate(shared(spark, sf_dir).repos().select("id", "name", "path", "file_count", "chunk_count").collect())]  # a row for each repository
    return spark.createDataFrame(rows, "id long, name string, path string, file_count long, chunk_count long, place int")


def _left(store: Store) -> DataFrame:
    """What the parted tables hold."""
    ids = [store.table(n).select(F.lit(n).alias("of"), "repo_id", F.col("id" if n == "chunks" else "chunk_id").alias("id")) for n in ("chunks", "vectors", "bands")]
    return ids[0].union(ids[1]).union(ids[2]).groupBy("of", "repo_id", "id").agg(F.count(F.lit(1)).alias("n"))


def _left_sql(where: str, bands: str = "true") -> str:
    return f"""WITH {_S} SELECT t.of, repo_id, id, t.n FROM s, (VALUES ('chunks', 1::BIGINT), ('vectors', 1), ('bands', 12)) t(of, n) WHERE ({where}) AND (t.of <> 'bands' OR {bands})"""


@registered(_left_sql("repo_id <> 2"))
def store_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository goes with all that is indexed of it; no part of another is read or written."""
    store = stored(spark, sf_dir)
    store.remove_repo("repo2")
    return _left(store)


@registered(_left_sql("true", "false"))
def store_clear_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stored(spark, sf_dir)
    store.clear_bands()
    return _left(store)


@registered(_left_sql("NOT (repo_id = 1 AND file_path LIKE 'src/m3/%')"))
def store_delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of files go, and vectors and signatures whose chunks are gone."""
    store = stored(spark, sf_dir)
    chunks = store.table("chunks", 1)
    kept = D.without_files(chunks, chunks.filter("file_path LIKE 'src/m3/%'"))
    ids = kept.select(F.col("id").alias("chunk_id"))
    store.commit(None, parts={1: {"chunks": kept, **{n: store.table(n, 1).join(ids, "chunk_id", "left_semi") for n in ("vectors", "bands")}}})
    return _left(store)


@registered(f"WITH {_S}, {_BANDS} SELECT b.id AS chunk_id, repo_id, band::INT AS band_idx, hash AS band_hash FROM bands b JOIN s USING (id) WHERE repo_id = 3")
def store_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir).table("bands", 3).withColumn("band_hash", _byte("band_hash"))


@registered(f"WITH {_S} SELECT DISTINCT file_path FROM s WHERE repo_id = 1")
def store_file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir).file_paths(1)


@registered(f"WITH {_S} SELECT file_path, max(id)::DOUBLE AS mtime FROM s WHERE repo_id = 2 GROUP BY 1")
def store_indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir).indexed_files(2)


@registered("SELECT vec_id AS chunk_id, i::INT AS i, (embedding[i] * 1.1::DOUBLE)::FLOAT::DOUBLE AS v FROM embeddings, range(1, 65) r(i)")
def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are kept in single precision, whatever they come in."""
    store = stored(spark, sf_dir)
    wide = {i: {"vectors": store.table("vectors", i).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 1.1))} for i in REPOS}
    store.commit(parts=wide)
    rows = store.table("vectors").select("chunk_id", F.posexplode("embedding").alias("i", "v"))
    return rows.select("chunk_id", (F.col("i") + 1).alias("i"), F.col("v").cast("double").alias("v"))


@registered("""SELECT * FROM (VALUES ('repos', 'id bigint, name string, path string, indexed_at timestamp', 0::BIGINT), ('chunks', 'id bigint, repo_id bigint, file_path string, line_start int, line_end int, content string, lang string, file_mtime double', 0),
 ('vectors', 'chunk_id bigint, repo_id bigint, embedding array<float>', 0), ('bands', 'chunk_id bigint, repo_id bigint, band_idx int, band_hash binary', 0)) t(name, columns, n)""")
def store_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that holds nothing has all tables."""
    store = Store(spark, scratch(spark, "index"))
    rows = [(n, ", ".join(f"{c} {kind}" for c, kind in store.table(n).dtypes), store.table(n).count()) for n in ("repos", "chunks", "vectors", "bands")]
    return spark.createDataFrame(rows, "name string, columns string, n long")


@registered("""SELECT * FROM (VALUES ('first', 'b', 'new'), ('second', 'c', 'c'), ('absent', NULL, NULL)) t(key, first, last)""")
def store_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark, "index"))
    store.set_meta("first", "a")
    store.set_meta("first", "b")
    store.set_meta("second", "c")
    before = store.all_meta()
    store.set_meta("first", "new")
    return spark.createDataFrame([(k, before.get(k), store.get_meta(k)) for k in ("first", "second", "absent")], "key string, first string, last string")


@registered("""SELECT * FROM (VALUES ('repo2', 2::BIGINT), (' repo2 ', 2), ('/w/3', 3), ('/w/x/../3', 3), ('repo9', -1), ('/w', -1), ('REPO2', -1), ('added', 4), ('taken name', -1), ('taken path', -1)) t(asked, id)""")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories are found by name or path (-1: not); neither can be registered twice."""
    store = stored(spark, sf_dir)
    found = [(x, (store.find_repo(x) or {"id": -1})["id"]) for x in ("repo2", " repo2 ", "/w/3", "/w/x/../3", "repo9", "/w", "REPO2")]
    found.append(("added", store.add_repo("other", "/w/4")))
    for what, args in (("taken name", ("repo1", "/else")), ("taken path", ("else", "/w/1"))):
        try:
            found.append((what, store.add_repo(*args)))
        except SemdexError:
            found.append((what, -1))
    return spark.createDataFrame(found, "asked string, id long")


@registered(f"""WITH {_S} SELECT c AS asked, CASE WHEN c LIKE 'no %' THEN '0 rows' ELSE 'refused' END AS got FROM (VALUES ('no limit'), ('no languages that fit'), ('no repositories to compare'), ('no globs to compare'), ('wide query'), ('blank query'), ('unknown repository'), ('wide vectors'), ('wide index run'), ('flat vectors'), ('broken manifest')) t(c)""")
def store_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has no answer gives no rows; what can't be right is refused."""
    store, vector = shared(spark, sf_dir), _vector(spark, sf_dir)
    lsh, wide = store.lsh(), Fixed([0.5] * (_WIDTH + 1))
    broken = Store(spark, scratch(spark, "index"))
    broken.set_meta("a", "b")
    broken._folder.write("MANIFEST.json", "{")
    cases = {
        "no limit": lambda: search_index(store, Fixed(vector), "any", 0).count(),
        "no languages that fit": lambda: search_index(store, Fixed(vector), "any", langs=["cobol"]).count(),
        "no repositories to compare": lambda: index_duplicates(store, [], threshold=0.2).count(),
        "no globs to compare": lambda: index_duplicates(store, None, [], threshold=0.2).count(),
        "wide query": lambda: search_index(store, wide, "any").count(),
        "blank query": lambda: search_index(store, Fixed(vector), " \t ").count(),
        "unknown repository": lambda: search_index(store, Fixed(vector), "any", repo="none").count(),
        "wide vectors": lambda: lsh.bands(np.zeros((1, _WIDTH + 1))),
        "wide index run": lambda: index_repo(store, 1, tempfile.mkdtemp(), wide),
        "flat vectors": lambda: lsh.bands(np.zeros(_WIDTH)),
        "broken manifest": lambda: broken.table("chunks"),
    }
    out = []
    for name, run in cases.items():
        try:
            out.append((name, f"{run()} rows"))
        except (SemdexError, ValueError):
            out.append((name, "refused"))
    return spark.createDataFrame(out, "asked string, got string")


@registered(f"WITH {_planes()} SELECT i::INT AS plane, k::INT AS k, p[k] AS v FROM planes, range(1, 65) r(k)")
def lsh_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperplanes after a way through bytes, and through the store's meta."""
    planes = SimHash.planes_from(SimHash(dim=_WIDTH).to_bytes())
    kept = shared(spark, sf_dir).lsh().planes
    rows = [(i, k + 1, float(v)) for i, p in enumerate(planes) for k, v in enumerate(p) if kept[i, k] == v]  # bands times bits times width
    return spark.createDataFrame(rows, "plane int, k int, v double")


# --- files on disk -----------------------------------------------------------------------------

_TREE = """t AS (SELECT doc_id, text, CASE doc_id % 9 WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'src/build/' WHEN 3 THEN 'a b/' WHEN 4 THEN 'src/.git/' WHEN 5 THEN 'buildings/' ELSE 'src/' END || doc_id || ['.py', '.PNG', '.md', '.sqlite3', '', '.go', '.yml'][(doc_id % 7 + 1)::INT] AS file_path,
  strlen(text) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS length FROM documents),
scanned AS (SELECT * FROM t WHERE doc_id % 9 NOT IN (1, 2, 4) AND doc_id % 7 NOT IN (1, 3) AND length <= 102400 AND doc_id % 11 <> 0)"""


def tree(spark: SparkSession, sf_dir: str) -> Path:
    """Every document as a file of a new folder: some in ignored folders, of binary endings, or with a NUL byte."""
    root = scratch(spark, "tree").removeprefix("file:")
    folder = F.element_at(F.create_map(*[F.lit(x) for kv in {1: "node_modules/", 2: "src/build/", 3: "a b/", 4: "src/.git/", 5: "buildings/"}.items() for x in kv]), (F.col("doc_id") % 9).cast("int"))
    ending = F.get(F.array(*map(F.lit, (".py", ".PNG", ".md", ".sqlite3", "", ".go", ".yml"))), (F.col("doc_id") % 7).cast("int"))
    nul = F.when(F.col("doc_id") % 11 == 0, F.lit(b"\x00")).otherwise(F.lit(b""))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.coalesce(folder, F.lit("src/")), "doc_id", ending).alias("path"), F.concat(nul, F.coalesce("text", F.lit("")).cast("binary")).alias("content"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if (folder := os.path.dirname(path)) not in made:
                    os.makedirs(f"{root}/{folder}", exist_ok=True)
                    made.add(folder)
                with open(f"{root}/{path}", "wb") as file:
                    file.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.mapInArrow(put, "n long").agg(F.sum("n")).collect()
    return Path(root)


@registered(f"WITH {_TREE} SELECT file_path, length::BIGINT AS length, md5(text) AS content FROM scanned")
def scan_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder without version control: all files but ignored folders, binary endings, long files and files with a NUL byte."""
    return scan_files(spark, tree(spark, sf_dir)).select("file_path", "length", F.md5("content").alias("content"))


#: Fixed value: git's name of an empty file.
_NO_CONTENT = b"e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


@registered(f"WITH {_TREE} SELECT file_path, length::BIGINT AS length FROM scanned WHERE doc_id % 2 = 0")
def scan_git(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a git working tree, tracked files only, by the same filter."""
    root = tree(spark, sf_dir)
    names = (os.path.relpath(os.path.join(folder, n), root) for folder, _, found in os.walk(root) for n in found)
    even = sorted(os.fsencode(n) for n in names if ".git" not in n.split("/") and int(os.path.basename(n).split(".")[0]) % 2 == 0)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    # as git add -N lists them, which compares each file with each name that it gets
    entries = b"".join(b"100644 %s\t%s\0" % (_NO_CONTENT, n) for n in even)
    subprocess.run(["git", "-C", str(root), "update-index", "-z", "--index-info"], input=entries, check=True)
    return scan_files(spark, root).select("file_path", "length")


@registered("SELECT doc_id, doc_id % 13 <> 0 AS is_text, CASE WHEN doc_id % 13 <> 0 THEN md5('x' || chr(10) || 'y' || chr(10) || replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS content FROM documents")
def read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that aren't UTF-8 are set apart; all ways to end a line become one."""
    odd = F.when(F.col("doc_id") % 13 == 0, F.lit(b"\xc3\x28")).otherwise(F.lit(b"x\r\ny\r"))
    good, bad = readable(table(spark, sf_dir, "documents").select("doc_id", F.concat(odd, F.coalesce("text", F.lit("")).cast("binary")).alias("content")))
    return good.select("doc_id", F.lit(True).alias("is_text"), F.md5("content").alias("content")).union(bad.select("doc_id", F.lit(False), F.lit(None).cast("string")))


_INDEXED = _windows_sql(80, 40).replace(f"WITH {FILES}, l AS", "l AS").replace("FROM f),", "FROM kept),", 1)


@registered(f"""WITH {_TREE}, kept AS (SELECT file_path, text AS content FROM scanned WHERE doc_id % 5 <> 4), {_INDEXED.split("SELECT file_path, (s + 1)")[0].rstrip()},
n AS (SELECT file_path, count(*)::BIGINT AS chunks FROM s GROUP BY 1)
SELECT n.file_path, chunks, doc_id % 5 = 1 AS anew, true AS indexed FROM n JOIN scanned USING (file_path)""")
def index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run, then one after some files were touched and some removed: only what changed is done again."""
    root, store, provider = tree(spark, sf_dir), Store(spark, scratch(spark, "index")), HashingProvider()
    repo, other = store.add_repo("files", str(root)), store.add_repo("other", "/w/other")
    index_repo(store, repo, root, provider, parser=None)
    highest = int(store.get_meta("highest_chunk"))
    for p in (p for p in root.rglob("*") if p.is_file()):
        n = int(p.name.split(".")[0])
        if n % 5 == 1:
            os.utime(p, (n, n))
        elif n % 5 == 4:
            p.unlink()
    index_repo(store, repo, root, provider, parser=None)
    indexed = store.repos().select(F.col("id").alias("repo_id"), (F.col("indexed_at").isNotNull() & (F.col("id") != other)).alias("indexed"))
    chunks = store.table("chunks").join(store.table("vectors").select(F.col("chunk_id").alias("id")), "id").join(indexed, "repo_id")
    return chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"), F.bool_and(F.col("id") > highest).alias("anew"), F.bool_and("indexed").alias("indexed"))


#: Each document's lines as Python functions of 20 lines, after an import block: the function and the place of each line.
_CODE = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, max(i) AS last FROM l GROUP BY 1),
code AS (SELECT doc_id, (i // 19)::BIGINT AS f, 6 + 20 * (i // 19) + i % 19 AS line, '    x = ''' || md5(x) || '''' AS x FROM l UNION ALL SELECT DISTINCT doc_id, (i // 19)::BIGINT, 5 + 20 * (i // 19), 'def f' || (i // 19)::BIGINT || '():' FROM l)"""


@registered(f"""WITH {_CODE}, pieces AS (SELECT *, CASE WHEN f > 0 AND f = last // 19 AND last % 19 + 2 < 10 THEN f - 1 ELSE f END AS piece FROM code JOIN n USING (doc_id))
SELECT doc_id, CASE WHEN piece = 0 THEN 1 ELSE min(line) END::INT AS line_start, max(line)::INT AS line_end, md5(CASE WHEN piece = 0 THEN 'import os' || chr(10) || 'from re import sub' || chr(10) ELSE '' END || string_agg(x, chr(10) ORDER BY line)) AS content, 'python' AS lang FROM pieces GROUP BY doc_id, piece""")
def syntax_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece for each function; a small last one joins the one before; imports join the first."""
    body = F.transform(F.split("content", "\n"), lambda x: F.concat(F.lit("    x = '"), F.md5(x), F.lit("'")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("body") - 1) / 19).cast("int")), lambda f: F.concat(F.array(F.concat(F.lit("def f"), f, F.lit("():"))), F.slice("body", f * 19 + 1, 19)))
    rows = files(spark, sf_dir).filter("content IS NOT NULL").select("doc_id", body.alias("body")).select("doc_id", F.concat(F.array(*map(F.lit, ("import os", "from re import sub", "", ""))), F.flatten(blocks)).alias("lines"))
    rows = rows.select("doc_id", F.concat("doc_id", F.lit(".py")).alias("file_path"), F.array_join("lines", "\n").alias("content"))
    return chunk_files(rows).select("doc_id", "line_start", "line_end", F.md5("content").alias("content"), "lang")
