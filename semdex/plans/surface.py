"""Queries over what users and tools meet: embedding providers, excerpts, renderings, configuration, commands, the tool server."""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli, render
from ..errors import SemdexError
from ..operators.chunk import chunk_files
from ..operators.context import as_blocks, with_context
from ..operators.duplicates import find_duplicates
from ..operators.embed import HASH_WIDTH, OnnxProvider, Provider, create_provider, embed_column, pooled
from ..operators.search import search
from ..rpc import Server, read_message
from ..sources.config import API_KEY_VARIABLE, KEYS, Config, Embedding
from .corpus import files, table, vector_chunks
from .index import search_index, search_index_all
from .registered import ORACLES, _duplicates, _knn, _lsh, _rounded, _vector, _windows_sql, registered
from .stored import _S, Fixed, _search_sql, scratch, shared, stored

_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


# --- embedding ---------------------------------------------------------------------------------


@registered(ORACLES["hash_embed"])
def embed_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider that the configuration names, over a column, a batch at a time."""
    rows = embed_column(files(spark, sf_dir).select("doc_id", "content"), create_provider(Embedding(provider="hashing")))
    return rows.select("doc_id", F.posexplode("embedding").alias("bucket", "v")).filter("v <> 0").select("doc_id", "bucket", F.col("v").cast("double").alias("v"))


class _Answers(BaseHTTPRequestHandler):
    """Gives (bytes of the text, texts asked for at once, 1 if a key was sent) for each text, the last first."""

    def do_POST(self) -> None:
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        vectors = [[len(t.encode()), len(asked), int(self.headers.get("Authorization") == "Bearer key")] for t in asked]
        if self.path == "/api/embed":
            answer = {"embeddings": vectors}
        else:
            answer = {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(vectors)))]}
        body = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args: object) -> None:
        pass


def _served(spark: SparkSession, sf_dir: str, provider: str, key: str | None) -> DataFrame:
    """Documents' vectors by a provider that is asked over HTTP."""
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = create_provider(Embedding(provider=provider, model="m", base_url=f"http://127.0.0.1:{server.server_port}"), key)
    rows = embed_column(files(spark, sf_dir).select("doc_id", "content"), at).select("doc_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("bytes", "batch", "key"))])
    rows = spark.createDataFrame(rows.select("doc_id", "bytes", (F.col("batch") <= at.batch).alias("bounded"), "key").toArrow())  # a number for each document, before the server ends
    server.shutdown()
    return rows


_SERVED = "SELECT doc_id, coalesce(strlen(text), 0)::DOUBLE AS bytes, true AS bounded, {}::DOUBLE AS key FROM documents"


@registered(_SERVED.format(0))
def embed_ollama(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _served(spark, sf_dir, "ollama", None)


@registered(_SERVED.format(1))
def embed_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _served(spark, sf_dir, "openai", "key")


@registered(_SERVED.format(1))
def embed_openai_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _served(spark, sf_dir, "openai-compatible", "key")


@registered("""WITH t AS (SELECT (vec_id // 8)::BIGINT AS g, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) WHERE vec_id % 8 <= (vec_id // 8) % 8 GROUP BY 1, 2)
SELECT g, i::INT AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY g)), 6) AS v FROM t""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors as the tokens of a text, of which the first 1 to 8 count: their mean at unit length."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("g"), F.struct("vec_id", "embedding").alias("t")).groupBy("g").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, tokens in zip(batch.column("g").to_pylist(), batch.column("t").to_pylist(), strict=True):
                mask = np.array([[x["vec_id"] % 8 <= g % 8 for x in tokens]], np.int64)
                out = pooled(np.array([[x["embedding"] for x in tokens]], np.float64), mask)[0]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(out)), pa.array(range(1, len(out) + 1), pa.int32()), pa.array(out)], ["g", "i", "v"])

    return _rounded(rows.mapInArrow(run, "g long, i int, v double"), "v")


def _field(number: int, value: int | bytes) -> bytes:
    """A field of a protocol buffer: a number, or bytes behind their length."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def tiny_model(folder: Path) -> None:
    """An ONNX model that looks each token up in a table of three numbers, and a tokenizer of fixed words."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    words = {"[UNK]": 0, "the": 1, "der": 2, "le": 3, "el": 4}
    tokenizer = Tokenizer(models.WordLevel(words, "[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex("[ \\t\\n\\x0b\\f\\r]+"), "removed")
    tokenizer.save(str(folder / "tokenizer.json"))
    weights = np.array([[1 + w, w * w, 1] for w in words.values()], "<f4")
    tensor = _field(1, weights.shape[0]) + _field(1, 3) + _field(2, 1) + _field(8, b"table") + _field(9, weights.tobytes())
    node = _field(1, b"table") + _field(1, b"input_ids") + _field(2, b"hidden") + _field(4, b"Gather")

    def value(name: bytes, kind: int, dims: list[bytes]) -> bytes:
        shape = b"".join(_field(1, d) for d in dims)
        return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))

    free = [_field(2, b"texts"), _field(2, b"tokens")]
    graph = _field(1, node) + _field(2, b"g") + _field(5, tensor) + _field(11, value(b"input_ids", 7, free)) + _field(12, value(b"hidden", 1, [*free, _field(1, 3)]))
    (folder / "model.onnx").write_bytes(_field(1, 8) + _field(7, graph) + _field(8, _field(1, b"") + _field(2, 13)))


@registered(f"""WITH w AS (SELECT doc_id, list_slice({_WORDS.format("coalesce(text, '')")}, 1, 512) AS w FROM documents),
t AS (SELECT doc_id, unnest(list_transform(w, lambda x: CASE x WHEN 'the' THEN 1 WHEN 'der' THEN 2 WHEN 'le' THEN 3 WHEN 'el' THEN 4 ELSE 0 END)) AS k FROM w),
m AS (SELECT doc_id, avg(1 + k) AS a, avg(k * k) AS b, 1.0 AS c FROM t GROUP BY 1)
SELECT doc_id, round(a / sqrt(a * a + b * b + c * c), 3) AS a, round(b / sqrt(a * a + b * b + c * c), 3) AS b, round(c / sqrt(a * a + b * b + c * c), 3) AS c FROM m""")
def embed_onnx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local model: 512 tokens at most, mean over the tokens that count, unit length. Texts without a token are left out."""
    folder = Path(scratch(spark, "model").removeprefix("file:"))
    folder.mkdir(parents=True)
    tiny_model(folder)
    rows = files(spark, sf_dir).filter(F.col("content").rlike(r"[^ \t\n\x0b\f\r]")).select("doc_id", "content")
    rows = embed_column(rows, OnnxProvider(str(folder)))
    return rows.select("doc_id", *[F.round(F.col("embedding")[i].cast("double"), 3).alias(n) for i, n in enumerate("abc")])


# --- excerpts and renderings -------------------------------------------------------------------

_HITS = _windows_sql(80, 40).split("SELECT file_path, (s + 1)")[0].replace("f),", "f WHERE content IS NOT NULL),", 1)


@registered(f"""{_HITS.rstrip()}, h AS (SELECT file_path, lines, (s + 1)::INT AS line, least(len(lines), s + 80) AS past FROM s),
x AS (SELECT file_path, line, greatest(1, line - 2) AS first, unnest(list_slice(lines, greatest(1, line - 2), least(len(lines), line + len(string_split(trim(array_to_string(list_slice(lines, line, past), chr(10)), chr(10)), chr(10))) + 1))) AS x,
  generate_subscripts(list_slice(lines, greatest(1, line - 2), least(len(lines), line + len(string_split(trim(array_to_string(list_slice(lines, line, past), chr(10)), chr(10)), chr(10))) + 1)), 1) AS i FROM h)
SELECT file_path AS path, line, first::INT AS first, md5(string_agg(printf('%4d | %s', (first + i - 1)::INT, x), chr(10) ORDER BY i)) AS excerpt FROM x GROUP BY ALL""")
def context_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every file as a result, with two lines before and after it from the whole file."""
    rows = files(spark, sf_dir).filter("content IS NOT NULL")
    found = chunk_files(rows.select("repo", "file_path", "content"), parser=None).select("repo", F.col("file_path").alias("path"), F.col("line_start").alias("line"), F.lit(0.5).alias("score"), F.col("content").alias("snippet"))
    blocks = as_blocks(with_context(found, rows, 2))
    return blocks.select("path", "line", "first", F.md5(F.substring_index("text", "(score: 0.50)\n", -1)).alias("excerpt"))


def _best(spark: SparkSession, sf_dir: str) -> list[dict]:
    return [r.asDict() for r in search(vector_chunks(spark, sf_dir), _vector(spark, sf_dir), limit=10).collect()]  # ten rows


def _one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "i int, line string")


def _lines(sql: str) -> str:
    """A query that gives one text, as its lines."""
    return f"SELECT (i - 1)::INT AS i, line FROM (SELECT unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM ({sql}) q(x))"


_ORDERED = "ORDER BY greatest(0, 1 - dist / 2) DESC, repo, file_path, line_start, id"
_TOP = f"WITH top AS ({_knn('true', 10, nearest=10)}) "


@registered(_TOP + _lines("SELECT string_agg(printf('%s:%s:%d  (score: %.2f)', repo, path, line, score) || chr(10) || printf('%4d | %s', line, snippet), chr(10) || chr(10) ORDER BY score DESC, repo, path, line) FROM top"))
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, render.as_text(_best(spark, sf_dir)))


@registered(_knn("true", 10, nearest=10))
def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results read back from their JSON."""
    rows = [tuple(r[k] for k in ("repo", "path", "line", "score", "snippet", "lang")) for r in json.loads(render.as_json(_best(spark, sf_dir)))]
    return _rounded(spark.createDataFrame(rows, "repo string, path string, line int, score double, snippet string, lang string"), "score")


@registered(f"WITH p AS ({_duplicates(0.25, limit=20)}) " + _lines("""SELECT string_agg(printf('%s:%s:%d-%d <-> %s:%s:%d-%d (score: %.2f)', repo_a, path_a, id_a::INT, (id_a + 9)::INT, repo_b, path_b, id_b::INT, (id_b + 9)::INT, similarity) || chr(10) || 'A:' || chr(10) || printf('%4d | chunk %d', id_a::INT, id_a::INT) || chr(10) || 'B:' || chr(10) || printf('%4d | chunk %d', id_b::INT, id_b::INT), chr(10) || chr(10) ORDER BY similarity DESC, id_a, id_b) FROM p"""))
def render_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_duplicates(vector_chunks(spark, sf_dir), _lsh(), threshold=0.25, limit=20)
    return _one(spark, render.pairs_as_text([r.asDict(recursive=True) for r in found.collect()]))  # twenty rows


@registered(f"""WITH {_S}, r AS (SELECT repo, count(*) AS n, avg(line_start) AS mean FROM s GROUP BY 1), c AS (SELECT repo, n::VARCHAR AS chunks, printf('%.2f', mean) AS mean FROM r),
w AS (SELECT greatest(4, max(len(repo))) AS a, greatest(6, max(len(chunks))) AS b, greatest(4, max(len(mean))) AS c FROM c) """ + _lines("""SELECT rpad('name', a::INT, ' ') || '  ' || rpad('chunks', b::INT, ' ') || '  ' || rpad('mean', w.c::INT, ' ') || '  none' || chr(10) || repeat('-', a) || '  ' || repeat('-', b) || '  ' || repeat('-', w.c) || '  ----' || chr(10) ||
(SELECT string_agg(rpad(repo, a::INT, ' ') || '  ' || rpad(chunks, b::INT, ' ') || '  ' || rpad(mean, w.c::INT, ' ') || '      ', chr(10) ORDER BY repo) FROM c) FROM w"""))
def render_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared(spark, sf_dir)
    rows = [r.asDict() for r in store.places().groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.avg("line_start").alias("mean"), F.lit(None).alias("none")).orderBy("repo").collect()]  # a row for each repository
    return _one(spark, render.as_table(rows, [("name", "repo"), ("chunks", "n"), ("mean", "mean"), ("none", "none")]))


@registered("SELECT * FROM (VALUES ('auto', false, true), ('auto', true, false), ('json', false, true), ('json', true, true), ('text', false, false), ('compact', true, false)) t(format, terminal, json)")
def render_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether results come as JSON, by the format asked for and where they go."""

    class Out(io.StringIO):
        def __init__(self, terminal: bool):
            super().__init__()
            self.terminal = terminal

        def isatty(self) -> bool:
            return self.terminal

    cases = [("auto", False), ("auto", True), ("json", False), ("json", True), ("text", False), ("compact", True)]
    return spark.createDataFrame([(k, t, render.is_json(k, Out(t))) for k, t in cases], "format string, terminal boolean, json boolean")


# --- configuration, commands, tool server ------------------------------------------------------


@registered("""SELECT * FROM (VALUES ('embedding.provider', 'ollama', 'hashing'), ('embedding.model', 'a "quoted" \\ name', 'all-MiniLM-L6-v2'), ('embedding.backend', 'torch', 'onnx'), ('embedding.api_key', 'sécret', ''), ('embedding.base_url', 'http://h:1/v1', ''),
('odd key', 'refused', 'refused'), ('key in force', 'environment', 'none'), ('broken file', 'refused', 'refused'), ('mode', '600', '600'), ('shown', '[embedding]|  provider = ollama|  model = a "quoted" \\ name|  backend = torch|  api_key = ***|  base_url = http://h:1/v1', '[embedding]|  provider = hashing|  model = all-MiniLM-L6-v2|  backend = onnx')) t(key, written, first)""")
def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration that was changed, written and read again, beside a new one."""
    at = Path(tempfile.mkdtemp(), "deep", "config.toml")
    first = Config.load(at)
    written = first
    for key, value in {"provider": "ollama", "model": 'a "quoted" \\ name', "backend": "torch", "api_key": "sécret", "base_url": "http://h:1/v1"}.items():
        written = written.with_value(f"embedding.{key}", value)
    written.save(at)
    written = Config.load(at)
    rows = [(k, written.get(k), first.get(k)) for k in KEYS]

    def refused(run: object) -> str:
        try:
            return str(run())
        except SemdexError:
            return "refused"

    before = os.environ.pop(API_KEY_VARIABLE, None)
    none = first.api_key() or "none"
    os.environ[API_KEY_VARIABLE] = "environment"
    rows += [("odd key", refused(lambda: written.get("embedding.odd")), refused(lambda: first.with_value("odd", "x"))), ("key in force", written.api_key(), none)]
    os.environ.pop(API_KEY_VARIABLE)
    if before is not None:
        os.environ[API_KEY_VARIABLE] = before
    rows += [("mode", oct(at.stat().st_mode & 0o777)[2:], "600"), ("shown", written.shown().replace("\n", "|"), first.shown().replace("\n", "|"))]
    at.write_text("no = = toml")
    rows.append(("broken file", refused(lambda: Config.load(at)), "refused"))
    return spark.createDataFrame(rows, "key string, written string, first string")


class _Near(Provider):
    """The vector of the number that ends a text."""

    def __init__(self, vectors: dict[int, list[float]]):
        self.vectors = vectors

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.vectors.get(int(t.split()[-1]), [0.0] * HASH_WIDTH) for t in texts]


def _run(spark: SparkSession, at: str, provider: Provider, *args: str) -> tuple[int, str, str]:
    out, err = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        code = cli.main(["--index", at, "--config", f"{at.removeprefix('file:')}-config/config.toml", *args], spark, provider)
    return code, out.getvalue().rstrip("\n"), err.getvalue().rstrip("\n")


@registered(_search_sql("repo = 'repo2' AND lang IN ('go', 'java') AND file_path GLOB 'src/*'", 10, 0.2))
def cli_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared(spark, sf_dir)
    _, out, _ = _run(spark, store._folder.uri, Fixed(_vector(spark, sf_dir)), "search", "any", "--repo", "repo2", "--lang", "go", "--lang", "java", "--path", "src/*", "--threshold", "0.2", "--format", "json")
    rows = [tuple(r[k] for k in ("repo", "path", "line", "score", "snippet", "lang")) for r in json.loads(out)]
    return _rounded(spark.createDataFrame(rows, "repo string, path string, line int, score double, snippet string, lang string"), "score")


@registered(f"""WITH {_S}, {ORACLES["lsh_candidates"].removeprefix("WITH ").rsplit("SELECT id_a", 1)[0]}, p AS (SELECT id_a, id_b, list_cosine_similarity(a.e, b.e) AS sim, a.file_path AS path_a, b.file_path AS path_b, a.line_start AS line_a, b.line_start AS line_b FROM cand JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b WHERE a.repo = 'repo1' AND b.repo = 'repo1' AND a.file_path <> b.file_path)
SELECT path_a, line_a, path_b, line_b, round(sim, 6) AS similarity FROM p WHERE sim >= 0.2 ORDER BY sim DESC, id_a, id_b LIMIT 15""")
def cli_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared(spark, sf_dir)
    _, out, _ = _run(spark, store._folder.uri, Fixed([0.0]), "duplicates", "--repo", "repo1", "--cross-file-only", "--threshold", "0.2", "--limit", "15", "--format", "json")
    rows = [(r["chunk_a"]["path"], r["chunk_a"]["line_start"], r["chunk_b"]["path"], r["chunk_b"]["line_start"], r["similarity"]) for r in json.loads(out)]
    return _rounded(spark.createDataFrame(rows, "path_a string, line_a int, path_b string, line_b int, similarity double"), "similarity")


@registered(f"""WITH {_S}, n AS (SELECT repo, count(*) AS n FROM s GROUP BY 1)
SELECT * FROM (VALUES ('add', 0), ('add again', 1), ('add nowhere', 1), ('index nothing', 1), ('remove unknown', 1), ('search of an empty index', 0), ('search outside', 0), ('odd key', 1), ('set', 0), ('get', 0), ('status', 0), ('blank query', 1), ('other error', 2), ('verbose and quiet', 2)) t(command, code)
UNION ALL SELECT 'removed, with ' || n || ' chunks', 0 FROM n WHERE repo = 'repo3'""")
def cli_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes: 0 if all went well, 1 for an error of the user's, 2 for any other."""
    new, folder, vector = scratch(spark, "index"), tempfile.mkdtemp(), Fixed(_vector(spark, sf_dir))
    full = stored(spark, sf_dir)._folder.uri

    class Broken(Provider):
        def embed(self, texts: list[str]) -> list[list[float]]:
            raise RuntimeError("no vectors today")

    steps = [
        ("search of an empty index", new, vector, "search", "x"), ("index nothing", new, vector, "index"), ("add", new, vector, "repo", "add", folder, "--name", "r"), ("add again", new, vector, "repo", "add", folder),
        ("add nowhere", new, vector, "repo", "add", f"{folder}/none"), ("remove unknown", new, vector, "repo", "remove", "none"), ("search outside", full, vector, "search", "x"), ("odd key", new, vector, "config", "get", "odd"),
        ("set", new, vector, "config", "set", "embedding.model", "m"), ("get", new, vector, "config", "get", "embedding.model"), ("status", full, vector, "index", "--status"), ("blank query", full, vector, "search", " ", "--repo", "repo1"),
        ("other error", full, Broken(), "search", "x", "--repo", "repo1"),
    ]
    rows = [(name, _run(spark, at, provider, *args)[0]) for name, at, provider, *args in steps]
    try:
        _run(spark, new, vector, "-v", "-q", "repo", "list")
    except SystemExit as e:
        rows.append(("verbose and quiet", int(e.code)))
    code, out, _ = _run(spark, full, vector, "repo", "remove", "repo3")
    return spark.createDataFrame([*rows, (out.split(": ", 1)[1], code)], "command string, code int")


@registered(f"""WITH {_S}, q AS (SELECT vec_id AS asked, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT asked, repo, file_path, line_start, greatest(0, 1 - list_distance(e, v) / 2) AS score, row_number() OVER (PARTITION BY asked ORDER BY list_distance(e, v), id) AS k FROM s, q)
SELECT asked::INT AS asked, repo, file_path AS path, line_start AS line, round(score, 6) AS score, 0 AS code FROM d WHERE k <= 2
UNION ALL SELECT * FROM (VALUES (-1, 'semdex', '2024-11-05', 0, 0.0::DOUBLE, 0), (-2, 'semantic_search', 'query', 0, 0, 0), (-3, '', '', 0, 0, -32601), (-4, '', '', 0, 0, -32602), (-5, '', '', 0, 0, -32602), (-6, '', '', 0, 0, -32601), (-7, '', '', 0, 0, -32600), (-8, '', '', 0, 0, -32602)) t""")
def rpc_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session of the tool server: every vector whose id is divisible by 50 as a query, and calls that are refused."""
    store = shared(spark, sf_dir)
    asked = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").collect()}
    calls: list[tuple[int, dict]] = [
        (-1, {"method": "initialize"}), (-2, {"method": "tools/list"}), (-3, {"method": "none"}), (-4, {"method": "tools/call", "params": {"name": "semantic_search", "arguments": {}}}),
        (-5, {"method": "tools/call", "params": {"name": "semantic_search", "arguments": {"query": "x", "limit": "many"}}}), (-6, {"method": "tools/call", "params": {"name": "none"}}), (-7, {}), (-8, {"method": "tools/call", "params": []}),
    ]
    calls += [(i, {"method": "tools/call", "params": {"name": "semantic_search", "arguments": {"query": f"like {i}", "limit": 2}}}) for i in asked]
    source, sink = io.BytesIO(), io.BytesIO()
    for i, call in [(0, {"method": "notifications/initialized"}), *calls]:
        body = json.dumps({"jsonrpc": "2.0", "id": i} | call).encode()
        source.write(b"Content-Length: %d\r\n\r\n%b" % (len(body), body))
    source.seek(0)
    find = lambda query, **k: [r.asDict() for r in search_index(store, _Near(asked), query, **k).collect()]  # noqa: E731  two rows
    Server(find, lambda: True, lambda calls: search_index_all(store, _Near(asked), calls)).run(source, sink)
    sink.seek(0)
    rows: list[tuple] = []
    while (answer := read_message(sink)) is not None:
        i, result = answer["id"], answer.get("result")
        if result is None:
            rows.append((i, "", "", 0, 0.0, answer["error"]["code"]))
        elif "serverInfo" in result:
            rows.append((i, result["serverInfo"]["name"], result["protocolVersion"], 0, 0.0, 0))
        elif "tools" in result:
            rows.append((i, result["tools"][0]["name"], *result["tools"][0]["inputSchema"]["required"], 0, 0.0, 0))
        else:
            rows += [(i, r["repo"], r["path"], r["line"], r["score"], 0) for r in result["structuredContent"]]
    return _rounded(spark.createDataFrame(rows, "asked int, repo string, path string, line int, score double, code int"), "score")
