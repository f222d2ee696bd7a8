import io
import json
import os
import subprocess
import time

import pytest

from semdex import cli, render, rpc
from semdex.errors import ConfigError, DimensionMismatchError, ProviderError, StoreError
from semdex.operators import embed as E
from semdex.plans.index import index_duplicates, index_repo, search_index, search_index_all
from semdex.rpc import Server, read_message
from semdex.sources.config import Config, Embedding
from semdex.sources.scan import scan_files
from semdex.sources.store import Store


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    files = {"src/main.py": "def alpha(): pass", "src/util.ts": "let b = 1", "README.md": "read me", "node_modules/x.js": "no", "build/y.py": "no", "p.png": "no", "big.sql": "x" * 102401}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "nul.py").write_bytes(b"a\x00b")
    return root


def names(df):
    return sorted(r["file_path"] for r in df.select("file_path").collect())


def test_scan_walks_or_asks_git(spark, tree):
    assert names(scan_files(spark, tree)) == ["README.md", "src/main.py", "src/util.ts"]
    subprocess.run(["git", "init", "-q", str(tree)], check=True)
    assert len(names(scan_files(spark, tree))) == 3  # nothing is tracked yet
    subprocess.run(["git", "-C", str(tree), "add", "src/main.py", "p.png"], check=True)
    assert names(scan_files(spark, tree)) == ["src/main.py"]


def test_index_follows_changes(spark, tree, tmp_path):
    store, provider = Store(spark, tmp_path / "index"), E.HashingProvider()
    repo = store.add_repo("r", str(tree))
    with pytest.raises(StoreError):
        store.add_repo("r", "/elsewhere")
    done = index_repo(store, repo, tree, provider)
    assert (done.files_indexed, done.chunks_created) == (3, 3)
    assert index_repo(store, repo, tree, provider).files_indexed == 0
    first = {r["file_path"]: r["id"] for r in store.table("chunks").collect()}
    (tree / "src/main.py").write_text("def beta(): pass")
    os.utime(tree / "src/main.py", (1, 1))
    (tree / "README.md").unlink()
    done = index_repo(store, repo, tree, provider)
    assert (done.files_indexed, done.files_removed) == (1, 1)
    now = {r["file_path"]: r["id"] for r in store.table("chunks").collect()}
    assert set(now) == {"src/main.py", "src/util.ts"}
    assert now["src/util.ts"] == first["src/util.ts"]
    assert now["src/main.py"] > max(first.values())
    assert store.table("bands").select("chunk_id").distinct().count() == store.table("vectors").count() == 2
    found = search_index(store, provider, "def beta(): pass", limit=1).first()
    assert (found["repo"], found["path"], found["score"]) == ("r", "src/main.py", 1.0)
    with pytest.raises(ValueError):
        search_index(store, provider, "  ")
    with pytest.raises(StoreError):
        search_index(store, provider, "x", repo="none")
    row = store.repos().first()
    assert (row["file_count"], row["chunk_count"]) == (2, 2)
    assert store.remove_repo("r") == 2
    assert store.remove_repo("r") == 0
    assert store.table("vectors").isEmpty()


def test_another_width_needs_a_full_run(spark, tree, tmp_path):
    class Wide(E.Provider):  # in here, it is sent to the workers by value
        def embed(self, texts):
            return [[1.0, 2.0, 3.0] for _ in texts]

    store = Store(spark, tmp_path / "index")
    a = store.add_repo("a", str(tree))
    index_repo(store, a, tree, E.HashingProvider())
    with pytest.raises(DimensionMismatchError):
        index_repo(store, a, tree, Wide())
    with pytest.raises(DimensionMismatchError):
        search_index(store, Wide(), "x")
    assert index_repo(store, a, tree, Wide(), full=True).chunks_created == 3
    assert store.dimensions() == 3
    pairs = index_duplicates(store, threshold=0.99).collect()
    assert len(pairs) == 3
    b = store.add_repo("b", str(tree / "src"))
    with pytest.raises(DimensionMismatchError):  # before anything of the other repo is lost
        index_repo(store, b, tree / "src", E.HashingProvider(), full=True)
    assert store.table("vectors").count() == 3


def run(spark, capsys, folder, *args):
    code = cli.main(["--index", str(folder / "index"), "--config", str(folder / "config.toml"), *args], spark)
    out = capsys.readouterr()
    return code, out.out.strip(), out.err.strip()


def test_command_line(spark, tree, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tree)
    assert run(spark, capsys, tmp_path, "search", "x", "--format", "text")[1] == cli.NO_INDEX
    assert run(spark, capsys, tmp_path, "index")[0] == 1
    assert run(spark, capsys, tmp_path, "repo", "add", str(tree), "--name", "r") == (0, f"r: added, at {tree}", "")
    assert run(spark, capsys, tmp_path, "repo", "add", str(tree))[0] == 1
    assert run(spark, capsys, tmp_path, "repo", "add", str(tree / "none"))[0] == 1
    assert run(spark, capsys, tmp_path, "index")[1].startswith("r: 3 files, 3 chunks")
    assert "r" in run(spark, capsys, tmp_path, "index", "--status")[1]
    code, out, _ = run(spark, capsys, tmp_path, "search", "let b = 1", "--limit", "1")
    assert [(x["path"], x["line"]) for x in json.loads(out)] == [("src/util.ts", 1)]
    assert run(spark, capsys, tmp_path, "search", "let b = 1", "--limit", "1", "--format", "compact")[1] == "r:src/util.ts:1  1.00"
    monkeypatch.chdir(tree / "src")
    out = json.loads(run(spark, capsys, tmp_path, "search", "read me")[1])
    assert {x["path"] for x in out} == {"src/main.py", "src/util.ts"}
    monkeypatch.chdir("/")
    assert run(spark, capsys, tmp_path, "search", "x") == (0, "[]", cli.NOT_HERE)
    assert run(spark, capsys, tmp_path, "duplicates", "--repo", "r", "--format", "text")[1] == "no duplicates"
    assert run(spark, capsys, tmp_path, "duplicates", "--repo", "none")[0] == 1
    assert run(spark, capsys, tmp_path, "config", "set", "embedding.model", "m")[1].splitlines()[0].endswith("index in full")
    assert run(spark, capsys, tmp_path, "config", "get", "embedding.model")[1] == "m"
    assert run(spark, capsys, tmp_path, "config", "get", "embedding.odd")[0] == 1
    assert run(spark, capsys, tmp_path, "repo", "remove", "r")[1] == "r: removed, with 3 chunks"
    with pytest.raises(SystemExit):
        cli.main(["-v", "-q", "repo", "list"])


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "deep" / "config.toml"
    assert Config.load(path) == Config()
    assert path.stat().st_mode & 0o777 == 0o600
    Config().with_value("embedding.api_key", 'q"uote').save(path)
    read = Config.load(path)
    assert read.embedding.api_key == 'q"uote'
    assert "***" in read.shown() and "uote" not in read.shown()
    monkeypatch.setenv("SEMDEX_API_KEY", "env")
    assert read.api_key() == "env"
    path.write_text("= no")
    with pytest.raises(ConfigError):
        Config.load(path)


class Echo(E.OpenAIProvider):
    asked: list

    def _ask(self, texts):
        self.asked.append(len(texts))
        return {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(texts)))]}


def test_providers():
    echo = Echo("m", "http://x", "k")
    echo.asked = []
    assert len(echo.embed(["t"] * 150)) == 150 and echo.asked == [100, 50]
    assert echo.embed(["a", "b"]) == [[0.0], [1.0]]
    assert echo.dimensions() == 1
    with pytest.raises(ConfigError):
        E.create_provider(Embedding(provider="none"))
    with pytest.raises(ConfigError):
        E.create_provider(Embedding(provider="openai"))
    with pytest.raises(ProviderError):
        E.OllamaProvider("m", "http://127.0.0.1:9").embed(["x"])
    with pytest.raises(ProviderError):
        E.create_provider(Embedding(provider="onnx", model="/none")).embed(["x"])
    assert E.pooled(E.np.array([[[3.0, 4.0], [9.0, 9.0]]]), E.np.array([[1, 0]])).tolist() == [[0.6, 0.8]]


def test_hashing_provider_equals_its_expression(spark):
    texts = ["a b a", "", "Größe x\ty\nz"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    assert [r[0] for r in df.select(E.hashed(df.content)).collect()] == E.HashingProvider().embed(texts)
    assert [list(r[1]) for r in E.embed_column(df, E.HashingProvider()).collect()] == E.HashingProvider().embed(texts)


def test_renderings(tmp_path):
    (tmp_path / "f").write_text("a\nb\nc\nd\n")
    row = {"repo": "r", "path": "f", "line": 2, "score": 0.876, "snippet": "b\nc", "lang": ""}
    assert render.as_text([row]) == "r:f:2  (score: 0.88)\n   2 | b\n   3 | c"
    assert render.as_text([row], 1, {"r": tmp_path}).endswith("   1 | a\n   2 | b\n   3 | c\n   4 | d")
    assert render.as_text([row], 1, {"r": tmp_path / "gone"}) == render.as_text([row])
    assert render.as_compact([row]) == "r:f:2  0.88"
    assert json.loads(render.as_json([row])) == [row]
    side = {"repo": "r", "path": "f", "line_start": 1, "line_end": 2, "snippet": "x", "lang": ""}
    assert render.pairs_as_text([{"chunk_a": side, "chunk_b": side, "similarity": 1.0}]).startswith("r:f:1-2 <-> r:f:1-2 (score: 1.00)\nA:\n   1 | x\nB:")
    assert render.as_table([{"a": 1.0, "b": None}, {"a": "xyzzy", "b": 2}]) == "a      b\n-----  -\n1.00    \nxyzzy  2"
    assert render.as_table([]) == ""


def test_tool_server():
    server = Server(lambda query, **k: [{"query": query, "limit": k["limit"]}], lambda: True)
    call = lambda **a: server.handle({"id": 1, "method": "tools/call", "params": {"name": "semantic_search", "arguments": a}})
    assert call(query="q", lang="go")["result"]["structuredContent"] == [{"query": "q", "limit": 10}]
    assert call(query=" ")["error"]["code"] == -32602
    assert call(query="q", lang=[1])["error"]["code"] == -32602
    assert call(query="q", limit="x")["error"]["code"] == -32602
    assert server.handle({"id": 1, "method": "tools/call", "params": {"name": "odd"}})["error"]["code"] == -32601
    assert server.handle({"id": 1, "method": "odd"})["error"]["code"] == -32601
    assert server.handle({"id": 1})["error"]["code"] == -32600
    assert server.handle({"method": "notifications/initialized"}) is None
    assert server.handle({"id": 2, "method": "ping"}) == {"jsonrpc": "2.0", "id": 2, "result": {}}
    assert Server(None, lambda: False).handle({"id": 1, "method": "tools/call", "params": {"name": "semantic_search", "arguments": {"query": "q"}}})["error"]["code"] == -32000
    body = json.dumps({"id": 3, "method": "tools/list"}).encode()
    sink = io.BytesIO()
    server.run(io.BytesIO(b"Content-Length: %d\r\nX: y\r\n\r\n%b" % (len(body), body)), sink)
    sink.seek(0)
    assert read_message(sink)["result"]["tools"][0]["name"] == "semantic_search"


def framed(*messages):
    return io.BytesIO(b"".join(b"Content-Length: %d\r\n\r\n%b" % (len(m), m) for m in (json.dumps(m).encode() for m in messages)))


def asking(i, **arguments):
    return {"id": i, "method": "tools/call", "params": {"name": "semantic_search", "arguments": {"query": f"q{i}", "limit": 2} | arguments}}


def answers(sink):
    sink.seek(0)
    return list(iter(lambda: read_message(sink), None))


def test_calls_that_wait_are_searched_together(monkeypatch):
    sizes = []

    def search_all(calls):
        time.sleep(0.3)  # meanwhile all others arrive
        sizes.append(len(calls))
        return [StoreError("none") if c["repo"] else [{"query": c["query"]}] for c in calls]

    server = Server(lambda **call: search_all([call])[0], lambda: True, search_all)
    sink = io.BytesIO()
    server.run(framed(*[{"id": i, "method": "ping"} if i % 50 == 1 else asking(i, repo="x" if i % 50 == 2 else None) for i in range(400)]), sink)
    got = answers(sink)
    assert [a["id"] for a in got] == list(range(400)) and sum(sizes) == 392 and len(sizes) < 10
    assert all(a["result"] == {} if i % 50 == 1 else a["error"]["code"] == -32000 if i % 50 == 2 else a["result"]["structuredContent"] == [{"query": f"q{i}"}] for i, a in enumerate(got))
    monkeypatch.setattr(rpc, "HELD_ROWS", 7)
    sizes.clear()
    assert [a["id"] for a in server.handle_all([asking(i, limit=100 if i == 4 else 2) for i in range(8)])] == list(range(8))
    assert sizes == [3, 1, 1, 3]  # a call for more than is held is alone


def test_a_session_that_fails_is_answered_up_to_there():
    def search(query, **_):
        if query == "q2":
            raise RuntimeError("no vectors today")
        return []

    sink = io.BytesIO()
    with pytest.raises(RuntimeError):
        Server(search, lambda: True, lambda calls: [search(**c) for c in calls]).run(framed(*map(asking, range(4))), sink)
    assert [a["id"] for a in answers(sink)] == [0, 1]
    source = framed(*map(asking, range(2)))
    source.seek(0, 2)
    source.write(b"Content-Length: 1\r\n\r\n{")
    source.seek(0)
    sink = io.BytesIO()
    with pytest.raises(json.JSONDecodeError):
        Server(search, lambda: True).run(source, sink)
    assert [a["id"] for a in answers(sink)] == [0, 1]


def test_searching_for_all_calls_equals_each(spark, tree, tmp_path):
    class Picky(E.HashingProvider):  # fails as a whole if one text can't be had
        def embed(self, texts):
            if "bad" in texts:
                raise ProviderError("no vector")
            return [[1.0]] * len(texts) if texts == ["short"] else super().embed(texts)

    store, provider = Store(spark, tmp_path / "index"), Picky()
    for name in ("r", "s"):
        index_repo(store, store.add_repo(name, str(tree / "src" if name == "s" else tree)), tree / "src" if name == "s" else tree, E.HashingProvider())
    asked = [{"query": q} for q in ("def alpha(): pass", " let b = 1 ", " ", "bad", "short", "read me")]
    asked += [{"query": "let b", "repo": n} for n in ("r", "s", "none", str(tree))] + [{"query": "x", "limit": 0}, {"query": "let b = 1", "threshold": 0.9}, {"query": "pass", "langs": ["python"]}, {"query": "def", "langs": ["python"]}, {"query": "b", "limit": 1}]
    calls = [{"repo": None, "langs": None, "path_glob": None, "limit": 3, "threshold": 0.0} | a for a in asked]

    def alone(call):
        try:
            return [r.asDict() for r in search_index(store, provider, **call).collect()]
        except (StoreError, ProviderError, ValueError) as e:
            return e

    got = search_index_all(store, provider, calls)
    assert [repr(x) for x in got] == [repr(alone(c)) for c in calls]
    assert sum(isinstance(x, Exception) for x in got) == 4 and sum(bool(x) and isinstance(x, list) for x in got) > 8
    assert search_index_all(store, provider, []) == []


def test_scan_reads_files_by_name(spark, tree, monkeypatch):
    """Names that Spark's readers pass over, links, and tracked files that are gone; a few tasks for many files."""
    names_ = ["pkg/__init__.py", ".github/ci.yml", "_x.py", "a b%20+c.py", "é.py"]
    for name in names_:
        (tree / name).parent.mkdir(exist_ok=True)
        (tree / name).write_text("x")
    (tree / "link.py").symlink_to(tree / "_x.py")
    (tree / "loop").symlink_to(tree)
    os.mkfifo(tree / "fifo.py")
    (tree / "gone.py").write_text("x")
    want = sorted([*names_, "README.md", "src/main.py", "src/util.ts", "link.py"])
    subprocess.run(["git", "init", "-q", str(tree)], check=True)
    subprocess.run(["git", "-C", str(tree), "add", "-f", "."], check=True)
    (tree / "gone.py").unlink()
    assert names(scan_files(spark, tree)) == want
    subprocess.run(["git", "-C", str(tree), "rm", "-rq", "--cached", "."], check=True)
    assert names(scan_files(spark, tree)) == want
    rows = {r["file_path"]: r for r in scan_files(spark, tree).collect()}
    assert rows["_x.py"]["content"] == b"x" and rows["_x.py"]["length"] == 1
    assert abs(rows["_x.py"]["mtime"] - os.stat(tree / "_x.py").st_mtime) < 0.002
    for i in range(300):
        (tree / f"src/m{i}.py").write_text("x")
    assert scan_files(spark, tree).count() == len(want) + 300 and scan_files(spark, tree).rdd.getNumPartitions() == 1
