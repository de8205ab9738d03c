import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ann, context, extract, graph, relational, retrieval, search
from sparkloom.sources import export, model
from sparkloom.sources.store import Store

E = "session_id string, src string, dst string, relation string"


def edges(spark, *pairs, relation="Implements"):
    return spark.createDataFrame([("s", a, b, relation) for a, b in pairs], E)


def start(spark, *names):
    return spark.createDataFrame([("s", n, n) for n in names], "session_id string, origin string, node string")


def test_neighbours_and_degree(spark):
    e = edges(spark, ("rust", "petgraph"), ("petgraph", "performance"))
    assert graph.neighbours(e, "petgraph").head()["neighbours"] == ["performance", "rust"]
    assert graph.neighbours(e, "PetGraph").head()["neighbours"] == ["performance", "rust"]
    more = e.unionByName(edges(spark, ("petgraph", "optimization"), relation="LeadsTo"))
    m = spark.createDataFrame([("s", n, datetime(2025, 1, 1)) for n in ("rust", "petgraph")], "session_id string, name string, ts timestamp")
    score = {r["name"]: r["score"] for r in graph.importance(graph.entities(m), more).collect()}
    assert score["petgraph"] == pytest.approx(1.3)
    assert graph.stats(graph.entities(m), e).head()["average_degree"] == pytest.approx(4 / 3, abs=1e-6)


def test_paths(spark):
    e = edges(spark, ("a", "b"), ("b", "d"), ("a", "c"), ("c", "e"), ("e", "d"))
    pairs = spark.createDataFrame([("s", "a", "d"), ("s", "d", "a")], "session_id string, origin string, target string")
    assert [r["path"] for r in graph.shortest_paths(e, pairs).collect()] == [["a", "b", "d"]]
    both = {r["origin"]: r["path"] for r in graph.shortest_paths(e, pairs, directed=False).collect()}
    assert both == {"a": ["a", "b", "d"], "d": ["d", "b", "a"]}


def test_paths_of_any_length(spark):
    e = edges(spark, *((f"n{i:02}", f"n{i + 1:02}") for i in range(13)))
    pairs = spark.createDataFrame([("s", "n00", "n13"), ("s", "n00", "n02"), ("s", "n05", "none")], "session_id string, origin string, target string")
    assert {r["target"]: len(r["path"]) for r in graph.shortest_paths(e, pairs).collect()} == {"n13": 14, "n02": 3}
    assert {r["target"] for r in graph.shortest_paths(e, pairs, most=4).collect()} == {"n02"}


def test_components(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"))
    strong = {r["node"]: r["component"] for r in graph.components(e, strong=True).collect()}
    assert strong == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert [(r["component"], r["size"]) for r in graph.communities(e).collect()] == [("a", 3)]
    assert {r["component"] for r in graph.components(e).collect()} == {"a"}


def test_network_rim(spark):
    e = edges(spark, ("o", "a"), ("o", "b"), ("a", "b"), ("a", "z"))
    assert {(r["src"], r["dst"]) for r in graph.network(e, start(spark, "o"), 1)[1].collect()} == {("o", "a"), ("o", "b"), ("a", "b")}
    assert {(r["src"], r["dst"]) for r in graph.network(e, start(spark, "o"), 1, rim_edges=False)[1].collect()} == {("o", "a"), ("o", "b")}


def test_path_text(spark):
    t = graph.path_text(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("Solves"), F.lit("CausedBy")))
    assert spark.range(1).select(t).head()[0] == "a ─Solves→ b ─CausedBy→ c"


def store_of(spark, vectors):
    rows = [(f"{i:04d}", "s", [float(x) for x in v], "t", "UpdateContent", datetime(2025, 1, 1)) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "content_id string, session_id string, vector array<float>, text string, content_type string, ts timestamp")


def test_search_finds_cluster(spark):
    rng = np.random.default_rng(5)
    near = 0.8 + 0.01 * rng.standard_normal((20, 32))
    far = rng.standard_normal((20, 32))
    hits = search.semantic_search(store_of(spark, [*near, *far]), [0.8] * 32).collect()
    assert sum(int(r["content_id"]) < 20 for r in hits) >= 7
    assert hits[0]["similarity"] > 0.95
    same = store_of(spark, [np.full(8, 0.1 * (i + 1)) for i in range(30)])  # all ties: by id
    assert [r["content_id"] for r in search.semantic_search(same, [1.0] * 8, 5).collect()] == [f"{i:04d}" for i in range(5)]


def test_batch_search_and_cells_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 16))
    x = np.concatenate([c + 0.3 * rng.standard_normal((60, 16)) for c in centres])
    s = store_of(spark, x)
    q = s.where("cast(content_id as int) % 40 = 0").select(F.col("content_id").alias("query_id"), "vector")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {f"{i:04d}": {f"{j:04d}" for j in np.argsort(-(u @ u[i]))[:10]} for i in range(0, len(x), 40)}
    got: dict = {}
    for r in search.batch_search(s, q, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["content_id"])
    assert got == want
    found: dict = {}
    for r in ann.CellIndex(s, cells=8).search(q, 10, "balanced").collect():
        found.setdefault(r["query_id"], set()).add(r["content_id"])
    assert sum(len(found[k] & want[k]) for k in want) / sum(map(len, want.values())) >= 0.9


def test_product_codes(spark):
    x = np.random.default_rng(2).standard_normal((300, 16))
    codes = ann.ProductCodes(store_of(spark, x), parts=4, centroids=32)
    approx = codes.distance(x[0], codes.encode(x))
    assert np.corrcoef(approx, np.linalg.norm(x - x[0], axis=1))[0, 1] > 0.8
    assert codes.ratio() == 16.0


def test_interactions(spark):
    rows = [
        ("qa", {"question": "why", "answer": "so", "text": "more", "entities": "Rust, db tokio"}),
        ("requirement_added", {"requirement": "r"}),
        ("code_change", {"file": "a.rs", "diff": "+"}),
        ("nonsense", {}),
    ]
    out = context.from_interactions(spark.createDataFrame(rows, "interaction_type string, content map<string,string>")).collect()
    assert (out[0]["update_type"], out[0]["title"], out[0]["description"]) == ("QuestionAnswered", "why", "so")
    assert out[0]["details"] == ["entities: Rust, db tokio", "text: more"]
    assert out[0]["creates_entities"] == ["Rust", "tokio"]
    assert out[1]["description"] == "medium"
    assert (out[2]["title"], out[2]["description"]) == ("a.rs", "+")
    assert out[3]["error"] == "Unknown interaction type: nonsense"
    rel = spark.range(1).select(context.explicit_relationships(F.lit("a DEPENDS_ON b, c causes d e, x likes y, short"), F.lit("t")).alias("r")).head()["r"]
    assert [(r["from_entity"], r["relation_type"], r["to_entity"]) for r in rel] == [("a", "DependsOn", "b"), ("c", "CausedBy", "d e"), ("x", "RelatedTo", "y")]


def test_extraction(spark):
    t = spark.createDataFrame([(1, "The AuthService depends on PostgreSQL. See main.rs and `cache_layer`."), (2, None), (3, "")], "id long, text string")
    names = {r["name"] for r in extract.extract(t, "id").collect()}
    assert {"authservice", "postgresql", "main.rs", "cache_layer"} <= names
    e = spark.createDataFrame([(1, "authservice"), (1, "postgresql")], "id long, name string")
    assert [(r["src"], r["relation"], r["dst"]) for r in extract.relationships(t, e, "id").collect()] == [("authservice", "DependsOn", "postgresql")]
    tags = [(1, 0, "New", "B-LOC", 0.9), (1, 1, "York", "I-LOC", 0.8), (1, 2, "is", "O", 0.9), (1, 3, "x", "B-PER", 0.99), (1, 4, "Bob", "B-PER", 0.5)]
    found = extract.decode_tags(spark.createDataFrame(tags, "text_id long, pos int, token string, tag string, confidence double")).collect()
    assert [(r["entity"], r["kind"]) for r in found] == [("New York", "LOC")]


def test_names_in_any_script(spark):
    texts = [("a", "We built the cache with tokio and RocksDB using a lock-free queue for the http2 server"), ("b", "Заявките минават през QueryPlanner и кеша http2_pool, който е описан в `store.rs` и notes.md"), ("c", None), ("d", "")]
    df = spark.createDataFrame(texts, "id string, text string")
    got = {}
    for r in extract.extract(df, "id").collect():
        got.setdefault(r["id"], set()).add(r["name"])
    assert {"tokio", "rocksdb", "lock-free", "http2"} <= got["a"] and not {"the", "and", "for", "with"} & got["a"]
    assert {"queryplanner", "http2_pool", "store.rs", "notes.md", "заявките"} <= got["b"] and not {"който", "през", "и"} & got["b"]
    assert set(got) == {"a", "b"}
    said = spark.createDataFrame([('The strategy uses lazy loading. A definition "hash ring" of RingStore',), (None,)], "t string").select(extract.concepts(F.col("t")).alias("c"), extract.light_names(F.col("t")).alias("n")).collect()
    assert {"hash ring", "ringstore", "lazy loading"} == set(said[0]["c"]) and "ringstore" in said[0]["n"] and said[1]["c"] is None


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    u = spark.createDataFrame([("s1", "u1", "a"), ("s1", "u2", "b"), ("s2", "u3", "c")], "session_id string, update_id string, title string")
    s.write("update", u)
    s.checkpoint("c1", "s1")
    s.write("update", spark.createDataFrame([("s1", "u1", "changed")], u.schema))
    assert {r["title"] for r in s.read("update", session_id="s1").collect()} == {"changed", "b"}
    s.delete("update", spark.createDataFrame([("s2",)], "session_id string"))
    assert not s.exists("update", session_id="s2")
    s.restore("c1")
    s.compact("update")
    assert {r["title"] for r in s.read("update").collect()} == {"a", "b"}
    other = Store(spark, str(tmp_path / "other"))
    assert s.copy_to(other, dry_run=True) == s.copy_to(other) == {"update": 2, "checkpoint": 2}
    assert other.stats() == {"update": 2, "checkpoint": 2}
    with pytest.raises(ValueError):
        s.add_to_workspace("w", "s1", "boss")


def test_store_reads_the_last_version_before_it_filters(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), buckets=4)
    for name in ("old", "new"):
        s.write("session", spark.createDataFrame([("s1", name)], "session_id string, name string"))
    assert s.read("session", name="old").count() == 0 and not s.exists("session", name="old")
    assert s.read("session", session_id="s1", name="new").count() == 1
    s.compact("session", buckets=2)
    assert s.read("session", session_id="s1").count() == 1 and len(s._generations("session")) == 1
    half = tmp_path / "store" / "session" / "generation-9-2"  # a rewrite that didn't end
    half.mkdir()
    assert s.read("session").count() == 1


def test_store_deletes_what_belongs_to_a_session(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.write("session", spark.createDataFrame([("s1", "a"), ("s2", "b")], "session_id string, name string"))
    s.write("update", spark.createDataFrame([("s1", "u1"), ("s2", "u2")], "session_id string, update_id string"))
    s.write("workspace", spark.createDataFrame([("w", "n")], "workspace_id string, name string"))
    s.add_to_workspace("w", "s1")
    s.add_to_workspace("w", "s2")
    s.checkpoint("c1", "s1")
    s.checkpoint("c2", "s2")
    assert {(r["checkpoint_id"], r["updates"]) for r in s.checkpoints().collect()} == {("c1", 1), ("c2", 1)}
    s.delete("session", spark.createDataFrame([("s1",)], "session_id string"))
    assert [r["update_id"] for r in s.read("update").collect()] == ["u2"]
    assert [r["session_id"] for r in s.read("workspace_session").collect()] == ["s2"]
    s.remove_from_workspace("w", "s2")
    assert not s.exists("workspace_session", workspace_id="w") and s.exists("workspace", workspace_id="w")
    s.delete_workspace("w")
    assert not s.exists("workspace")


def test_versions():
    assert export.compatible("1.0.0") and export.compatible("1.2.0")
    assert not export.compatible("1.3.0") and not export.compatible("2.0.0") and not export.compatible("x")
    assert (export.codec("a.json.gz"), export.codec("a.zst"), export.codec("a"), export.codec("a.gz", "none")) == ("gzip", "zstd", "none", "none")


def test_as_of_join_ties(spark):
    t = [datetime(2025, 1, 1) + timedelta(hours=h) for h in range(4)]
    left = spark.createDataFrame([("k", t[0], 1), ("k", t[2], 2), ("z", t[2], 3)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("k", t[1], "old"), ("k", t[2], "now"), ("k", t[3], "late")], "k string, ts timestamp, v string")
    got = {r["id"]: r["v"] for r in relational.as_of_join(left, right, ["k"], columns=["v"]).collect()}
    assert got == {1: None, 2: "now", 3: None}


def test_cache():
    from sparkloom.operators.retrieval import ResultCache

    class Frame:
        def limit(self, n):
            return self

        def collect(self):
            return ["row"]

    now = [0.0]
    c = ResultCache(size=2, ttl=10, clock=lambda: now[0])
    assert c.search(Frame, [1.0], limit=5, session_id="s") == ["row"] and c.misses == 1
    c.search(Frame, [1.0], limit=5, session_id="s")
    assert c.hits == 1
    c.search(Frame, [1.0], limit=5, session_id="s", bias=0.5)
    assert c.misses == 2  # other arguments, other result
    now[0] = 11
    c.search(Frame, [1.0], limit=5, session_id="s")
    assert c.misses == 3
    c.drop("s")
    assert not c.kept
    for v in range(5):
        c.search(Frame, [float(v)])
    assert len(c.kept) == 2
    c.rows = 0
    with pytest.raises(ValueError):
        c.search(Frame, [9.0])


def test_hashed_vectors(spark):
    from sparkloom.operators.retrieval import hashed_vectors

    t = spark.createDataFrame([(1, "the red fox runs"), (2, "the red fox runs home"), (3, "quite another thing"), (4, None)], "id long, text string")
    v = {r["id"]: np.array(r["vector"]) for r in hashed_vectors(t, "id", width=128).collect()}
    assert v[1] @ v[2] > 0.6 > abs(v[1] @ v[3])
    assert not v[4].any()


def test_connections(spark):
    from sparkloom.operators import retrieval

    e = edges(spark, ("payment", "database"), ("database", "timeout"), ("timeout", "retry"))
    named = spark.createDataFrame([("h1", "s", "payment"), ("h2", "s", "timeout")], "id string, session_id string, name string")
    assert [r["path"] for r in retrieval.connections(named, e, "id").collect()] == [["payment", "database", "timeout"]]
    q = spark.createDataFrame([("s", "database")], "session_id string, name string")
    assert retrieval.query_analysis(q, e).head()["related"] == ["payment", "timeout"]
    hits = spark.createDataFrame([("h1", "s", "the Database, again"), ("h2", "s", "a timeout"), ("h3", "s", "nothing")], "id string, session_id string, text string")
    ent = spark.createDataFrame([("s", n) for n in ("payment", "database", "timeout")], "session_id string, name string")
    # points: 100 to the query's entity, 50 to its neighbour, 10 for Implements (third of the preferred types), 20 for depth 1
    found = {(r["id"], r["source"], r["node"]): (r["relevance"], r["nth"]) for r in retrieval.enriched(hits, q, ent, e, "id").collect()}
    assert found == {("h1", "database", "payment"): (80, 1), ("h1", "database", "timeout"): (80, 2), ("h2", "timeout", "database"): (130, 1), ("h2", "timeout", "retry"): (30, 2)}
    away = e.where("src = 'timeout'").selectExpr("session_id", "'RelatedTo' relation", "dst node", "3 depth")
    assert graph.relevant(away, q, e).count() == 0 and graph.relevant(away, q.where("false"), e).count() == 1


def test_incremental_indexing(spark, tmp_path):
    from sparkloom.streaming import streams

    schema = "update_id string, session_id string, ts timestamp"
    rows = [("u1", "s", datetime(2025, 1, 1)), ("u2", "s", datetime(2025, 1, 1)), ("u2", "s", datetime(2025, 1, 1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stored = spark.createDataFrame([("u1",)], "content_id string")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    streams.index_new(stream, lambda: stored, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "state")).awaitTermination()
    assert [r["update_id"] for r in spark.read.parquet(out).collect()] == ["u2"]


def test_command_line(spark, data, tmp_path, capsys):
    from sparkloom.__main__ import main

    store = str(tmp_path / "store")
    main([store, "load", data])
    main([store, "stats"])
    assert '"session"' in capsys.readouterr().out
    main([store, "export", str(tmp_path / "e"), "--compression", "gzip"])
    main([store, "preview", str(tmp_path / "e")])
    assert '"format_version": "1.2.0"' in capsys.readouterr().out
    main([store, "search", "broken", "--limit", "2"])
    assert len(capsys.readouterr().out.splitlines()) <= 2
    main([store, "migrate", str(tmp_path / "other")])
    with pytest.raises(ValueError):
        main([store, "session", "nope"])


def test_index_maintenance(spark):
    from sparkloom.operators import ann

    r = random.Random(4)
    rows = [(f"{i:03}", [r.gauss(0, 1) for _ in range(16)]) for i in range(120)]
    df = spark.createDataFrame(rows, "content_id string, vector array<float>")
    index = ann.CellIndex(df.where("content_id < '060'"), cells=4)
    bad = [("x1", [1.0] * 3), ("x2", [0.0] * 16), ("x3", None), ("x4", [float("nan")] * 16), (None, [1.0] * 16)]
    refused = index.insert(df.where("content_id >= '060'").unionAll(spark.createDataFrame(bad, df.schema)))
    assert {(x["content_id"], x["reason"]) for x in refused.collect()} == {("x1", "dimension"), ("x2", "zero"), ("x3", "no vector"), ("x4", "not finite"), (None, "no key")}
    index.insert(spark.createDataFrame([("000", rows[1][1])], df.schema))  # replaces
    index.delete(spark.createDataFrame([("001",), ("nobody",)], "content_id string"))
    for again in (index, ann.CellIndex.open(spark, index.path)):
        assert again.table.count() == 119
        top = again.search(spark.createDataFrame([("q", rows[1][1])], "query_id string, vector array<float>"), 1, "exact").head()
        assert (top["content_id"], top["similarity"]) == ("000", 1.0)
    index.rebuild(cells=6)
    again = ann.CellIndex.open(spark, index.path)
    assert again.table.count() == 119 and len(again.centroids) == 6
    index.clear()


def test_cell_index_recall(spark, data):
    from sparkloom.operators import ann

    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(32)] for _ in range(40)]
    rows = [(f"{i:04}", [c + r.gauss(0, 0.4) for c in centres[i % 40]]) for i in range(1500)]
    df = spark.createDataFrame(rows, "content_id string, vector array<float>")
    q = df.where("content_id LIKE '%7'").selectExpr("content_id AS query_id", "vector")
    index = ann.CellIndex(df)
    found, true = ({(x["query_id"], x["content_id"]) for x in index.search(q, 10, m).collect()} for m in ("balanced", "exact"))
    assert len(found & true) / len(true) >= 0.9


def test_export_of_everything(spark, tmp_path):
    s = spark.createDataFrame([("s1", "a")], "session_id string, name string").selectExpr("*", "cast(null as string) description", "timestamp'2025-01-01' created_at", "timestamp'2025-01-02' last_updated")
    u = spark.createDataFrame([], model.struct(session_id=model.S, update_id=model.S, ts=model.TS, update_type=model.S, title=model.S, description=model.S, details=model.STRINGS, examples=model.STRINGS, implications=model.STRINGS, related_code=model.CODE_REFERENCE, parent_update=model.S, important=model.B, creates_entities=model.STRINGS, creates_relationships=model.UPDATE["creates_relationships"].dataType, references_entities=model.STRINGS))
    e = spark.createDataFrame([("c1", "s1", [0.5, -0.25], "t", "CodeSnippet", datetime(2025, 1, 1), {"k": "v"})], model.EMBEDDING)
    w = spark.createDataFrame([("w1", "n", None, [("s1", "primary")], 5)], model.WORKSPACE)
    k = spark.createDataFrame([("k1", "s1", "u1")], export.PARTS["checkpoints"])
    path = str(tmp_path / "all.gz")
    export.write_export(s, u, path, parts={"embeddings": e, "workspaces": w, "checkpoints": k})
    assert [export.read_part(spark, path, n).collect() for n in ("embeddings", "workspaces", "checkpoints")] == [x.collect() for x in (e, w, k)]
    export.write_export(s, u, str(tmp_path / "less"))
    assert export.read_part(spark, str(tmp_path / "less"), "workspaces").count() == 0


def test_bulk_update_and_dry_run(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.write("session", spark.createDataFrame([("s1", "a")], "session_id string, name string"))
    rows = [("u1", "s1", "qa", {"question": "why", "answer": "so"}), ("u2", "s1", "nonsense", {}), ("u3", "s9", "qa", {"question": "q"}), (None, "s1", "qa", {"question": "q"})]
    df = spark.createDataFrame(rows, "update_id string, session_id string, interaction_type string, content map<string,string>")
    want = {"u1": None, "u2": "Unknown interaction type: nonsense", "u3": "Session not found: s9", None: "No update id"}
    assert {r["update_id"]: r["error"] for r in context.bulk_update(df, s, dry_run=True).collect()} == want and not s.exists("update")
    assert {r["update_id"]: r["error"] for r in context.bulk_update(df, s).collect()} == want
    assert [r["update_id"] for r in s.read("update").collect()] == ["u1"]


def test_words_of_texts_are_not_broadcast(spark, tmp_path):
    texts = [(f"u{i}", "st"[i % 2], " ".join(f"w{i * k % 977}," for k in range(200))) for i in range(300)] + [("v", "s", None), ("w", None, "w5 w5"), ("x", "s", "(W5) \u00c9t\u00e9. a")]
    names = [("s", f"W{i}") for i in range(0, 977, 5)] + [("s", "w5"), ("t", "w7"), ("t", ""), ("s", "\u00e9T\u00c9"), ("s", "a")]
    spark.createDataFrame(texts, "update_id string, session_id string, text string").write.parquet(f"{tmp_path}/texts")
    spark.createDataFrame(names, "session_id string, name string").write.parquet(f"{tmp_path}/names")
    out = graph.text_entities(spark.read.parquet(f"{tmp_path}/texts"), spark.read.parquet(f"{tmp_path}/names"), "update_id")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()  # words are taken for far fewer than they are
    bare = {(u, s): {w.strip(",.()").lower() for w in (t or "").split()} for u, s, t in texts}
    want = sorted((u, s, n) for (u, s), ws in bare.items() for o, n in names if o == s and len(n.encode()) > 1 and n.lower() in ws)
    assert want and sorted(tuple(r) for r in out.collect()) == want


def hits_and_graph(spark, folder):
    for name, rows, schema in (
        ("hits", [("u", "s", "Cache, of the (parser)"), ("v", "s", "nothing"), ("w", "t", "cache")], "update_id string, session_id string, text string"),
        ("entities", [("s", "cache"), ("s", "Parser"), ("t", "index")], "session_id string, name string"),
        ("edges", [("s", "cache", "index", "DependsOn"), ("s", "Parser", "cache", "Solves")], E),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}")
    return [spark.read.parquet(f"{folder}/{name}") for name in ("hits", "entities", "edges")]


def test_enriched_joins_no_exploded_words(spark, tmp_path):
    hits, entities, e = hits_and_graph(spark, tmp_path)
    out = retrieval.enriched(hits, e.select("session_id", F.col("src").alias("name")).where("name = 'cache'"), entities, e, "update_id")
    assert "explode(split" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r["update_id"], r["source"], r["relation"], r["node"], r["relevance"], r["nth"]) for r in out.orderBy("nth").collect()]
    assert got == [("u", "Parser", "Solves", "cache", 120, 1), ("u", "cache", "DependsOn", "index", 90, 2), ("u", "cache", "inverse_Solves", "Parser", 70, 3)]


def test_expanded_search_joins_no_exploded_words(spark, tmp_path):
    hits, entities, e = hits_and_graph(spark, tmp_path)
    words, named, paths = retrieval.expanded_search(hits, "cache parser", entities, e, "update_id")
    assert "explode(split" not in named._jdf.queryExecution().executedPlan().toString()
    got = {(r["update_id"], r["name"]): r["related"] for r in named.collect()}
    assert got == {("u", "cache"): ["Parser", "index"], ("u", "Parser"): ["cache"]}
    assert [r["path"] for r in paths.collect()] == [["Parser", "cache"]]
