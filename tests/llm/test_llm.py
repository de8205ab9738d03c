"""Small cases of every training-data operator: against brute force, exact round trips, edge cases."""

import json
import random
import re
import shutil
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import alike, bpe, history, mixture, queries, residue, split, topn, triples, vectors
from tests.oracle import connect, same

TOK = Path(bpe.TOKENIZERS, f"{bpe.NAME}.json")


def words_of(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def triple_set(text):
    w = words_of(text)
    return {*zip(w, w[1:], w[2:])} if len(w) >= 8 else set()


def is_alike(a, b):
    a, b = triple_set(a), triple_set(b)
    return bool(a and b) and 2 * len(a & b) >= len(a | b)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(5, 40))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.3:
            k = r.randrange(len(w))
            w = w[k:] + w[:k]  # reordered
        out.append(" ".join(w))
    return [*out, None, "", "   ", "x" * 5000, "aa " * 4000, "aa " * 4000, "Ünï çödé wörds ärë spl it hére ánd thére ok"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, data, name):
    same(spark, connect(data), data, queries.QUERIES[name], queries.ORACLE[name])


def test_triples_against_plain_python():
    texts = [*corpus(60, 1), "K K K one two three four five", "İstanbul a b c d e f g h"]
    import pyarrow as pa

    values, offsets = triples.triple_sets(pa.array(texts, pa.string()))
    assert [int(x) for x in np.diff(offsets)] == [len(triple_set(t)) for t in texts]
    a, b = pa.array(texts[:40], pa.string()), pa.array(texts[1:41], pa.string())
    both, union = triples.shared(a, b)
    for x, y, s, u in zip(texts[:40], texts[1:41], both, union):
        assert (s, u) == (len(triple_set(x) & triple_set(y)), len(triple_set(x) | triple_set(y)))


def test_alike_pairs_against_brute_force(spark):
    texts = corpus(90, 2)
    rows = [(f"{i:03d}", t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], "clash")]
    df = spark.createDataFrame(rows, "content_id string, text string, cls string")
    got = {tuple(r) for r in alike.alike_pairs(df).collect()}
    keyed = [(k, t) for k, t, _ in rows if k]
    want = {(a, b) for i, (a, s) in enumerate(keyed) for b, t in keyed[i + 1 :] if is_alike(s, t)}
    assert got == want and want
    assert alike.alike_pairs(df.where("false")).count() == 0


def test_content_texts_takes_last_export(spark):
    e = spark.createDataFrame([(1, "AA-1", "old"), (2, "aa1", "new"), (3, "aa1", None), (4, None, "x")], "row_id long, content_id string, text string")
    r = spark.createDataFrame([(1, "aa1", "other"), (2, " urn:uuid:B2 ", "only"), (3, "b2", None)], "result_id long, content_id string, text_content string")
    assert {tuple(x) for x in alike.content_texts(e, r).collect()} == {("aa1", "new"), ("b2", "only")}


def in_order(items):
    seen, texts, out = set(), [], set()
    for ordinal, key, text in items:
        if (key is not None and key in seen) or any(is_alike(text, t) for t in texts):
            out.add(ordinal)
            continue
        texts.append(text)
        if key is not None:
            seen.add(key)
    return out


def test_repeats_against_sequential(spark):
    r, texts = random.Random(3), corpus(120, 4)
    keys = [r.choice([None, *(f"{i:032x}" for i in range(60))]) for _ in texts]
    rows = [("embedding", r.randint(0, 3), i, 0, k, 0, t) for i, (k, t) in enumerate(zip(keys, texts))]
    # the same texts in another realm must not meet the first
    rows += [("update", 0, 5000 + i, i, f"{i:032x}", 1, t) for i, t in enumerate(texts[:10])]
    df = spark.createDataFrame(rows, "kind string, batch_no int, row_id long, item_no int, id string, realm int, text string")
    got = {(x["kind"], x["row_id"], x["item_no"]) for x in history.repeats(df).collect()}
    want = set()
    for kind in ("embedding", "update"):
        own = sorted((x for x in rows if x[0] == kind), key=lambda x: x[1:4])
        want |= {(kind, *o) for o in in_order([((x[2], x[3]), x[4], x[6]) for x in own])}
    assert got == want
    assert history.repeats(df.where("false")).count() == 0


def test_small_waiting_batches_are_admitted_together_in_order(spark, monkeypatch):
    r, texts = random.Random(5), corpus(180, 12)
    keys = [r.choice([None, *(f"{i:032x}" for i in range(90))]) for _ in texts]
    # later rows come in earlier batches, so that the order is the batches', not the rows'
    rows = [("embedding", [None, *range(1, 9)][max(0, 8 - i // 10)], i, 0, k, 0, t) for i, (k, t) in enumerate(zip(keys, texts))]
    df = spark.createDataFrame(rows, "kind string, batch_no int, row_id long, item_no int, id string, realm int, text string")
    turns, admit = [], history.SegmentIndex.admit
    monkeypatch.setattr(history.SegmentIndex, "admit", lambda self, batch: turns.append(sorted(x[0] for x in batch.select("turn").distinct().collect())) or admit(self, batch))
    got = {x["row_id"] for x in history.repeats(df).collect()}
    assert turns == [[0], [0, 1, 2, 3, 4], [0, 1, 2]]  # 100 items, then 10 a batch
    assert got == {o for o, _ in in_order([((x[2], 0), x[4], x[6]) for x in sorted(rows, key=lambda x: (x[1] or 0, x[2]))])}
    assert history.taken_together([]) == [] and history.taken_together([0, 0, 4, 2, 1]) == [[0, 1], [2], [3], [4]]
    assert max(map(len, history.taken_together([10**6] + [1] * 200))) == history.MOST_TOGETHER


def strings_of(spark, index, texts):
    rows = spark.createDataFrame([(t, 0) for t in texts], "text string, realm int")
    classes = history.hashed(rows, ["text", "realm"]).where("cls IS NOT NULL").dropDuplicates(["cls"]).cache()
    return history.canonical(classes, index.order(classes)).cache(), {r["cls"]: r["text"] for r in classes.collect()}


def test_segment_index_opened_again(spark, tmp_path):
    texts = [t for t in corpus(400, 6) if triple_set(t)]
    nobody = spark.createDataFrame([], "id string")
    early = history.SegmentIndex(spark, str(tmp_path))
    assert early.stored() == {}
    first = history.SegmentIndex(spark, str(tmp_path))
    strings, old = strings_of(spark, first, texts[::3])
    assert first.probe(strings).count() == 0
    first.append(strings, nobody)
    for index in (early, history.SegmentIndex(spark, str(tmp_path), buckets=99)):  # the stored number of buckets holds
        index.stored()
        strings, new = strings_of(spark, index, texts[1::3])
        want = {(a, b) for a, s in new.items() for b, t in old.items() if is_alike(s, t) and a != b}
        assert want and {(r["x"], r["y"]) for r in index.probe(strings.where(~F.col("cls").isin(list(old)))).collect()} == {w for w in want if w[0] not in old}
    (tmp_path / "levels").rename(tmp_path / "lost")
    with pytest.raises(ValueError):
        history.SegmentIndex(spark, str(tmp_path))


def test_batches_admitted_by_an_index_opened_each_time(spark, tmp_path):
    r, texts = random.Random(9), [t for t in corpus(160, 7)]
    rows = [("a", i, 0, r.choice([None, f"{r.randint(0, 90):x}"]), 0, t) for i, t in enumerate(texts)]
    size, got = 40, set()
    for k in range(0, len(rows), size):
        source = str(tmp_path / f"batch{k}")
        spark.createDataFrame(rows[k : k + size], "kind string, row_id long, item_no int, id string, realm int, text string").write.parquet(source)
        index = history.SegmentIndex(spark, str(tmp_path / "index"))
        got |= {x["row_id"] for x in index.admit(spark.read.parquet(source)).collect()}
        shutil.rmtree(source)  # no text of an earlier batch is read again
    assert got == in_order([(x[1], x[3], x[5]) for x in rows])
    kept = {f.name: spark.read.parquet(str(f)).columns for f in (tmp_path / "index").iterdir() if f.name not in ("begun", "commits")}
    assert set(kept) == {"levels", "segments", "strings", "ids"} and not any("text" in c for c in kept.values())


def test_what_a_broken_append_leaves_is_not_read(spark, tmp_path):
    texts = [t for t in corpus(60, 8) if triple_set(t)]
    index = history.SegmentIndex(spark, str(tmp_path))
    strings, _ = strings_of(spark, index, texts)
    index.append(strings.limit(5), spark.createDataFrame([("a",)], "id string"))
    n = {k: v.count() for k, v in index.stored().items()}
    index._mark("begun", 1)
    broken = history.segments(strings).withColumn("part", F.lit(1).cast("long"))
    broken.write.insertInto(index._table("segments"))
    assert {k: v.count() for k, v in index.stored().items()} == n


def test_stored_segments_are_not_shuffled(spark, tmp_path):
    texts = [t for t in corpus(60, 8) if triple_set(t)]
    index = history.SegmentIndex(spark, str(tmp_path), buckets=4)
    strings, _ = strings_of(spark, index, texts)
    index.append(strings, spark.createDataFrame([], "id string"))
    plan = history.meet(history.probes(strings).hint("shuffle_hash"), index.stored()["segments"])._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan ==") :]
    assert "SelectedBucketsCount: 4 out of 4" in plan and plan.count("Exchange hashpartitioning(segment") == 1  # of the probing side


def test_a_batch_takes_fewer_tasks_than_shuffle_partitions(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", 60)
    index = history.SegmentIndex(own, str(tmp_path))
    assert index.buckets == 20  # more than the four cores
    strings, _ = strings_of(own, index, [t for t in corpus(60, 8) if triple_set(t)])
    index.append(strings, own.createDataFrame([], "id string"))
    own.conf.set("spark.sql.shuffle.partitions", 30)
    again = history.SegmentIndex(own, str(tmp_path))
    assert again.buckets == 20
    for session in (again.steady, again.wide):
        probing = session.createDataFrame([(1, 2, 3, 0)], history.TABLES["segments"][1])
        plan = history.meet(probing.hint("shuffle_hash"), again.stored(session)["segments"])._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 20 out of 20" in plan and "hashpartitioning(segment" in plan and plan.count("Exchange hashpartitioning(segment") == 1


@pytest.mark.parametrize("how", [history.accept_in_order, history.accept_in_one_task])
def test_accept_long_chain(spark, how):
    items = spark.createDataFrame([(i, None, i) for i in range(12)], "ord long, id string, cls long").withColumn("ord", F.col("ord").cast("decimal(38,0)"))
    links = spark.createDataFrame([(i, i + 1) for i in range(11)], "x long, y long")
    assert sorted(r[0] for r in how(items, links).collect()) == [0, 2, 4, 6, 8, 10]


def test_rounds_decide_as_one_task_does(spark):
    r = random.Random(13)
    rows = [(i, r.choice([None, *"abcdefghij"]), r.choice([None, *range(30)])) for i in range(120)]
    items = spark.createDataFrame(rows, "ord long, id string, cls long").withColumn("ord", F.col("ord").cast("decimal(38,0)")).where("id IS NOT NULL OR cls IS NOT NULL").groupBy("id", "cls").agg(F.min("ord").alias("ord"))
    links = spark.createDataFrame([(i, j) for i in range(30) for j in range(i) if r.random() < 0.08], "x long, y long")
    one, more = ({int(x["ord"]) for x in how(items, links).collect()} for how in (history.accept_in_one_task, history.accept_in_order))
    assert one == more


def test_top_n_ties_nulls_and_clashes(spark):
    rows = [("g", i, 0.5, "x", i % 3) for i in range(30)] + [("h", 99, float("nan"), "x", 1), (None, 7, 0.1, None, None)]
    df = spark.createDataFrame(rows, "g string, id long, score double, rank string, item int")
    order = [F.col("score").desc(), F.col("id").asc()]
    got = topn.top_n_per_group(df, ["g"], order, 4)
    assert sorted(r["id"] for r in got.where("g = 'g'").collect()) == [0, 1, 2, 3]
    assert sorted(r["id"] for r in topn.top_n_per_group(df, ["g"], order, 4, ["item"]).where("g = 'g'").collect()) == [0, 1, 2]
    assert topn.top_n_per_group(df, ["g"], order, 4, ["item"]).where("g IS NULL").count() == 1
    assert topn.top_n_per_group(df.where("false"), ["g"], order, 4).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, ["g"], order, 0)


def rebuilt(text, pieces):
    return "".join(text[max(s, pieces[i - 1][1] if i else 0) : e] for i, (s, e) in enumerate(pieces))


def test_cut_properties():
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(["word", "x" * r.randint(1, 60), " ", ". ", "\n", "\n\n", "。", "é", "\r\n"]) for _ in range(r.randint(1, 80)))
        limit = r.randint(2, 60)
        overlap = r.randint(0, limit - 1)
        pieces = split.cut(text, limit, overlap)
        assert all(0 < e - s <= limit for s, e in pieces) or not text
        assert rebuilt(text, pieces) == text
        for (_, before), (start, _) in zip(pieces, pieces[1:]):
            assert start == max(0, before - overlap)
    assert split.cut("One two. Three four five.", 16, 0) == [(0, 9), (9, 25)]
    with pytest.raises(ValueError):
        split.cut("abc", 2, 2)


def test_split_oversized(spark):
    limits = spark.createDataFrame([("default", 20, 4), ("A", 8, 0)], "content_type string, max_text_length int, overlap_chars int")
    rows = [(1, "A", "  12345678 \n"), (2, "A", "123456789"), (3, None, "x" * 21), (4, "nope", ""), (5, "A", None), (6, "nope", "y" * 20)]
    got = split.split_oversized(spark.createDataFrame(rows, "row_id long, content_type string, text string"), limits, "row_id")
    assert {r["row_id"]: r["n_pieces"] for r in got.collect()} == {1: 1, 2: 2, 3: 2, 6: 1}
    with pytest.raises(ValueError):
        split.split_oversized(spark.createDataFrame(rows, "row_id long, content_type string, text string"), limits.where("content_type = 'A'"), "row_id")


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 128))
    x = np.concatenate([b + s * rng.standard_normal((6, 128)) for b in base for s in (0.3,)]).astype(np.float32)
    keys = [f"{i:04x}" for i in range(len(x))]
    rows = [(k, v.tolist()) for k, v in zip(keys, x)] + [(f"c{i:03x}", x[0].tolist()) for i in range(9)]  # copies
    rows += [("bad1", None), ("bad2", [0.0] * 128), ("bad3", [1.0] * 5), ("bad4", [float("nan")] * 128), (None, x[1].tolist()), ("0001", (3 * x[1]).tolist())]
    df = spark.createDataFrame(rows, "content_id string, vector array<float>")
    got = {(r["content_a"], r["content_b"]) for r in vectors.nearest(df, "content_id", "vector").collect()}
    good = {k: np.array(v, np.float64) for k, v in reversed(rows[: len(x) + 9])}
    names = sorted(good)
    u = np.array([good[k] / np.linalg.norm(good[k]) for k in names])
    c = (u @ u.T).round(6)
    want = set()
    for i, k in enumerate(names):
        order = sorted((j for j in range(len(names)) if j != i and c[i, j] >= 0.85), key=lambda j: (-c[i, j], names[j]))[:5]
        want |= {tuple(sorted((k, names[j]))) for j in order}
    assert len(got & want) / len(want) >= 0.99 and len(got - want) / len(got) <= 0.01
    assert vectors.nearest(df.where("false"), "content_id", "vector").count() == 0


def test_table_scan_scores():
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 128)).astype(np.float32)
    index = vectors.Quantiser(x, 3, 0.85)
    u = vectors.unit(x).astype(np.float32)
    home = np.sort(index.near(u, 1)[:, 0])
    u = u[np.argsort(index.near(u, 1)[:, 0], kind="stable")]
    code = vectors.encode(u, u - index.cells[home], index.book)
    packed = np.ascontiguousarray(((code[:, 0::2] << 4) | code[:, 1::2]).T)
    index.bound = 0.1
    got = {(q, r): s for b in index.scan(u[:300], packed, home) for q, r, s in zip(*b)}
    true = u[:300] @ (index.cells[home] + vectors.decode(code, index.book)).T
    assert all(abs(true[k] - s) < 0.05 for k, s in got.items()) and {(i, i) for i in range(300)} <= set(got)
    assert {tuple(k) for k in np.argwhere(true > 0.15).tolist()} <= set(got)


def test_nearest_in_one_dense_cluster(spark):
    rng, n, k = np.random.default_rng(12), 5000, 5
    x = (rng.standard_normal(128) + 0.3 * rng.standard_normal((n, 128))).astype(np.float32)
    pdf = pd.DataFrame({"cls": np.arange(n), "first": np.arange(n), "vector": [v.tolist() for v in x]})
    classes = spark.createDataFrame(pdf, "cls long, first long, vector array<float>").cache()
    pairs = vectors.close_pairs(classes, 0.85, k).toPandas()
    assert len(pairs) <= n * (k + 1 + 2 * vectors.SPILL * vectors.RERANK)  # not n * n
    u = vectors.unit(x)
    c = u @ u.T
    np.fill_diagonal(c, -1)
    want = {(min(i, j), max(i, j)) for i, row in enumerate(np.argpartition(-c, k, axis=1)[:, :k].tolist()) for j in row}
    got = set(zip(pairs["a"].tolist(), pairs["b"].tolist()))
    print(len(pairs), len(got & want) / len(want))
    assert len(got & want) / len(want) >= 0.9


def test_equal_cosines_take_the_smaller_key(spark):
    x = np.zeros((40, 128), np.float32)
    x[:, 0], x[np.arange(40), 1 + np.arange(40)] = 1, 0.1  # each pair has the same cosine
    df = spark.createDataFrame([(f"{i:02}", v.tolist()) for i, v in enumerate(x)], "content_id string, vector array<float>")
    got = {(r["content_a"], r["content_b"]) for r in vectors.nearest(df, "content_id", "vector", k=3).collect()}
    want = {tuple(sorted((f"{i:02}", f"{j:02}"))) for i in range(40) for j in [j for j in range(5) if j != i][:3]}
    assert got == want


@pytest.mark.skipif(not TOK.exists(), reason="no vocabulary files")
def test_bpe_against_library(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(TOK))
    t.encode_special_tokens = True
    own = ["", None, " ", "<|endoftext|> x", "a" * 300, "\x1c \x85  x", "日本語 😀👍🏽", "it's  \n\n X'S 123ab", "ééé é"]
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-i - 1, x) for i, x in enumerate(own)], "doc_id long, text string"))
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_corpus(df).collect()}
    rows = df.collect()
    want = {r["doc_id"]: e.ids for r, e in zip(rows, t.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False))}
    assert got == want
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df, ["doc_id"]).collect()}
    assert n == {k: len(v) for k, v in want.items()}
    assert bpe.encode_corpus(df.where("false")).count() == 0


def test_byte_letters_are_those_of_the_vocabulary():
    if TOK.exists():
        vocab = json.loads(TOK.read_text(encoding="utf-8"))["model"]["vocab"]
        assert len(set(bpe.byte_letters())) == 256 and all(c in vocab for c in bpe.byte_letters())


def test_water_fill():
    part = mixture.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 100, "c": 100}, 100)
    assert part["a"] == 10 and part["b"] == pytest.approx(54) and part["c"] == pytest.approx(36)
    assert mixture.water_fill({"a": 1.0}, {"a": 5}, 100) == {"a": 5}
    assert mixture.water_fill({"a": 1.0, "b": 1.0}, {"a": 0, "b": 9}, 8) == {"a": 0, "b": 8}


def test_mix_reaches_shares(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None, "unlisted"]), r.randint(0, 50)) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 5), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(sized, targets, "doc_id").cache()
    size = {x[0]: x[2] for x in rows}
    caps = {"a": 1, "b": 2, "c": 5}
    used: dict = {}
    for x in mixed.collect():
        assert 1 <= x["times"] <= caps[x["source"]]
        used[x["source"]] = used.get(x["source"], 0) + x["times"] * size[x["doc_id"]]
    total = sum(used.values())
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert used[s] / total == pytest.approx(w / 0.9, abs=0.005)
    report = {x["source"]: x for x in mixture.shares(mixed, targets).collect()}
    assert report["none"]["n_tokens"] == 0 and report["a"]["n_tokens"] == used["a"]
    everything = mixture.mix(sized, targets, "doc_id", total=1e12)  # all caps reached
    assert {x["source"]: x["n"] for x in everything.groupBy("source").agg(F.min("times").alias("n")).collect()}["a"] == 1
    assert mixture.mix(sized.where("false"), targets, "doc_id").count() == 0


def test_full_mixture_clamps_and_redistributes(spark, data):
    sized = {r["source"]: r["n"] for r in mixture.sized_documents(spark, data).groupBy("source").agg(F.sum("size").alias("n")).collect()}
    targets = spark.read.parquet(f"{data}/mix_target.parquet").collect()
    room = {r["source"]: (sized.get(r["source"]) or 0) * r["max_repeats"] for r in targets}
    want = mixture.water_fill({r["source"]: r["target_share"] for r in targets}, room, sum(sized.get(r["source"]) or 0 for r in targets))
    got = {r["source"]: r for r in queries.QUERIES["p7_shares_full"](spark, data).collect()}
    largest = spark.read.parquet(f"{data}/documents.parquet").agg(F.max(F.octet_length("text"))).head()[0]
    assert any(0 < want[s] == room[s] for s in room)  # some are clamped
    for s in want:
        assert abs(got[s]["n_tokens"] - want[s]) <= largest


def test_residue(spark, data):
    prose = " ".join(f"The careful gardener number {i} carries a blue basket over the old wooden bridge before the rain begins again." for i in range(12))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text").where("text IS NOT NULL")
    model = residue.fit([r[0] for r in docs.where("length(text) >= 500").limit(300).collect()] + [prose] * 5)
    cases = {
        1: ("Page not found\nThe link you followed leads nowhere, or the page was removed.", True),
        2: ("Please enable JavaScript to see this page.", True),
        3: (f"{prose[:200]}\nLorem ipsum dolor sit amet consectetur adipiscing elit. Your text goes here. Type your headline here", True),
        4: ("Dear {{ first_name }}, thank you for choosing {{company}}.\nBuy {product} for only ${price}!", True),
        5: (prose, False),
        6: (f"{prose} The log shows “Page not found” now and then. {prose}", False),
        7: (None, False),
        8: (" \n\t", False),
        9: ("", False),
        10: (prose * 200, False),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["is_residue"] for r in residue.residue(df, model=model).collect()}
    assert got == {k: v[1] for k, v in cases.items()}
    twice = residue.residue(df.unionAll(df).withColumn("h1", F.lit("clash")))  # fitted on these texts, copies measured once
    assert twice.count() == 2 * len(cases) and {r["doc_id"]: r["is_residue"] for r in twice.collect() if r["doc_id"] in (5, 7, 8, 9)} == dict.fromkeys((5, 7, 8, 9), False)
    assert residue.residue(df.where("false"), model=model).count() == 0


def test_residue_is_fitted_on_all_rows(spark):
    r = random.Random(8)
    vocabularies = [["".join(r.choice(a) for _ in range(r.randint(2, 9))) for _ in range(80)] for a in ("abcdefgh", "klmnopqr", "ивзклмно")]
    texts = [" ".join(r.choice(v) for _ in range(150)) for v in vocabularies for _ in range(600)]  # sorted by language
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = residue.fit(texts)
    for other in (df, df.orderBy(F.xxhash64("text")).repartition(3), df.unionAll(df.limit(600)), df.unionAll(spark.createDataFrame([(None,), ("",), ("short",)], "text string"))):
        got, forms = residue.fit_corpus(other)
        assert forms.count() >= len(texts)
        assert np.array_equal(got.kinds, want.kinds) and np.array_equal(got.field, want.field)
        assert got.bounds == pytest.approx(want.bounds, abs=2 / residue.BINS_BY_1)
    empty, _ = residue.fit_corpus(df.where("false"))
    assert np.array_equal(empty.kinds, residue.fit([]).kinds) and empty.bounds == residue.fit([]).bounds
