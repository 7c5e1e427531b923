"""Archive, conversations, neighbours, classifiers, the pipeline and the registered SQL."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import corpus_pipeline
from fleetwatch.llm import chat, neighbours, quality, queries, toxicity, warc
from tools.check_sql import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "u5", "é" * 5000),
            (None, "u", "<p>a</p>"), (2, "u2", "<p>a</p>"), (7, "u7", "WARC/1.1\r\n\r\n"), (-8, "u8", "neg")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, pages):
    archive = warc.write_archive(pages)
    got = sorted([tuple(r) for r in warc.page_digests(warc.read_archive(spark, archive)).collect()], key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    a, e, big, w, neg = "<p>a</p>", "", "é" * 5000, "WARC/1.1\r\n\r\n", "neg"
    row = lambda i, t, kind, ref: (i, len(t.encode()), sha(t), kind, ref)
    assert got == sorted([row(1, a, "revisit", 2), row(2, a, "response", None), row(2, a, "revisit", 2), row(None, a, "revisit", 2),
                          row(3, e, "revisit", 4), row(4, e, "response", None), row(5, big, "response", None), row(7, w, "response", None),
                          row(-8, neg, "response", None)], key=str)
    assert spark.read.parquet(archive.payloads).count() == 5
    record = warc.record_bytes(warc.read_archive(spark, archive)).where("header LIKE '%urn:page:7>%'").first()["record"]
    head, http, body = bytes(record).split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and http.startswith(b"HTTP/1.1 200") and body == w.encode() + b"\r\n\r\n"
    assert f"Content-Length: {len(http) + len(body)}".encode() in head
    assert warc.page_digests(warc.read_archive(spark, warc.write_archive(pages.limit(0)))).count() == 0


def test_warc_refuses_altered_payloads(spark, pages, tmp_path):
    archive = warc.write_archive(pages, str(tmp_path / "a"))
    changed = spark.read.parquet(archive.payloads).withColumn("payload", F.concat("payload", F.lit(b"!")))
    changed.write.parquet(str(tmp_path / "b"))
    with pytest.raises(PySparkException):
        warc.page_digests(warc.read_archive(spark, warc.Archive(archive.headers, str(tmp_path / "b")))).collect()


def test_conversations_with_control_strings(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\<|", "<\\|im_end|>", "a\n\nb", None, "", "<", "|>", "<<||>>\\\\|", "é漢🙂"]
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "odd\nrole\\", None]), rnd.choice(texts), 0)
            for c in (1, 2, 3, None, 70) for t in range(40 if c == 70 else 4)]
    rows += [(9, 0, "assistant", "same", 0), (9, 0, "assistant", "same", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree int")
    got = {r["tree"]: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c]["trained"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert chat.digests(chat.read_back(chat.format_conversations(table.limit(0)))).count() == 0


def test_reply_trees(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5),
             (1, 5, 4, "assistant", "x", 0.4), (1, 6, 4, "assistant", "y", 0.4), (1, 7, 2, "user", "deep", 0.2),
             (2, 1, 99, "user", "orphan", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0)]
    table = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    best = chat.paths(table)
    walk = {}
    for r in best.collect():
        walk.setdefault((r["tree"], r["leaf"]), {})[r["up"]] = r["node"]
    assert walk == {(1, 5): {0: 5, 1: 4, 2: 3, 3: 1}, (2, 1): {0: 1}}
    assert {r["leaf"] for r in chat.paths(table, None).where("tree = 1").collect()} == {5, 6, 7}
    texts = {r["tree"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.format_paths(table, best)).collect()}
    assert texts == {1: ["q", "good", "more", "x"], 2: ["orphan"]}


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]].tolist()
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s[ids == v][0] - score) < 1e-12 for _, v, score in found)
        hit, total = hit + len({v for _, v, _ in found} & set(best)), total + 20
    assert hit / total >= 0.9


def test_neighbours_odd_vectors(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(12)] + [(20, None), (21, [0.0, 0.0]), (22, [float("nan"), 1.0]), (23, [None, 1.0]),
            (24, [float("inf"), 1.0]), (25, [1.0]), (26, []), (None, [1.0, 1.0]), (3, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, list int")
    got = sorted(tuple(r) for r in neighbours.search(table, F.col("vec_id") < 2, 5).collect())
    best = lambda q: sorted(((-(1.0 + (i % 3) * (q % 3)), i) for i in range(12) if i != q))[:5]
    assert [(q, r, v, s) for q, r, v, s in got] == [(q, k + 1, i, -s) for q in (0, 1) for k, (s, i) in enumerate(best(q))]
    assert neighbours.search(table, F.col("vec_id") == 0, 50).count() == 11
    assert neighbours.search(table.limit(0), F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert neighbours.search(one, F.lit(True)).count() == 0


def test_common_vector_is_found_whole(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    rows = [(i, [1.0, 0.0] if i < 300 else [float(i % 7) / 7, 1.0]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") % 20 == 0).where("query_id = 40").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(21) if i != 40][:20]


def test_neighbours_visit_a_quarter_of_the_lists(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(neighbours, "LIST_ROWS", 16)
    keep = neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df, purpose: seen.setdefault(purpose, keep(df, purpose)))
    x = np.random.default_rng(1).normal(size=(1600, 48))  # without clusters the cap decides, not the distance ratio
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    neighbours.search(table, F.col("vec_id") % 20 == 0)
    visits = [r["count"] for r in seen["queries"].groupBy("id").count().collect()]
    assert len(visits) == 80 and max(visits) == 1600 // 16 // 4


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.report(docs, labels).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 500 and right / n >= 0.95


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = {"poor": 1 - F.col("quality"), "toxic": F.col("toxic")}
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 0"), chain)
    got = toxicity.score(docs, model, list(chain)).join(labels, "doc_id").where("doc_id % 4 = 0").toPandas()
    flagged = got["toxic_score"] >= toxicity.THRESHOLD
    assert flagged[got["toxic"] == 1].mean() >= 0.75  # about 350 toxic texts to learn from
    assert flagged[got["toxic"] == 0].mean() <= 0.01


def test_classifiers_odd_input(spark):
    rows = [(1, None), (2, ""), (3, "good words here"), (None, "x"), (4, "BAD!! BAD!! BAD!!"), (4, "BAD!! BAD!! BAD!!"), (5, "\x00\n")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (4, 1, 1), (2, None, None), (1, 7, 0), (None, 1, 1)],
                                  "doc_id long, quality int, toxic int")
    for labels in (marks, marks.limit(0), marks.where("doc_id = 3")):
        a = quality.report(docs, labels).collect()
        b = toxicity.report(docs, labels).collect()
        assert len(a) == len(b) == len(rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in a)
        assert all(0 <= r["toxic_score"] <= 1 for r in b)
    assert quality.report(docs.limit(0), marks).count() == toxicity.report(docs.limit(0), marks).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, "12 !!", "en", "s", 5)], docs.schema)
    docs = docs.union(extra)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    left = {r["doc_id"] for r in docs.collect()}
    assert left and not left & {90001, 90002, 90003}
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in tokens.collect()} == left
    assert corpus_pipeline.run(spark, SF).count() == len(left)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, extra.limit(0), SF).count() == 0, name
