"""Operators 11 to 13 against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwatch.llm import manifest, mixing, negatives, queries
from fleetwatch.llm.ordered import running_sums

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, part_ string, `before` int"


def null_first(x):
    return (x is not None, x)


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    rows = [(i, "Word " * rnd.choice([1, 3, 9, 40]) + str(i), "en", rnd.choice(["a", "a", "a", "b", "é", None]), i) for i in range(300)]
    rows += [(400, None, None, "a", None), (401, "", "en", "b", 0), (None, "no Id", "en", "a", 5), (None, "other", "en", "a", 5),
             (402, "A b c\u0085d", None, None, 3), (403, "long " * 3000, "en", "c", 1), (404, "", "en", "empty", 0)]
    rows += [(7, "same Row", "en", "a", 8)] * 40 + [(7, "same id", "en", "a", 8)]
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS)


def test_running_sums_split_one_group(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit(None).cast("string").alias("g"), (F.col("id") % 5).alias("n")).repartition(6)
    got = sorted((r["k"], r["before"], r["n"], r["whole"]) for r in running_sums(rows, ["g"], ["k", "n"], "n").collect())
    at, want = 0, []
    for k, n in sorted((i % 7, i % 5) for i in range(1000)):
        want.append((k, at, n, 2000))
        at += n
    assert got == sorted(want)


def filled(sizes, weights=(1, 2, 3)):
    """Shares by weight; what is above three times a source's size goes round again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix_meets_its_targets(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    want = filled(sizes)
    got = mixing.plan(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.md5(F.concat_ws("|", "doc_id", "text")).alias("key"))).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r["doc_id"], r["source"], size(r["text"])) for r in rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    longest = {s: max(size(r["text"]) for r in rows if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    assert math.isclose(sum(want.values()), sum(sizes.values()))


def test_mix_emits_whole_rows_and_reruns_agree(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    first, again = (Counter(tuple(r) for r in mixing.mixed(d).collect()) for d in (docs, docs.repartition(5, "text")))
    assert first == again and sum(first.values())
    given = Counter(tuple(r) for r in docs.collect())
    assert all(n <= 3 * given[r] for r, n in first.items())
    assert Counter(tuple(r) for r in mixing.mixed(docs, seed=1).collect()) != first
    assert mixing.mixed(docs, weights=[1, 0, 1, 1, 1, 0]).where("source = 'b' OR source IS NULL").count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.report(docs.limit(0)).count() == 0


def test_mix_of_real_documents_comes_near(spark):
    """No source is off by more than one long document, and all together by less than a hundredth."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    joined = mixing.report(docs).join(docs.select("doc_id", "source"), "doc_id")
    sums = joined.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("longest")).collect()
    assert all(abs(r["t"] - r["g"]) <= r["longest"] for r in sums)
    assert abs(sum(r["t"] - r["g"] for r in sums)) <= 0.01 * sum(r["g"] for r in sums)


def test_mix_has_no_python_on_its_path(spark):
    frame = queries.QUERIES["op11_mixing"](spark, SF)
    for df in (frame, mixing.mixed(spark.read.parquet(f"{SF}/documents.parquet"))):
        plan = df._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("ArrowEval", "BatchEvalPython", "MapInArrow", "MapInPandas", "PythonUDF", "ExternalRDD"))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(leaves):
    """(root, path per leaf) of one tree."""
    nodes, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 16 * 16:a // 16 * 16 + 16]
            paths[i].append((run[:a % 16], run[a % 16 + 1:]))
            at[i] = a // 16
        nodes = [h(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def proven(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h(*[part(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], t)])
    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    trees = defaultdict(list)
    for r in rows:
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        trees[r["source"]].append((null_first(r["doc_id"]), leaf(r, r["text"]), leaf(r, low(r["text"]) if bad else r["text"]), r["doc_id"]))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: climb([x[1] for x in trees[s].sort() or trees[s]]) for s in sources}
    root, above = climb([own[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for (_, good, found, doc_id), path in zip(trees[s], own[s][1]):
            fold = found
            for left, right in path + up:
                fold = h(*left, fold, *right)
            out.append((doc_id, good, own[s][0], root, h(*[x for left, right in path + up for x in left + right]), fold, fold == root))
    return sorted(out, key=str)


def test_manifest_equals_plain_python(spark, docs):
    many = docs.unionByName(docs.where("doc_id < 290").withColumn("doc_id", F.col("doc_id") + 1000)
                            .withColumn("source", F.lit("big"))).unionByName(docs.limit(17).withColumn("source", F.lit("z")))
    for table in (many, many.where("source = 'empty'"), many.where("source = 'big'"), docs.where("doc_id = 3")):
        got = sorted([tuple(r) for r in manifest.report(table.repartition(3)).collect()], key=str)
        assert got == proven(table.collect())
    assert manifest.report(docs.limit(0)).count() == 0


def test_manifest_over_several_rollups(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("Text").alias("text"), F.lit("en").alias("lang"),
                                    F.concat(F.lit("s"), F.when(F.col("id") < 4400, 0).otherwise(F.col("id") % 40)).alias("source"), F.lit(4).alias("n_chars"))
    got = sorted([tuple(r) for r in manifest.report(rows).collect()], key=str)
    assert got == proven(rows.collect())
    # 4,415 leaves are four levels, 15 are one; 40 subroots are two more
    assert {len(r["path"]) for r in manifest.manifest(rows).collect()} == {6, 3}


def test_manifest_proofs_use_no_join(spark, docs):
    ranked = docs.where("source = 'a'").select(F.lit(0).alias("tree"), F.col("doc_id").alias("rank"), F.lit(300).alias("n"), F.lit("d").alias("digest"),
                                               F.lit(1).alias("item"))
    proofs = manifest.prove(ranked, 300, lambda t: t.select("tree", manifest._no_path().alias("path"), F.col("digest").alias("top")))
    assert "Join" not in proofs._jdf.queryExecution().optimizedPlan().toString()


def mined(rows, k=5, m=3):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = tuple(math.floor(256 * x) for x in v)
        label = (label + 1) % 10 if i % 7 == 0 else label
        best[i] = min(best.get(i, (label, w)), (label, w))
    dim = Counter(len(w) for _, w in best.values()).most_common(1)[0][0] if best else 0
    best = {i: x for i, x in best.items() if len(x[1]) == dim}
    ids = sorted(best)
    x = np.array([best[i][1] for i in ids], dtype=np.int64).reshape(len(ids), dim)
    out = []
    for a in ids:
        if a % 50:
            continue
        score = dict(zip(ids, (x @ np.array(best[a][1])).tolist()))
        order = sorted((i for i in ids if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == best[a][0]][:k]:
            hard = [i for i in order if best[i][0] != best[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(hard[:m])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies", "short"])
def test_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(negatives, "PART", 16)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "HELD", 50)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 6)) * (0.05 if kind == "clusters" else 2.0)
    if kind == "copies":
        x[:300] = x[0]
    if kind == "short":
        x = x * rng.uniform(0, 1, (700, 1))
    rows = [(i, int(rng.integers(0, 10)), v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None, [1.0] * 6), (950, 1, None), (1000, 2, [float("nan")] * 6), (1050, 3, [None] + [1.0] * 5), (1100, 3, [float("inf")] * 6),
             (1150, 4, [0.0] * 6), (None, 4, [1.0] * 6), (1200, 5, [1.0]), (1250, 5, []), rows[0], (50, 0, [9.0] * 6)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, embedding array<double>, leaf int")
    got = sorted(tuple(r) for r in negatives.report(table).collect())
    assert got == mined(rows) and got


def test_tree_leaves_out_subtrees(spark, monkeypatch):
    """On clustered rows the ranges leave out most leaves of the second round."""
    monkeypatch.setattr(negatives, "LEAF_ROWS", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 1600)] * 4 + rng.normal(size=(1600, 8)) * 0.05
    table = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    visits = []
    run = negatives.Index._visits

    def counted(self, asked, nearest):
        out = run(self, asked, nearest)
        if not nearest:
            visits.append((out.count(), asked.count() * len(self.sizes)))
        return out

    monkeypatch.setattr(negatives.Index, "_visits", counted)
    got = sorted(tuple(r) for r in negatives.report(table).collect())
    assert got == mined([(i, i % 2, v.tolist()) for i, v in enumerate(x)])
    assert visits and visits[0][0] < 0.5 * visits[0][1], visits


def test_negatives_of_empty_tables(spark):
    table = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.report(table).count() == 0
    one = spark.createDataFrame([(50, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.report(one).count() == 0
