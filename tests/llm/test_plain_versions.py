"""Operators and pipeline stages against plain Python, and cases that used to slip through."""

import math
import re
from collections import Counter, defaultdict
from operator import eq
from zlib import crc32

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from fleetwatch.llm import decontamination, langid, lines, neighbours, pieces, quality, simhash, toxicity, warc
from tests.llm.test_other_operators import pages  # noqa: F401
from tests.llm.test_text_operators import contaminated, deduplicated, docs, expected_classes, prose, within_one

SF = "/root/testdata/sf0.001"


def broken(spark):
    """Rows whose text is not UTF-8."""
    return spark.sql("""SELECT id AS doc_id, cast(concat(unhex('ff'), cast('some words of ' AS binary), unhex('c328')) AS string) AS text,
                        'en' AS lang, 's' AS source, id AS n_chars FROM range(900, 906)""")


def plain_language(rows, least=langid.MAX_LANGUAGES):
    """{(doc_id, text): (language, posterior)} from single counts."""
    def grams(text):
        text = text.lower()
        for n in langid.ORDERS:
            for i in range(len(text) - n + 1):
                h = n
                for j, c in enumerate(text[i:i + n]):
                    h = ((h ^ ord(c)) * int(langid.MIX[j % 3])) & 0xFFFFFFFF
                    h ^= h >> 15
                yield h % langid.BUCKETS

    counts, seen = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(grams(text))
            seen[lang] += 1
    sums = {x: sum(counts[x].values()) + langid.BUCKETS for x in seen}
    out = {}
    for i, text, _ in rows:
        if text is None or not re.search(r"[^\W\d_]", text) or not seen:
            out[i, text] = ("und", 0.0)
            continue
        own = Counter(grams(text))
        log = {x: math.log(seen[x] / sum(seen.values())) + sum(n * math.log((counts[x][b] + 1) / sums[x]) for b, n in own.items()) for x in seen}
        best = min(log, key=lambda x: (-log[x], x))
        out[i, text] = (best, 1 / sum(math.exp(log[x] - log[best]) for x in log))
    return out


def mixed_rows(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(80).collect()]
    rows = [(i, t and t[:400], lang) for i, t, lang in given]
    return rows + [(3001, None, "en"), (3002, "", "de"), (3003, "12 !", "en"), (None, "no id", "en"), (3004, "short", None), (3004, "short", None)]


def test_language_equals_plain_counts(spark):
    rows = mixed_rows(spark)
    got = langid.identify(docs(spark, rows)).collect()
    want = plain_language(rows)
    by_id = {i: v for (i, _), v in want.items()}
    assert len(got) == len(rows)
    for r in got:
        lang, score = by_id[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3, r


def test_broken_text_passes_language_and_pipeline(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").unionByName(broken(spark))
    rows = langid.identify(table).where("doc_id >= 900 AND doc_id < 906").collect()
    assert len(rows) == 6 and all(r["lang_pred"] != "und" and 0 <= r["score"] <= 1 for r in rows)
    kept = langid.keep_identified(table)
    same = kept.where("doc_id BETWEEN 900 AND 905").select(F.hex("text")).distinct().collect()
    assert {r[0] for r in same} <= {r[0] for r in broken(spark).select(F.hex("text")).collect()}
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF)
    assert table.count() > 0


def words_of(text):
    return (text or b"").split()


def plain_passage(words):
    raw, size = Counter(b"".join(words)), sum(map(len, words))
    n = len(words)
    out = [0.0] * (quality.WIDTH + quality.BUCKETS)
    if not n:
        return out
    share = lambda a, b: sum(raw[x] for x in range(a, b)) / size
    out[:8] = [1.0, share(65, 91), share(48, 58), share(128, 256), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, size / n / 10,
               max(map(len, words)) / 50]
    for k, b in enumerate(quality.PUNCTUATION):
        out[8 + k] = raw[b] / size
    for b, c in Counter(crc32(w.lower()) % quality.BUCKETS for w in words).items():
        out[quality.WIDTH + b] = math.sqrt(c / n)
    return out


def test_quality_equals_plain_attention(spark):
    rnd = np.random.default_rng(3)
    width = quality.WIDTH + quality.BUCKETS
    shapes = {"mean": (width,), "W": (width, 16), "b": (16,), "V": (16, 8), "U": (16, 8), "w": (8,), "c": (16,), "c0": (1,)}
    model = {k: rnd.normal(size=s) for k, s in shapes.items()} | {"std": rnd.uniform(0.5, 2, width)}
    texts = [None, "", "One two, three!", prose(500, 3), prose(95, 2), prose(97, 2) + " ÄÖ 12", "same " * 300]
    table = docs(spark, [(i, t, "en") for i, t in enumerate(texts)])
    sig = lambda z: 1 / (1 + math.exp(-max(-40, min(40, z))))
    for r in quality.score(table, model).collect():
        words = words_of(texts[r["doc_id"]] and texts[r["doc_id"]].encode())
        cut = [words[i:i + 96] for i in range(0, len(words), 96)] or [[]]
        if len(cut) > 1 and len(cut[-1]) < 32:
            cut[-2:] = [cut[-2] + cut[-1]]
        hidden, energy = [], []
        for p in cut:
            x = [(v - m) / s for v, m, s in zip(plain_passage(p), model["mean"], model["std"])]
            h = [math.tanh(sum(a * b for a, b in zip(x, model["W"][:, j])) + model["b"][j]) for j in range(16)]
            hidden.append(h)
            dot = lambda m, j: sum(a * b for a, b in zip(h, m[:, j]))
            energy.append(sum(math.tanh(dot(model["V"], j)) * sig(dot(model["U"], j)) * model["w"][j] for j in range(8)))
        weight = [math.exp(e - max(energy)) for e in energy]
        z = [sum(w * h[j] for w, h in zip(weight, hidden)) / sum(weight) for j in range(16)]
        assert abs(r["score"] - sig(sum(a * b for a, b in zip(z, model["c"])) + model["c0"][0])) < 1e-9


def test_quality_learns_from_every_passage(spark):
    """The one passage that tells is not among any 64 evenly spaced ones."""
    filler, mark = prose(96 * 100, 4).split(), "!!! ### !!! ### " * 24
    rows = []
    for i in range(60):
        words = list(filler)
        if i % 2:
            words[96 * 37:96 * 38] = mark.split()[:96]
        rows.append((i, " ".join(words), "en"))
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.report(table, labels).collect()}
    assert min(got[i] for i in range(0, 60, 2)) > max(got[i] for i in range(1, 60, 2))


def test_toxicity_equals_plain_chain(spark):
    rnd = np.random.default_rng(5)
    scale = rnd.normal(size=quality.WIDTH), rnd.uniform(0.5, 2, quality.WIDTH)
    models = [(rnd.normal(size=toxicity.BUCKETS), rnd.normal(size=quality.WIDTH + k + 1)) for k in range(3)]
    texts = [None, "", "One TWO, three-three!", prose(300, 3), "a b c " * 40]
    names = ["x", "y", "z"]
    for r in toxicity.score(docs(spark, [(i, t, "en") for i, t in enumerate(texts)]), (scale, models), names).collect():
        text = texts[r["doc_id"]]
        own = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode() if text else b"")
        marks = Counter(crc32(m) % toxicity.BUCKETS for m in own + [b"^" + w[:4] for w in own if len(w) > 4])
        style = plain_passage(words_of(text and text.encode()))[:quality.WIDTH]
        dense = [(v - m) / s / math.sqrt(quality.WIDTH) for v, m, s in zip(style, *scale)]
        for name, (w, v) in zip(names, models):
            odds = sum(w[b] * math.sqrt(n / len(own)) for b, n in marks.items()) + sum(a * b for a, b in zip(dense, v)) + v[-1]
            odds = max(-30.0, min(30.0, odds))
            assert abs(r[f"{name}_score"] - 1 / (1 + math.exp(-odds))) < 1e-5
            dense.append(odds)


def test_copies_are_unseen_together(spark, monkeypatch):
    seen = {}
    keep = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, style, y, importance, fold: seen.update(rows=rows, fold=fold) or keep(rows, style, y, importance, fold))
    rows = [(i, prose(30, i % 5), "en") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    toxicity.report(docs(spark, rows), labels)
    folds = defaultdict(set)
    for (columns, values), fold in zip(seen["rows"], seen["fold"]):
        folds[columns.tobytes() + values.tobytes()].add(int(fold))
    assert len(seen["rows"]) == 60 and all(len(f) == 1 for f in folds.values())


def records(data):
    """(headers, block) of concatenated WARC records, by Content-Length alone."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end].split(b"\r\n")
        assert head[0] == b"WARC/1.1"
        fields = {k.decode(): v.decode() for k, v in (h.split(b": ", 1) for h in head[1:] if h)}
        n = int(fields["Content-Length"])
        yield fields, data[end:end + n]
        assert data[end + n:end + n + 4] == b"\r\n\r\n"
        at = end + n + 4


def test_records_are_walked_by_content_length(spark, pages):  # noqa: F811
    archive = warc.write_archive(pages)
    data = b"".join(bytes(r["record"]) for r in warc.record_bytes(warc.read_archive(spark, archive)).collect())
    found = list(records(data))
    assert Counter(f["WARC-Type"] for f, _ in found) == {"response": 5, "revisit": 4}
    payloads = set()
    for fields, block in found:
        http, payload = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200")
        if fields["WARC-Type"] == "revisit":
            assert payload == b"" and fields["WARC-Refers-To"] in {f["WARC-Record-ID"] for f, _ in found}
        else:
            payloads.add(payload)
    assert payloads == {b"<p>a</p>", b"", "é".encode() * 5000, b"WARC/1.1\r\n\r\n", b"neg"}


def test_all_lists_give_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 16)
    x = np.random.default_rng(1).normal(size=(900, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(dict)
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, 20, prune=None, share=None).collect():
        found[r["query_id"]][r["rank"]] = r["vec_id"]
    for q in range(0, 900, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert [found[q][k] for k in range(1, 21)] == np.lexsort((np.arange(900), -s))[:20].tolist()
    few = neighbours.search(table, F.col("vec_id") == 0, 20, share=None).count()
    assert few == neighbours.search(table, F.col("vec_id") == 0, 20, prune=None).count() == 20


def test_lines_of_any_length(spark, monkeypatch):
    """With ``shortest=1`` every line within one edit of an earlier one goes."""
    short = ["a", "b", "ab", "abc", "abd", "12", "13", "1", "x y", "x z", "fifteen letters", "fifteen letterz", "", " ", "longer line of words", "longer line of wards"]
    rows = [(i, "\n".join(short[i % 5:i % 5 + 12])) for i in range(6)] + [(20, None), (21, "}\n}\n{")]
    table = docs(spark, [(i, t, "en") for i, t in rows])
    got = {r["doc_id"]: r["__text"] for r in lines.rewrite(table, shortest=1).collect()}
    places = sorted((i, k, line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")) if line.strip(" "))
    for i, t in rows:
        if t is not None:
            left = [line for k, line in enumerate(t.split("\n"))
                    if not line.strip(" ") or not any(within_one(line, x) for a, b, x in places if (a, b) < (i, k))]
            assert got[i] == "\n".join(left), i


def test_items_of_any_id_and_number(spark, monkeypatch):
    table = docs(spark, [(1, prose(60, 3), "en"), (2, prose(20, 5), "en"), (3, None, "en"), (4, "x " * 3000 + prose(30, 3), "en")])
    items = spark.createDataFrame([("a-10", prose(40, 3)), ("a-9", prose(14, 5)), ("a-9", prose(40, 3)), ("é", prose(40, 3))], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontamination.report(table, items).collect()}
    assert got[1]["item_ids"] == ["a-10", "a-9", "é"] and got[2]["item_ids"] == ["a-9"] and got[3]["item_ids"] == []
    assert [got[i]["contaminated"] for i in (1, 2, 3, 4)] == [True, True, False, False]


def test_any_number_of_windows_is_one_pass(spark):
    """60,000 windows, one of which stands in every item: the index is scanned once."""
    table = spark.range(200).select("id", F.concat_ws(" ", F.lit(prose(40, 3)), *[F.concat(F.lit(f"w{k}v"), F.col("id")) for k in range(40)]).alias("text"))
    items = spark.range(5000).select(F.col("id").alias("item_id"), F.concat_ws(
        " ", F.lit(prose(13, 3)), *[F.concat(F.lit(f"w{k}v"), F.col("id")) for k in range(24)]).alias("text"))
    index = decontamination.build_index(table.withColumnRenamed("id", "doc_id"))
    windows, holders = decontamination.item_windows(items)
    assert windows.count() > 60_000 and holders.count() > 120_000
    found = decontamination.phrase_matches(index, windows)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    rows = decontamination.report(table.withColumnRenamed("id", "doc_id"), items).select("n_items", "n_hit").distinct().collect()
    assert [(r["n_items"], r["n_hit"]) for r in rows] == [(5000, 13 + 24)]


def test_repeated_rows_keep_the_least(spark):
    """Rows that share id and text but not the other columns: the least one stays, however they are dealt."""
    rows = [(5, "alpha beta gamma delta", lang, src, 3, "x", 1, "n") for lang in ("fr", "de", None) for src in ("t", "s")] + [
        (6, "other words in here", "en", "s", 3, "x", 1, "n")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score int, node string")
    for given in (table, table.repartition(5), table.orderBy(F.desc("lang"))):
        kept = sorted(tuple(r)[:4] for r in simhash.keep_one(given).collect())
        assert kept == [(5, "alpha beta gamma delta", "de", "s"), (6, "other words in here", "en", "s")]
        assert simhash.keep_one(given).columns == table.columns


@pytest.mark.parametrize("dummy, squeeze, escape", [(d, q, e) for d in (0, 1) for q in (0, 1) for e in (0, 1)])
def test_normaliser_states_equal_a_string_step(dummy, squeeze, escape):
    model = pieces.Model([("<unk>", 0.0, 2)], dummy_prefix=bool(dummy), squeeze=bool(squeeze), escape=bool(escape))
    states = pieces.Normaliser(model)
    for text in ("", " ", "   ", "a", " a", "a ", "  a  b c   ", "▁a ▁ b", " ▁", "▁  ▁x", "a\n b\t c", "a▁b", "  12 3 "):
        want = re.sub(" +", " ", text).strip(" ") if squeeze else text
        want = (" " if dummy and want else "") + want
        assert states.compose(text, pieces.START) == (want.replace(" ", "▁") if escape else want), repr(text)


def test_chunks_give_the_path_of_the_whole_text(spark):
    """Composing chunk by chunk is composing the whole text, for both kinds of model."""
    t = pieces.load()
    toy = [("<unk>", 0.0, 2)] + [(p, -1.0 - k / 7, 1) for k, p in enumerate(["a", "b", "▁", "ab", "▁a", "▁ab", "ba", "▁▁", "5"])]
    unigram = pieces.Transducer(pieces.Model(toy))
    texts = [r["text"][:300] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    texts += ["  ab  5 ▁ab a5b ", "5", " ", "▁", "5 5", "ab  ", "\n\n 5 x", "aab▁ ▁5 bab"]
    for text in texts:
        for machine in (t, unigram):
            whole = machine.shortest_path(machine.normaliser.compose(text, pieces.START))
            ids = machine.encode(text).tolist()
            if not machine.model.byte_fallback:
                whole = [x for k, x in enumerate(whole) if x != machine.unknown or k == 0 or whole[k - 1] != x]
            assert ids == whole, text


def test_pipeline_equals_plain_stages(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(i, t, lang) for i, t, lang in mixed_rows(spark) if i is not None][:-2]
    near = rows[0][1] + " end"
    rows += [(4000, near, "en"), (4001, rows[1][1], "en"), (4002, items[0][1], "en"), (4003, "unique words here " + items[1][1], "de"),
             (4004, rows[2][1] + "\n" + rows[3][1], "fr"), (4005, prose(80, 11), "en"), (4006, prose(80, 11).replace(" ", "\n", 30).replace("\n", " ", 29), "en")]
    known = plain_language(rows)
    want = {(i, t) for i, t, _ in rows if known[i, t][0] != "und" and known[i, t][1] >= 0.5}
    stages = [set(want)]
    cut = deduplicated(sorted(want))
    want = {(i, cut[i, t]) for i, t in want if cut[i, t].strip(" \n") or cut[i, t] == t}
    stages.append(set(want))
    firsts = {c for _, _, c in expected_classes(sorted(want))}
    want = {(i, t) for i, t in want if i in firsts}
    stages.append(set(want))
    want = {(i, t) for i, t in want if not contaminated(t, items)[3]}
    stages.append(set(want))
    table = docs(spark, rows)
    for (name, stage), expected in zip(corpus_pipeline.STAGES, stages):
        table = stage(spark, table, SF)
        assert {(r["doc_id"], r["text"]) for r in table.collect()} == expected, name
    assert all(len(a) > len(b) for a, b in zip(stages[1:], stages[2:]))
    public = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    tokens = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()}
    assert tokens == {i: public.encode(t) for i, t in want}
