"""Near-duplicates, decontamination, lines, tokens and languages against brute force."""

import hashlib
import random
import re

import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from fleetwatch.llm import decontamination, langid, lines, pieces, simhash
from fleetwatch.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score int, node string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def docs(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", 1, "n") for i, t, lang in rows], DOCS)


def prose(n, seed):
    return " ".join(WORDS[(i * i + seed * 7 + i // 3) % len(WORDS)] + str((i * seed) % 5) for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = "\n".join(prose(60, k) for k in range(200))
    rows = [(1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, prose(40, 3), "en"), (5, prose(40, 3), "en"),
            (5, prose(40, 3), "en"), (6, prose(40, 3).upper(), "en"), (7, prose(40, 3) + " more", "en"), (8, "one two", "en"),
            (9, long, "de"), (10, long + "\nlast line of the long text", "de"), (None, "no id here at all", "en"),
            (None, None, None), (11, "12 34 !!", "en"), (12, "漢字 naïve É\u0085x y", "fr")]
    return docs(spark, rows)


def shingle_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, near):
    """Smallest id reachable over ``near`` for every row index."""
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near(rows[a], rows[b]):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    best = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            best[r] = min(best.get(r, rows[k][0]), rows[k][0])
    return [best.get(r) for r in root]


def expected_classes(rows):
    prints = [(r[0], shingle_print(r[1])) for r in rows]
    found = groups(prints, lambda a, b: bin(a[1] ^ b[1]).count("1") <= 3)
    return sorted([(i, format(p, "016x"), c) for (i, p), c in zip(prints, found)], key=str)


@pytest.mark.parametrize("bucket", [4096, 4])
def test_simhash_against_brute_force(spark, odd, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    given = odd.select("doc_id", "text").collect() + spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = simhash.report(spark.createDataFrame(given, "doc_id long, text string"))
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected_classes(given)


def test_simhash_links_within_bound_only(spark):
    base = 0x0123456789ABCDEF
    values = [base ^ m for m in (0, 1, 7, 0xF, 0xFF, 1 << 63, (1 << 63) | 3, 0xF0F0F0F0)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(prints)).collect()}
    want = groups(list(enumerate(values)), lambda a, b: bin(a[1] ^ b[1]).count("1") <= 3)
    same = [[got.get(a, a) == got.get(b, b) for a in signed] for b in signed]
    assert same == [[x == y for x in want] for y in want]


def test_simhash_stage(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    want = {c for i, _, c in expected_classes([(r["doc_id"], r["text"]) for r in odd.collect()]) if c is not None}
    assert ids == sorted(want)
    assert simhash.keep_one(odd.limit(0)).count() == 0
    assert simhash.report(odd.limit(0)).count() == 0


def test_simhash_stage_keeps_one_row_of_every_group(spark):
    long = prose(400, 3)
    texts = {"a": prose(40, 5), "b": long, "near b": long + " more", "c": prose(300, 4), "near c": prose(300, 4) + " more"}
    prints = {k: shingle_print(t) for k, t in texts.items()}
    apart = lambda x, y: bin(prints[x] ^ prints[y]).count("1")
    assert 0 < apart("b", "near b") <= 3 and 0 < apart("c", "near c") <= 3
    assert min(apart(x, y) for x, y in ("ab", "ac", "bc")) > 3
    rows = [(5, "a"), (5, "b"), (9, "near b"), (None, "c"), (None, "near c"), (5, "b"), (None, "near b"), (None, "c")]
    kept = simhash.keep_one(docs(spark, [(i, texts[t], "en") for i, t in rows])).select("doc_id", "text").collect()
    names = {t: k for k, t in texts.items()}
    kept = [(r["doc_id"], names[r["text"]]) for r in kept]
    assert sorted(k for k in kept if k[0] is not None) == [(5, "a"), (5, "b")]
    alone = [k for k in kept if k[0] is None]
    assert len(alone) == 1 and alone[0][1] in ("c", "near c")


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def contaminated(text, items, n=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, ids = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        for a in range(max(1, len(w) - n + 1)) if w else ():
            win = w[a:a + n]
            for i in range(len(words) - len(win) + 1):
                if words[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    ids.add(item)
    return len(words), len(hit), len(ids), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [20_000, 3])
def test_decontamination_against_brute_force(spark, odd, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    monkeypatch.setattr(decontamination, "SEGMENT", 300)
    items = [(1, prose(40, 3)), (1, prose(40, 3)), (2, "one two"), (3, None), (4, ""), (5, prose(16, 3).title()), (6, "É\u0085x")]
    got = decontamination.report(odd, spark.createDataFrame(items, "item_id long, text string"))
    names = ["n_words", "n_hit", "n_items", "contaminated"]
    want = [(r["doc_id"], *contaminated(r["text"], items)) for r in odd.collect()]
    assert sorted([(r["doc_id"], *[r[n] for n in names]) for r in got.collect()], key=str) == sorted(want, key=str)


def test_decontamination_empty_tables_and_stage(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(odd, none).where("n_hit > 0 OR contaminated").count() == 0
    assert decontamination.report(odd.limit(0), none).count() == 0
    items = spark.createDataFrame([(1, prose(40, 3))], "item_id long, text string")
    kept = decontamination.keep_clean(odd, items)
    assert kept.columns == odd.columns
    want = sorted([r["doc_id"] for r in odd.collect() if not contaminated(r["text"], [(1, prose(40, 3))])[3]], key=str)
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == want


@pytest.mark.parametrize("block", [20_000, 3])
def test_decontamination_items_without_id(spark, odd, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    monkeypatch.setattr(decontamination, "SEGMENT", 300)
    items = [(None, prose(40, 3)), (None, "one two"), (1, prose(40, 3)), (None, prose(60, 7)), (2, prose(13, 9)), (None, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    names = ["n_words", "n_hit", "n_items", "contaminated"]
    want = [(r["doc_id"], *contaminated(r["text"], items)) for r in odd.collect()]
    got = decontamination.report(odd, table).collect()
    assert sorted([(r["doc_id"], *[r[n] for n in names]) for r in got], key=str) == sorted(want, key=str)
    assert {r["items_sha256"] for r in got if r["doc_id"] == 8} == {hashlib.sha256(b"").hexdigest()}  # as string_agg, which skips null
    kept = [r["doc_id"] for r in decontamination.keep_clean(odd, table).collect()]
    assert 8 not in kept and sorted(kept, key=str) == sorted([w[0] for w in want if not w[4]], key=str)


def test_proximity(spark):
    table = docs(spark, [(1, "a x b y y c", None), (2, "a b", None), (3, "c b a", None), (4, "a q q q q b q c", None)])
    index = decontamination.build_index(table)
    found = decontamination.proximity_matches(index, {7: ["A", "b", "c"]}, 6)
    got = {r["doc_id"]: [(m["start"], m["stop"]) for m in r["matches"]]
           for r in decontamination.documents_of(index).join(found, ["segment", "ord"]).collect()}
    assert got == {1: [(0, 6)], 3: [(0, 3)]}


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def deduplicated(rows):
    """Text left of each distinct (id, text), by comparing every pair of lines."""
    def key(i, h, k):
        return (i is not None, i or 0, h, k)
    distinct = {}
    for i, t in rows:
        if t is not None:
            h = xxhash.xxh64_intdigest(t.encode(), 42)
            distinct[i, t] = h - (1 << 64) if h >> 63 else h
    places = [(key(i, h, k), line) for (i, t), h in distinct.items() for k, line in enumerate(t.split("\n")) if line.strip(" ")]
    out = {}
    for (i, t), h in distinct.items():
        kept = []
        for k, line in enumerate(t.split("\n")):
            here = key(i, h, k)
            earlier = [x for p, x in places if p < here]
            gone = bool(line.strip(" ")) and any(x == line or min(len(x), len(line)) >= 16 and within_one(x, line) for x in earlier)
            if not gone:
                kept.append(line)
        out[i, t] = "\n".join(kept)
    return out


def test_lines_against_brute_force(spark):
    base = prose(9, 2)
    long = prose(60, 5)
    edits = [base, base[:10] + "#" + base[11:], base[:30] + base[31:], base + "!", "!" + base, base[:-1], base[1:],
             base[:10] + "##" + base[11:], long, long[:64] + long[65:], long[:200] + "é" + long[200:], long[:-1] + "é", "short line", "short lime",
             "", "  ", "sixteen letters.", "sixteen letterz.", "fifteen letters", "fifteen letterz"]
    rows = [(i, "\n".join(edits[i % 7:i % 7 + 9])) for i in range(8)] + [(20, None), (21, ""), (22, "\n\n"), (3, "\n".join(edits[3:12])),
            (None, base), (23, base), (24, long * 40 + "a"), (25, long * 40 + "b"), (26, "short lime\nfifteen letterz")]
    table = docs(spark, [(i, t, "en") for i, t in rows])
    got = {(r["doc_id"], r["text"]): r["__text"] for r in lines.rewrite(table).collect() if r["text"] is not None}
    assert got == deduplicated(rows)
    kept = lines.keep_first_lines(table)
    assert kept.columns == table.columns
    want = sorted([i for i, t in rows if t is None or deduplicated(rows)[i, t].strip(" \n") or deduplicated(rows)[i, t] == t], key=str)
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == want
    assert lines.keep_first_lines(table.limit(0)).count() == 0


def test_lines_plan_has_no_python(spark, odd):
    plan = lines.report(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_tokens_equal_the_public_library(spark, odd):
    public = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    given = odd.union(docs(spark, [(50, "a" * 700 + " 12.5%\t\t  ▁x▁ \n end  ", None), (51, "🙂漢\u0000é", None)]))
    got = {(r["doc_id"], r["t"]): r for r in pieces.tokenize(given).join(
        given.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").collect()}
    for (_, text), r in got.items():
        assert r["token_ids"] == ([] if text is None else public.encode(text))
        if text is not None and pieces.MARK not in text and r["doc_id"] != 5:
            assert r["decoded"] == text
    empty = pieces.tokenize(given.where("text IS NULL")).first()
    assert (empty["n_tokens"], empty["decoded"]) == (0, None)
    assert pieces.report(given.limit(0)).count() == 0


def test_unigram_path_is_the_best_of_all_segmentations():
    pieces_ = [("<unk>", 0.0, 2), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("ba", -1.0, 1), ("aba", -6.0, 1), ("▁", -1.0, 1)]
    t = pieces.Transducer(pieces.Model(pieces_, dummy_prefix=False, squeeze=False))
    cost = {p: -s for p, s, k in pieces_ if k == 1}

    def best(s):
        return min(((cost[s[:n]] + best(s[n:])[0], [s[:n]] + best(s[n:])[1]) for n in (1, 2, 3) if s[:n] in cost and len(s) >= n),
                   default=(0.0 if not s else 1e9, []))
    for text in ("abab", "bab", "aabba", "ababab"):
        assert [pieces_[i][0] for i in t.encode(text)] == best(text)[1]
    assert t.encode("axxb").tolist() == [1, 0, 2]


class Counted(dict):
    """Counts what is looked up."""
    n = 0

    def get(self, key, default=None):
        self.n += 1
        return super().get(key, default)


class Sliced(str):
    """Counts the characters of its slices."""
    n = 0

    def __getitem__(self, at):
        out = super().__getitem__(at)
        self.n += len(out)
        return out


def test_path_search_weighs_few_arcs():
    """The search goes on from the longest arc of weight 0: it weighs about as many arcs as there are
    tokens, not those of all positions, and reads a long chunk once per arc."""
    t = pieces.load()
    words = sorted({w for k in range(40) for w in prose(60, k).split()} | {"internationalisation", "counterrevolutionary", "Verantwortlichkeit"})
    t.pairs = Counted()
    n = sum(len(t.shortest_path("▁" + w * 3)) for w in words)
    assert t.pairs.n <= 2 * n
    long = Sliced("▁" + "internationalisation" * 200)
    t.shortest_path(long)
    assert long.n <= 2 * max(map(len, t.arcs)) * len(long)


def test_chunks_end_where_no_piece_crosses():
    t = pieces.load()
    assert t.chunks.findall("  so, (they) said: 12...") == ["  so", ",", " (", "they", ")", " said", ":", " 1", "2", "..."]
    groups = pieces._neighbours(["ab", "bc", "▁x", "de", "..", "▁.,", "f", "yz", "zb"])
    assert groups == [{"a", "b", "c", "y", "z"}, {",", "."}, {"d", "e"}]
    crossing = pieces.Transducer(pieces.Model([("<unk>", 0.0, 2), ("a.", -1.0, 1), ("b", -1.0, 1), ("▁", -1.0, 1), ("a", -3.0, 1), ("--", -1.0, 1), ("]^", -1.0, 1)]))
    assert crossing.chunks.findall("ba. a.--b]^") == ["b", "a.", " a.", "--", "b", "]^"]
    public = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    signs = [p.replace("▁", " ") for p, i in t.arcs.items() if i >= 0 and not p.isalpha()]
    for _ in range(300):
        text = "".join(rng.choice((rng.choice(signs), rng.choice(("word", "Été", "день", "一个", "ال", "x", "\n", "🙂", "  ")))) for _ in range(40))
        assert t.encode(text).tolist() == public.encode(text), repr(text)


def test_language_id(spark, odd):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 300 and right / n >= 0.98
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (1, 2, 3, 11))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["held_out"]} == {i for i in range(1, 13) if __import__("zlib").crc32(str(i).encode()) % 3 == 1}
    unlearned = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns
    assert not {1, 2, 3, 11} & {r["doc_id"] for r in kept.collect()}


def test_language_pieces_do_not_change_scores(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(langid.learning_rows(table))
    whole = {r["doc_id"]: r["score"] for r in langid.predict(table.select("doc_id", "text"), model).collect()}
    monkeypatch.setattr(langid, "PIECE", 50)
    cut = {r["doc_id"]: r["score"] for r in langid.predict(table.select("doc_id", "text"), model).collect()}
    assert all(abs(whole[k] - cut[k]) < 1e-6 for k in whole)
