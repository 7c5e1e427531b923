"""Operator 6: line deduplication by a deletion-neighbourhood join (DataFrame functions only).

A line is dropped if an equal line, or a line within one edit (insert, delete or replace one
character), stands earlier in (doc_id, text hash, line number) order. What is earlier counts
whether or not it is itself dropped, so the result does not depend on any processing order.

1. Every line gives a digest and the hashes of its first and last half (two lengths, so that
   lines of neighbouring length share one). Two lines within one edit agree on a half.
2. Only distinct lines that share a half with another one go on. They emit the hash of every
   variant with one character deleted, in the half where the edit can be, and of themselves.
   A variant is hashed as (text before its block, block without the character, text after it),
   with blocks of ``BLOCK`` characters, so a line of n characters costs n short hashes.
3. Equal variants are joined: of lines that lack the same position one (the earliest) is linked
   to the others, and a line is linked to those that are it plus one character. Since lines are
   distinct, a group is no larger than the alphabet (times the length). All links are verified
   by edit distance.
4. Decisions go back by digest to the places of each line, per document.

Text moves once for the rewritten documents; before that only digests and hashes do.

Lines under ``shortest`` characters are compared for equality only, by default ``SHORT``: within
one edit of each other stand all numbers of a list and all short labels, which are not copies.
``shortest=1`` compares every line.

Defined cases: blank lines stay; a null text stays null; repeated rows (equal id and text) share their places and are
rewritten alike; null ids sort first; a document whose every non-blank line is dropped becomes
blank (the pipeline stage removes it); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sha256_hex, stored

BLOCK = 64
SHORT = 16
# ids of documents with candidate lines (16 bytes each) go to the tasks up to this checked number;
# beyond it a shuffle join fetches their text, with the same result
BROADCAST_ROWS = 500_000

HALVES = ("first_low", "last_low", "first_high", "last_high")


def _half_keys(line: Column, n: Column, shortest: int) -> list[Column]:
    """Hashes of the first and last half; lines of even length have two half lengths."""
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    keys = [F.xxhash64(F.lit(side), p, F.substring(line, at, p))
            for p in (low, high) for side, at in (("first", F.lit(1)), ("last", n - p + 1))]
    return [F.when((n >= shortest) & ((low != high) | F.lit(i < 2)), k).alias(name)
            for i, (k, name) in enumerate(zip(keys, HALVES))]


def places(docs: DataFrame, shortest: int = SHORT) -> DataFrame:
    """(doc_id, th, at, digest, lid, n, half hashes) of every line that is not blank."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.where(F.trim("line") != "").withColumn("n", F.char_length("line"))
    return lines.select("doc_id", "th", "at", F.unhex(F.md5("line")).alias("digest"), F.xxhash64("line").alias("lid"),
                        "n", *_half_keys(F.col("line"), F.col("n"), shortest))


def _shared(rows: DataFrame) -> DataFrame:
    """The variants whose key more than one line has. Distinct lines that become equal by one
    deletion are few: no more than places times characters."""
    w = Window.partitionBy("key")
    return (rows.withColumns({"low": F.min("lid").over(w), "high": F.max("lid").over(w)})
            .where(F.col("low") != F.col("high")).drop("low", "high"))


def _candidates(distinct: DataFrame) -> DataFrame:
    """(lid, edit_late, edit_early): lines that share their first half (so the edit is late) or
    their last half with another line."""
    keys = [F.struct(F.col(h).alias("key"), F.lit(h.startswith("first")).alias("late")) for h in HALVES]
    keys = distinct.select("lid", F.explode(F.array(*keys)).alias("k")).select("lid", "k.key", "k.late").where("key IS NOT NULL")
    # any number of lines may begin alike: sums per key and a join that can be split, no window
    common = (keys.groupBy("key").agg(F.min("lid").alias("low"), F.max("lid").alias("high"))
              .where(F.col("low") != F.col("high")).select("key"))
    return (keys.join(common, "key", "left_semi").groupBy("lid")
            .agg(F.max("late").alias("edit_late"), F.max(~F.col("late")).alias("edit_early")))


def _with_text(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds the text of lines known by their place."""
    wanted = stored(lines, "line-candidates")
    sources = wanted.select(F.col("place.doc_id").alias("d"), F.col("place.th").alias("h")).distinct()
    if sources.count() <= BROADCAST_ROWS:
        sources = F.broadcast(sources)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = rows.join(sources, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left_semi")
    rows = rows.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    rows = rows.select(F.struct("doc_id", "th", "at").alias("here"), "line")
    return (wanted.join(rows, F.col("place") == F.col("here")).drop("here")
            .groupBy("lid", "edit_late", "edit_early", "place").agg(F.first("line").alias("line")))


def variants(lines: DataFrame) -> DataFrame:
    """(key, gone, lid): the hashed deletion neighbourhood; ``gone`` is the deleted position, 0
    for the line itself."""
    n = F.char_length("line")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda i: F.struct(
        i.alias("i"), F.xxhash64(F.substring(F.col("line"), F.lit(1), i * BLOCK)).alias("before"),
        F.substring(F.col("line"), i * BLOCK + 1, F.lit(BLOCK)).alias("here"),
        F.xxhash64(F.substring(F.col("line"), (i + 1) * BLOCK + 1, n)).alias("after"),
        F.substring(F.col("line"), i * BLOCK + 1, F.lit(BLOCK - 1)).alias("own"),
        F.xxhash64(F.substring(F.col("line"), (i + 1) * BLOCK, n)).alias("own_after")))
    cut = lines.select("lid", "edit_late", "edit_early", n.alias("n"), F.explode(blocks).alias("b"))
    itself = cut.select(F.xxhash64("b.i", "b.before", "b.own", "b.own_after").alias("key"), F.lit(0).alias("gone"), "lid")
    size = F.char_length("b.here")
    without = (cut.where(size > 0)
               .select("lid", "edit_late", "edit_early", "n", "b", F.explode(F.sequence(F.lit(1), size)).alias("j"))
               .withColumn("gone", F.col("b.i") * BLOCK + F.col("j"))
               .where((F.col("edit_late") & (F.col("gone") > F.floor((F.col("n") - 1) / 2)))
                      | (F.col("edit_early") & (F.col("gone") <= F.floor(F.col("n") / 2) + 1))))
    rest = F.concat(F.substring(F.col("b.here"), F.lit(1), F.col("j") - 1), F.substring(F.col("b.here"), F.col("j") + 1, F.lit(BLOCK)))
    return itself.unionByName(without.select(F.xxhash64("b.i", "b.before", rest, "b.after").alias("key"), "gone", "lid"))


def near_links(lines: DataFrame) -> DataFrame:
    """(lid, place, lead_lid, lead_place), unverified: a line and an earlier one."""
    v = stored(_shared(variants(lines)).join(lines.select("lid", "place"), "lid"), "variants")
    less, whole = v.where("gone > 0"), v.where("gone = 0")
    leads = (less.groupBy("key", "gone").agg(F.min(F.struct("place", "lid")).alias("lead"), F.count("*").alias("n"))
             .where("n > 1").select("key", "gone", "lead"))
    replaced = less.join(leads, ["key", "gone"]).select(
        "lid", "place", F.col("lead.lid").alias("lead_lid"), F.col("lead.place").alias("lead_place"))
    pair = less.alias("a").join(whole.alias("b"), "key")
    first = F.col("a.place") < F.col("b.place")
    pick = lambda c, early: F.when(first == F.lit(early), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    inserted = pair.select(pick("lid", False).alias("lid"), pick("place", False).alias("place"),
                           pick("lid", True).alias("lead_lid"), pick("place", True).alias("lead_place"))
    return replaced.unionByName(inserted).where(F.col("place") > F.col("lead_place")).distinct()


def dropped_lines(docs: DataFrame, shortest: int = SHORT) -> DataFrame:
    """(doc_id, th, gone, n_near): the line numbers each document loses, and how many of them
    for a near copy."""
    lines = stored(places(docs, shortest), "lines")
    place = F.struct("doc_id", "th", "at")
    distinct = stored(lines.groupBy("digest", "lid", "n", *HALVES).agg(
        F.min(place).alias("place"), F.max(place).alias("last_place")), "distinct-lines")
    cands = _candidates(distinct)
    texts = stored(_with_text(docs, distinct.where(F.col("n") >= shortest).join(cands, "lid")
                              .select("lid", "edit_late", "edit_early", "place")), "line-texts")
    short = texts.select("lid", "place", "line")
    links = (near_links(texts).join(short, ["lid", "place"])
             .join(short.select(F.col("lid").alias("lead_lid"), F.col("place").alias("lead_place"),
                                F.col("line").alias("lead")), ["lead_lid", "lead_place"])
             .where(F.levenshtein("line", "lead", 1) == 1))
    near = links.select("lid", "place").distinct().withColumn("near", F.lit(True))
    fate = (distinct.join(near, ["lid", "place"], "left")
            .where((F.col("place") != F.col("last_place")) | F.col("near"))
            .select("digest", "place", F.coalesce("near", F.lit(False)).alias("near")))
    gone = (lines.select("digest", "doc_id", "th", "at").join(fate, "digest")
            .withColumn("first", F.struct("doc_id", "th", "at") == F.col("place"))
            .where(F.col("near") | ~F.col("first")))
    # sets, because repeated rows name their places more than once
    return gone.groupBy("doc_id", "th").agg(F.collect_set("at").alias("gone"),
                                            F.size(F.collect_set(F.when(F.col("near"), F.col("at")))).alias("n_near"))


def rewrite(docs: DataFrame, shortest: int = SHORT) -> DataFrame:
    """``docs`` with __lines (how many), __gone (dropped line numbers or null), __near and
    __text (what is left)."""
    gone = stored(dropped_lines(docs, shortest), "dropped-lines").select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"), F.col("n_near").alias("__near"))
    rows = docs.withColumn("__h", F.xxhash64("text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    cut = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("__gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__cut"), i)), "\n")
    return (rows.withColumn("__cut", cut)
            .withColumn("__text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
            .withColumn("__lines", F.coalesce(F.size("__cut"), F.lit(0))).drop("__h", "__id", "__th", "__cut"))


def report(docs: DataFrame) -> DataFrame:
    return rewrite(docs.select("doc_id", "text")).select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("__lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("__near", F.lit(0)).cast("long").alias("n_near"), sha256_hex(F.col("__text")).alias("text_sha256"))


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents without the dropped lines (n_chars follows where it is there);
    a document that lost every non-blank line goes."""
    rows = rewrite(docs)
    lost = F.col("__gone").isNotNull()
    changed = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost, F.char_length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    blank = F.trim(F.translate("__text", "\n", "")) == ""
    return rows.where(~lost | ~blank).withColumns(changed).select(docs.columns)
