"""Personal data under per-subject keys: register, read, erase, custody, scope.

The master key is a column: give it from a table that is read at run time, since a literal is
printed in plans and event logs."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .commits import TableLog, partition_value

ERASED_NAME = "[ERASED]"
# stored keys are laid out in so many folders; an erasure rewrites those of its subjects
KEY_FOLDERS = 64
_STORED = ("subject_id string, display_name string, key_version int, ciphertext binary, wrapped_key binary,"
           " note string, registered_at timestamp, folder int")


@F.pandas_udf(BinaryType())
def _fresh_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for ids in batches:
        yield pd.Series([os.urandom(32) for _ in range(len(ids))], index=ids.index)


_new_key = _fresh_keys.asNondeterministic()


def _wrap_aad() -> Column:
    return F.concat(F.col("subject_id"), F.lit("#v1"))


def rejected_registrations(requests: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """requests without a lawful basis or for a subject that is already known."""
    no_basis = F.length(F.trim(F.coalesce("lawful_basis", F.lit("")))) == 0
    known = requests
    if subjects is not None:
        known = known.join(subjects.select("subject_id", F.lit(True).alias("_known")), "subject_id", "left")
    else:
        known = known.withColumn("_known", F.lit(None).cast("boolean"))
    reason = F.when(no_basis, "lawful basis required").when(F.col("_known"), "already registered")
    return known.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("subject_id", "reason")


def register(requests: DataFrame, master_key: Column, path: str,
             subjects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(subjects, keys) for accepted requests (subject_id, display_name, pii, actor,
    lawful_basis, requested_at).

    Every subject gets a random key. The ciphertext and the wrapped key must come from the
    same draw, so both are written below ``path`` in one job, as one commit, and read back from there. Of
    several requests for one subject the earliest counts."""
    ok = requests.where(F.length(F.trim(F.coalesce("lawful_basis", F.lit("")))) > 0)
    if subjects is not None:
        ok = ok.join(subjects.select("subject_id"), "subject_id", "left_anti")
    cols = ["display_name", "pii", "actor", "lawful_basis"]
    first = (ok.groupBy("subject_id").agg(F.min(F.struct("requested_at", *cols)).alias("r"))
             .select("subject_id", "r.*"))
    drawn = first.withColumn("_dek", _new_key("subject_id"))
    gcm, pad, iv = F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray())
    rows = (drawn.select(
        "subject_id", "display_name", F.lit(1).alias("key_version"),
        F.aes_encrypt("pii", "_dek", gcm, pad, iv, F.col("subject_id")).alias("ciphertext"),
        F.aes_encrypt("_dek", master_key, gcm, pad, iv, _wrap_aad()).alias("wrapped_key"),
        F.concat(F.lit("created by "), F.col("actor"), F.lit("; lawful basis: "),
                 F.col("lawful_basis")).alias("note"),
        F.col("requested_at").alias("registered_at"))
     .withColumn("folder", _folder()).repartition("folder"))
    log = TableLog(requests.sparkSession, path)
    log.commit({"subjects": log.stage("subjects", rows, "folder")})
    return registered(requests.sparkSession, path)


def _folder() -> Column:
    return F.pmod(F.xxhash64("subject_id"), F.lit(KEY_FOLDERS)).cast("int")


def registered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(subjects, keys) as they stand in the files of ``path``."""
    stored = TableLog(spark, path).read("subjects", _STORED)
    never = F.lit(None).cast("timestamp")
    return (stored.select("subject_id", "display_name", "ciphertext", "key_version", "registered_at",
                          never.alias("erased_at")),
            stored.select("subject_id", "key_version", "wrapped_key", "note",
                          F.col("registered_at").alias("created_at"), never.alias("revoked_at")))


def read_personal_data(subjects: DataFrame, keys: DataFrame, master_key: Column) -> DataFrame:
    """(subject_id, pii); null once the key is destroyed or does not fit."""
    active = (keys.where(F.col("revoked_at").isNull() & F.col("wrapped_key").isNotNull())
              .groupBy("subject_id").agg(F.max_by("wrapped_key", "key_version").alias("_wrapped")))
    gcm, pad = F.lit("GCM"), F.lit("DEFAULT")
    dek = F.try_aes_decrypt("_wrapped", master_key, gcm, pad, _wrap_aad())
    return (subjects.join(active, "subject_id", "left").withColumn("_dek", dek)
            .select("subject_id", F.try_aes_decrypt(
                "ciphertext", "_dek", gcm, pad, F.col("subject_id")).cast("string").alias("pii")))


def erase(subjects: DataFrame, keys: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subjects, keys, results) after the requests (subject_id, actor, requested_at).

    The returned tables are the logical state; ``shred`` destroys the keys in the stored files.
    Asking twice changes nothing; unknown ids are only reported."""
    first = (requests.groupBy("subject_id").agg(F.min(F.struct("requested_at", "actor")).alias("r"))
             .select("subject_id", F.col("r.requested_at").alias("_at"), F.col("r.actor").alias("_by")))
    state = subjects.select("subject_id", F.lit(True).alias("_known"), F.col("erased_at").alias("_was"))
    results = first.join(state, "subject_id", "left").withColumn(
        "reason", F.when(F.col("_known").isNull(), "unknown subject")
        .when(F.col("_was").isNotNull(), "already erased"))
    hits = results.where(F.col("reason").isNull()).select("subject_id", "_at", "_by")
    gone = F.col("_at").isNotNull()
    new_subjects = (subjects.join(hits, "subject_id", "left")
                    .withColumn("erased_at", F.coalesce("erased_at", "_at"))
                    .withColumn("display_name", F.when(gone, ERASED_NAME).otherwise(F.col("display_name")))
                    .drop("_at", "_by"))
    live = gone & F.col("revoked_at").isNull()
    new_keys = (keys.join(hits, "subject_id", "left")
                .withColumn("wrapped_key", F.when(~F.coalesce(live, F.lit(False)), F.col("wrapped_key")))
                .withColumn("note", F.when(live, F.concat(F.col("note"), F.lit(" | crypto-shredded by "),
                                                          F.col("_by"))).otherwise(F.col("note")))
                .withColumn("revoked_at", F.when(live, F.col("_at")).otherwise(F.col("revoked_at")))
                .drop("_at", "_by"))
    return new_subjects, new_keys, results.select(
        "subject_id", F.col("reason").isNull().alias("erased"), "reason", F.col("_at").alias("requested_at"))


def shred(spark: SparkSession, path: str, erased: DataFrame) -> None:
    """destroys the wrapped keys of the subjects in the stored files as well. Only the
    folders that hold these subjects are written anew; one commit puts the new ones in the place of the
    old, then the old files are deleted, so no file below ``path`` can decrypt them. A run that
    is lost before the commit has changed nothing; one that is lost after it is made good by the
    next, which deletes what the log says was taken away."""
    log = TableLog(spark, path)
    asked = erased.select("subject_id").distinct().withColumn("_gone", F.lit(True))
    wanted = {str(r[0]) for r in asked.select(_folder().alias("f")).distinct().collect()}  # at most KEY_FOLDERS
    old = [f for f in log.snapshot().of("subjects") if partition_value(f, "folder") in wanted]
    if old:
        rows = (log.read("subjects", _STORED, old).join(asked, "subject_id", "left")
                .withColumn("wrapped_key", F.when(F.col("_gone").isNull(), F.col("wrapped_key")))
                .withColumn("display_name", F.when(F.col("_gone"), ERASED_NAME).otherwise(F.col("display_name"))).drop("_gone"))
        new = log.stage("subjects", rows.repartition("folder"), "folder")
        log.commit({"subjects": new}, {"subjects": old})
    log.purge()


def erasure_events(results: DataFrame) -> DataFrame:
    """Ledger payloads of erasures that took place."""
    return results.where("erased").select(
        F.lit("subject_erased").alias("event_type"), F.to_json(F.struct("subject_id")).alias("payload"),
        F.col("requested_at").alias("created_at"), F.col("subject_id").alias("source_id"))


def binding_events(bindings: DataFrame) -> DataFrame:
    """Ledger payloads that bind events to subjects: (subject_id, event_id, ts)."""
    return bindings.select(
        F.lit("subject_event_bound").alias("event_type"),
        F.to_json(F.struct("event_id", "subject_id")).alias("payload"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("source_id"))


def custody(keys: DataFrame, subject_id: str | None = None) -> DataFrame:
    """key history, never key material."""
    k = keys if subject_id is None else keys.where(F.col("subject_id") == subject_id)
    return k.select("subject_id", "key_version", "note", "created_at", "revoked_at") \
        .orderBy("subject_id", "key_version")


def display_form(subjects: DataFrame) -> DataFrame:
    """F5."""
    # fixed value: the mark behind an erased subject
    erased = F.concat(F.col("subject_id"), F.lit(" [erased — crypto-shredded]"))
    return subjects.select("subject_id", F.when(F.col("erased_at").isNotNull(), erased)
                           .otherwise(F.col("display_name")).alias("display"))


def erasure_scope(events: DataFrame, bindings: DataFrame, subjects: DataFrame) -> DataFrame:
    """events bound to the given subjects."""
    bound = bindings.join(subjects.select("subject_id"), "subject_id", "left_semi")
    return events.join(bound.select("event_id"), "event_id", "left_semi")
