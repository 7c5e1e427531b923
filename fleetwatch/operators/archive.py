"""Chunked ledger archive and full exports, both verifiable from the files alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from .. import schemas
from ..session import work_dir
from . import ledger as chain
from .sequences import previous_values, range_bucket

# JSON keeps milliseconds unless told otherwise
_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_COLS = ["seq", "event_type", "payload_hash", "prev_hash", "signature", "created_at"]


def _digest() -> Column:
    ordered = F.sort_array(F.collect_list(F.struct("seq", "payload_hash")))
    return F.sha2(F.array_join(F.transform(ordered, lambda s: s["payload_hash"]), ""), 256)


def chunks(ledger: DataFrame, chunk_rows: int = R.ARCHIVE_CHUNK_ROWS) -> DataFrame:
    """The manifest of a ledger: per chunk its key, range, row count and chain digest."""
    return _describe(ledger.withColumn(
        "chunk", F.call_function("div", F.col("seq") - 1, F.lit(chunk_rows))))


def _describe(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("chunk").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
                                  F.count(F.lit(1)).alias("rows"), _digest().alias("chain_digest"))
    return g.select(_key().alias("key"), "chunk", "first_seq", "last_seq", "rows", "chain_digest")


def _key() -> Column:
    return F.format_string("chunk_%012d_%012d", "first_seq", "last_seq")


def file_hashes(spark: SparkSession, path: str, since_key: str | None = None) -> DataFrame:
    """SHA-256 of every stored chunk file, or of those from a key on: (key, sha256)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/chunks")
    if since_key is not None:
        files = files.where(F.col("key") >= since_key)
    return files.select("key", F.sha2("content", 256).alias("sha256"))


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with the key of their chunk. No file decides what the columns are."""
    return spark.read.schema(f"{schemas.LEDGER}, key string").parquet(f"{path}/chunks")


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """The current manifest: the longest stored version of each chunk number."""
    m = spark.read.parquet(f"{path}/manifest")
    top = m.groupBy("chunk").agg(F.max("last_seq").alias("last_seq"))
    # a run that was lost while its rows were committed lists them again
    return m.join(top, ["chunk", "last_seq"], "left_semi").dropDuplicates(["key"])


def archived_through(spark: SparkSession, path: str, chunk_rows: int = R.ARCHIVE_CHUNK_ROWS) -> int:
    """The last number before the first chunk that is not stored whole."""
    if not path_exists(spark, f"{path}/manifest"):
        return 0
    full = spark.read.parquet(f"{path}/manifest").where(F.col("rows") == chunk_rows).select("chunk").distinct()
    ends = full.select((F.col("chunk") + 1).alias("chunk")).unionByName(spark.range(1).select(F.col("id").alias("chunk")))
    return chunk_rows * ends.join(full, "chunk", "left_anti").agg(F.min("chunk")).first()[0]


def pending_rows(ledger: DataFrame, path: str, chunk_rows: int = R.ARCHIVE_CHUNK_ROWS,
                 upto_seq: int | None = None) -> DataFrame:
    """The rows of chunks that the archive does not hold whole. The bound is a plain number, so
    it reaches the scan of the ledger: a run reads what is new and the last, short chunk."""
    rows = ledger.where(F.col("seq") > archived_through(ledger.sparkSession, path, chunk_rows))
    return rows if upto_seq is None else rows.where(F.col("seq") <= upto_seq)


def archive_ledger(ledger: DataFrame, path: str, chunk_rows: int = R.ARCHIVE_CHUNK_ROWS,
                   upto_seq: int | None = None) -> DataFrame:
    """Writes the chunks that are not stored yet, then their manifest rows, and returns
    the current manifest. Chunks never change: a last chunk that has grown gets a new key.

    A run costs what is new: the manifest says where the whole chunks end, only later rows are
    read, and only files from there on are described and hashed. The manifest is written after the
    files and lists a chunk only if its file holds what the ledger gave, so a lost run leaves only
    unlisted files, which the next run overwrites."""
    spark = ledger.sparkSession
    start = archived_through(spark, path, chunk_rows)
    since = f"chunk_{start + 1:012d}"
    rows = pending_rows(ledger, path, chunk_rows, upto_seq).select(*_COLS).withColumn(
        "chunk", F.call_function("div", F.col("seq") - 1, F.lit(chunk_rows)))
    wanted = _describe(rows)
    if path_exists(spark, f"{path}/manifest"):
        wanted = wanted.join(spark.read.parquet(f"{path}/manifest").select("key"), "key", "left_anti")
    listed = work_dir(spark, "archive-chunks")
    wanted.write.parquet(listed)
    wanted = spark.read.schema(wanted.schema).parquet(listed)
    new = rows.join(wanted.select("chunk", "key"), "chunk").drop("chunk")
    (new.repartition("key").sortWithinPartitions("key", "seq").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{path}/chunks"))
    if path_exists(spark, f"{path}/chunks") and not wanted.isEmpty():
        stored = (stored_chunks(spark, path).where(F.col("key") >= since)
                  .withColumn("chunk", F.call_function("div", F.col("seq") - 1, F.lit(chunk_rows))))
        fresh = (_describe_keys(stored).join(wanted.select("key", "rows", "chain_digest"), ["key", "rows", "chain_digest"], "left_semi")
                 .join(file_hashes(spark, path, since), "key"))
        fresh.write.mode("append").parquet(f"{path}/manifest")
    return manifest_of(spark, path)


def _describe_keys(stored: DataFrame) -> DataFrame:
    return (stored.groupBy("key").agg(
        F.min("chunk").alias("chunk"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.count(F.lit(1)).alias("rows"), _digest().alias("chain_digest")))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def verify_chunks(manifest: DataFrame, stored: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(key, reason) per manifest chunk, recomputed from the stored rows; a null reason
    is a good chunk. ``stored`` has the archived columns and ``key``."""
    live = stored.join(manifest.select("key"), "key", "left_semi")
    actual = live.groupBy("key").agg(
        F.min("seq").alias("_first"), F.max("seq").alias("_last"), F.count(F.lit(1)).alias("_rows"),
        _digest().alias("_digest"))
    linked = previous_values(live.select("key", "seq", "payload_hash", "prev_hash"), [],
                             range_bucket("seq", 65_536), ["seq"], "payload_hash")
    broken = (linked.where(~F.col("prev_hash").eqNullSafe(F.coalesce("prev_1", F.lit(R.GENESIS))))
              .groupBy("key").agg(F.min("seq").alias("_break")))
    out = manifest.join(actual, "key", "left").join(broken, "key", "left")
    file_ok = F.lit(True)
    if hashes is not None:
        out = out.join(hashes.withColumnRenamed("sha256", "_sha"), "key", "left")
        file_ok = F.coalesce(F.col("_sha") == F.col("sha256"), F.lit(False))
    # fixed values: reason texts of a failed verification
    reason = (F.when(F.col("_rows").isNull(), "chunk missing")
              .when(~file_ok, "chunk hash mismatch")
              .when((F.col("_first") != F.col("first_seq")) | (F.col("_last") != F.col("last_seq")),
                    "chunk boundary mismatch")
              .when(F.col("_digest") != F.col("chain_digest"), "chain digest mismatch")
              .when(F.col("_break").isNotNull(),
                    F.concat(F.lit("chain break at seq "), F.col("_break").cast("string")))
              .when(F.col("_rows") != F.col("rows"), "row count mismatch"))
    return out.select("key", "first_seq", "rows", reason.alias("reason"))


def verify_archive(spark: SparkSession, path: str) -> DataFrame:
    """A20 from the files alone."""
    return verify_chunks(manifest_of(spark, path), stored_chunks(spark, path),
                         file_hashes(spark, path))


def content_hash(df: DataFrame) -> DataFrame:
    """One row (rows, content): row count and an order-free sum of row hashes."""
    return df.groupBy().agg(*_content(df))


def _content(df: DataFrame) -> list[Column]:
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("content")]


def export_tables(tables: dict[str, DataFrame], path: str, as_json: bool = False) -> None:
    """Every table under ``path``; in JSON, which is compressed, binary columns become hex text."""
    for name, df in tables.items():
        if as_json:
            df = df.select(*[F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c)
                             for c, t in df.dtypes])
            df.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip") \
                .option("timestampFormat", _TS).json(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def rebuild_tables(spark: SparkSession, path: str, schemas: dict[str, str],
                   as_json: bool = False) -> dict[str, DataFrame]:
    """The exported tables with their declared schemas."""
    out = {}
    for name, ddl in schemas.items():
        wanted = spark.createDataFrame([], ddl).schema
        if not as_json:
            out[name] = spark.read.schema(wanted).parquet(f"{path}/{name}")
            continue
        text = ", ".join(f"`{f.name}` " + ("string" if f.dataType.simpleString() == "binary"
                                           else f.dataType.simpleString()) for f in wanted)
        df = spark.read.schema(text).option("timestampFormat", _TS).json(f"{path}/{name}")
        out[name] = df.select(*[F.unhex(f.name).alias(f.name) if f.dataType.simpleString() == "binary"
                                else F.col(f.name) for f in wanted])
    return out


def compare_tables(source: dict[str, DataFrame], rebuilt: dict[str, DataFrame]) -> DataFrame:
    """Per table the row counts of both sides and whether the content is equal."""
    out = None
    for name, df in source.items():
        a = content_hash(df).select("rows", "content")
        b = content_hash(rebuilt[name])
        row = a.select(F.lit(name).alias("table"), "rows",
                       b.select("rows").scalar().alias("rebuilt_rows"),
                       (F.col("content").eqNullSafe(b.select("content").scalar())).alias("same_content"))
        out = row if out is None else out.unionByName(row)
    return out


def export_bundle(tables: dict[str, DataFrame], path: str, as_json: bool = True) -> None:
    """Every table under ``path`` and, written last, the bundle's manifest: per table its
    columns, row count and content digest, taken from the source, and the digest of every file.
    A bundle without manifest is one whose export did not end. Count and digest are observed on the source
    rows while they are written, so that no table is made twice."""
    spark = next(iter(tables.values())).sparkSession
    seen = {name: Observation() for name in tables}
    export_tables({name: df.observe(seen[name], *_content(df)) for name, df in tables.items()}, path, as_json)
    _exported_files(spark, path).write.mode("overwrite").parquet(f"{path}/manifest/files")
    ddl = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    listed = spark.createDataFrame(  # one row per table
        [(name, ddl(df), as_json, seen[name].get["rows"], seen[name].get["content"]) for name, df in tables.items()],
        "table string, columns string, as_json boolean, rows bigint, content string")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/tables")


def _exported_files(spark: SparkSession, path: str) -> DataFrame:
    """(table, file, sha256) of the part files below ``path``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("table"), F.element_at(parts, -1).alias("file"), F.sha2("content", 256).alias("sha256"),
                        F.element_at(parts, -3).alias("above")).where(F.col("above") != "manifest").drop("above")


def rebuild_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle as its manifest declares them."""
    listed = spark.read.parquet(f"{path}/manifest/tables").select("table", "columns", "as_json").collect()  # one row per table
    out = {}
    for as_json in {r["as_json"] for r in listed}:
        out |= rebuild_tables(spark, path, {r["table"]: r["columns"] for r in listed if r["as_json"] == as_json}, as_json)
    return out


def verify_bundle_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, id, detail) for every file of a bundle, listed or found; works also where a file
    has become unreadable."""
    said = spark.read.parquet(f"{path}/manifest/files").withColumnRenamed("sha256", "said")
    # fixed by this library: what may be wrong with a file
    reason = (F.when(F.col("sha256").isNull(), "file missing").when(F.col("said").isNull(), "file not listed")
              .when(F.col("said") != F.col("sha256"), "file altered"))
    return said.join(_exported_files(spark, path), ["table", "file"], "full").select(
        F.lit("file").alias("part"), F.concat_ws("/", "table", "file").alias("id"), reason.alias("detail"))


def verify_bundle(spark: SparkSession, path: str, ledger: str = "ledger", seals: str = "seals") -> DataFrame:
    """A21 from the files alone: (part, id, ok, detail) for every file, every table, the chain
    and the seals of the rebuilt copy. A null detail is a good part."""
    parts = verify_bundle_files(spark, path)
    rebuilt = rebuild_bundle(spark, path)
    listed = spark.read.parquet(f"{path}/manifest/tables").select("table", F.col("rows").alias("said_rows"), F.col("content").alias("said"))
    counted = None
    for name, df in rebuilt.items():
        row = content_hash(df).withColumn("table", F.lit(name))
        counted = row if counted is None else counted.unionByName(row)
    reason = F.when(F.col("rows") != F.col("said_rows"), "row count mismatch").when(~F.col("content").eqNullSafe(F.col("said")), "content mismatch")
    parts = parts.unionByName(listed.join(counted, "table").select(F.lit("table").alias("part"), F.col("table").alias("id"), reason.alias("detail")))
    if ledger in rebuilt:
        checked = F.concat(F.lit("broken after "), F.col("checked").cast("string"), F.lit(" entries"))
        parts = parts.unionByName(chain.verify_chain(rebuilt[ledger]).select(
            F.lit("chain").alias("part"), F.lit(ledger).alias("id"), F.when(~F.col("ok"), checked).alias("detail")))
        if seals in rebuilt:
            parts = parts.unionByName(chain.verify_seals(rebuilt[ledger], rebuilt[seals]).select(
                F.lit("seal").alias("part"), F.col("seal_id").alias("id"), F.col("reason").alias("detail")))
    return parts.select("part", "id", F.col("detail").isNull().alias("ok"), "detail")
