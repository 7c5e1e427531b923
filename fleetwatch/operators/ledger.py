"""The evidence ledger: append, chain verification, Merkle roots and seals.

An entry is linked to the payload hash of the entry before it, so a whole batch can be
appended at once. Sequence numbers are contiguous from 1; order-dependent steps work on
ranges of them and never sort the ledger in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.hashing import payload_digest
from ..session import kept
from .commits import TableLog
from .sequences import previous_values, range_bucket, running_offsets, time_bucket

# rows ordered by one task
CHAIN_RANGE = 1 << 20
BLOCK = 1024
_HEIGHT = 10


def payload_problems(entries: DataFrame, payload: str = "payload") -> DataFrame:
    """Entries whose payload has no canonical form, with the reason. JSON has no NaN or
    infinity, so numbers that are not finite show up as invalid JSON or as such words."""
    return entries.withColumn("reason", _payload_reason(F.col(payload), payload_digest(F.col(payload)))).where(F.col("reason").isNotNull())


def _payload_reason(p: Column, digest: Column) -> Column:
    # the words are rare: the pattern runs where one of them stands
    word = F.contains(p, F.lit("NaN")) | F.contains(p, F.lit("Infinity"))
    bare = word & p.rlike(r'(^|[\[:,\s])[-+]?(NaN|Infinity)\s*([,\]}]|$)')
    return F.when(p.isNull(), "missing payload").when(bare, "non-finite number").when(digest.isNull(), "invalid json")


def rejected(entries: DataFrame) -> DataFrame:
    """The entries that ``append`` refuses, with the reason. Accepted and rejected entries
    together are the batch."""
    return entries.withColumn("reason", _refusal(payload_digest(F.col("payload")))).where(F.col("reason").isNotNull())


def _refusal(digest: Column) -> Column:
    return F.coalesce(_payload_reason(F.col("payload"), digest), F.when(F.col("created_at").isNull(), "missing created_at"))


def _hashed(entries: DataFrame) -> DataFrame:
    """The accepted entries with their payload hash. Each payload is parsed once, by one expression
    that gives both the digest and the verdict; the small rows are stored, because two steps read them."""
    digest = payload_digest(F.col("payload"))
    rows = entries.select("event_type", "created_at", "source_id", digest.alias("payload_hash"), _refusal(digest).alias("reason"))
    return kept(rows, "hashed-entries").where(F.col("reason").isNull()).drop("reason")


def append(entries: DataFrame, ledger: DataFrame | None = None,
           order: Sequence[str] = ("created_at", "source_id"), bucket: Column | None = None,
           head: DataFrame | None = None) -> DataFrame:
    """Ledger rows for a batch of (event_type, payload, created_at, source_id). Entries
    that ``rejected`` names never enter the chain. The chain goes on after ``ledger``, or after
    ``head``, its one row of ``chain_head``. Entries that ``order`` does not tell apart follow
    each other by payload hash.

    ``bucket`` must not decrease along ``order``; minutes by default. Give a bucket over
    the source id when a large batch shares one creation time."""
    by = bucket if bucket is not None else time_bucket("created_at", 60)
    order = [*order, "payload_hash", "event_type"]
    # hashes are ordered and exchanged as bytes, half as long as their text
    keyed = _hashed(entries).withColumn("_bucket", by).withColumn("payload_hash", F.unhex("payload_hash"))
    text = lambda c: F.lower(F.hex(c))
    first, link = F.lit(0), F.lit(R.GENESIS)
    if ledger is not None:
        head = chain_head(ledger)
    if head is not None:
        first = F.coalesce(head.select("seq").scalar(), first)
        link = F.coalesce(head.select("payload_hash").scalar(), link)
    # one summary row per bucket gives both the first number and the link of the next bucket
    tails = keyed.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_rows"), F.max_by("payload_hash", F.struct(*order)).alias("_tail"))
    across = W.partitionBy(F.lit(0)).orderBy("_bucket")
    carried = running_offsets(tails, [], "_bucket", "_rows", "_before").select(
        "_bucket", "_before", F.lag("_tail").over(across).alias("_link"))
    inside = W.partitionBy("_bucket").orderBy(*order)
    rows = (keyed.withColumn("_local", F.row_number().over(inside))
            .withColumn("_prev", F.lag("payload_hash").over(inside)).join(carried, "_bucket"))
    return rows.select(
        (F.col("_before") + F.col("_local") + first).cast("bigint").alias("seq"), "event_type",
        text("payload_hash").alias("payload_hash"), F.coalesce(text("_prev"), text("_link"), link).alias("prev_hash"),
        F.lit(bytearray(R.UNSIGNED_MARK)).alias("signature"), "created_at", "source_id")


def chain_head(ledger: DataFrame) -> DataFrame:
    """One row: the last number and hash, null for an empty ledger."""
    return ledger.groupBy().agg(F.max("seq").alias("seq"), F.max_by("payload_hash", "seq").alias("payload_hash"))


_HASH = "^[0-9a-f]{64}$"


def _packed(h: Column) -> Column:
    """A hash as its 32 bytes, for an exchange; a text that is none is kept behind 33 zero bytes, so that no two
    texts become equal."""
    return F.when(h.rlike(_HASH), F.unhex(h)).otherwise(F.concat(F.lit(bytearray(33)), h.cast("binary")))


def _unpacked(b: Column) -> Column:
    return F.when(F.octet_length(b) == 32, F.lower(F.hex(b))).otherwise(F.substring(b, 34, (1 << 31) - 1).cast("string"))


def chain_breaks(ledger: DataFrame) -> DataFrame:
    """Entries that are malformed or do not link to the entry before them."""
    sig = F.col("signature")
    hash_ok = F.coalesce(F.col("payload_hash").rlike(_HASH), F.lit(False))
    sig_ok = F.coalesce((sig == F.lit(bytearray(R.UNSIGNED_MARK)))
                        | (F.octet_length(sig) == R.SIGNATURE_BYTES), F.lit(False))
    checked = ledger.select("seq", _packed(F.col("payload_hash")).alias("payload_hash"), _packed(F.col("prev_hash")).alias("prev_hash"),
                            hash_ok.alias("_hash_ok"), sig_ok.alias("_sig_ok"))
    rows = previous_values(checked, [], range_bucket("seq", CHAIN_RANGE), ["seq"], "payload_hash")
    linked = F.col("prev_hash").eqNullSafe(F.coalesce("prev_1", _packed(F.lit(R.GENESIS))))
    reason = (F.when(~F.col("_hash_ok"), "malformed hash").when(~F.col("_sig_ok"), "malformed signature")
              .when(~linked, "broken link"))
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("seq", "reason")


def verify_chain(ledger: DataFrame) -> DataFrame:
    """One row (ok, checked): entries verified before the first break."""
    first = chain_breaks(ledger).groupBy().agg(F.min("seq").alias("s")).scalar()
    limit = F.coalesce(first, F.lit((1 << 63) - 1))
    seqs = ledger.select("seq").withColumn("_limit", limit)
    return (seqs.groupBy().agg(F.count_if(F.col("seq") < F.col("_limit")).alias("checked"),
                               F.count(F.lit(1)).alias("_n"))
            .select((F.col("checked") == F.col("_n")).alias("ok"), "checked"))


def _fold(hashes: Column, pad: Column) -> Column:
    """Root of at most 1024 sorted nodes. An odd level repeats its last node; with ``pad``
    a short block is repeated up to the full height, otherwise it stops at one node."""
    def level(acc: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.call_function("div", F.size(acc) - 1, F.lit(2)).cast("int"))
        return F.transform(pairs, lambda i: F.sha2(F.unhex(F.concat(
            F.get(acc, i * 2), F.coalesce(F.get(acc, i * 2 + 1), F.get(acc, i * 2)))), 256))

    stop = lambda acc: (F.size(acc) == 1) & ~pad
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(_HEIGHT)), hashes,
                             lambda acc, _: F.when(stop(acc), acc).otherwise(level(acc))), F.lit(0))


def _nodes(ledger: DataFrame) -> DataFrame:
    return ledger.select((F.col("seq") - 1).alias("pos"), F.col("payload_hash").alias("hash"))


def _sorted() -> Column:
    """The (pos, hash) of a group in order."""
    return F.sort_array(F.transform(F.collect_list(F.struct("pos", _packed(F.col("hash")).alias("hash"))),
                                    lambda s: F.struct(s["pos"].alias("pos"), _unpacked(s["hash"]).alias("hash"))))


def _block_roots(nodes: DataFrame, full_only: bool = False) -> DataFrame:
    g = (nodes.groupBy(range_bucket("pos", BLOCK).alias("block"))
         .agg(F.transform(_sorted(), lambda s: s["hash"]).alias("_h"), F.count(F.lit(1)).alias("_n")))
    if full_only:
        g = g.where(F.col("_n") == BLOCK)
    return g.select(F.col("block").alias("pos"), _fold(F.col("_h"), F.col("block") > 0).alias("hash"))


def _levels(ledger: DataFrame, levels: int | None) -> int:
    """Levels of 1024-node blocks the ledger needs; reads one maximum when not given."""
    if levels is not None:
        return levels
    n = ledger.agg(F.max("seq")).first()[0] or 1
    levels = 1
    while BLOCK ** levels < n:
        levels += 1
    return levels


def merkle_root(ledger: DataFrame, levels: int | None = None) -> DataFrame:
    """E5: one row (root). Every level folds blocks of 1024 nodes where they are, so a
    level is a thousandth of the one below it and no step sees the whole ledger. Only the
    very first block may stay shorter than its full height: when it is the only one."""
    nodes = _nodes(ledger)
    for _ in range(_levels(ledger, levels)):
        nodes = _block_roots(nodes)
    empty = F.sha2(F.lit(R.GENESIS), 256)
    return nodes.groupBy().agg(F.coalesce(F.max("hash"), empty).alias("root"))


NODE_ROWS = "level int, pos bigint, hash string"


def extend_nodes(ledger: DataFrame, log: TableLog) -> int:
    """Stores the roots of full blocks of every level as table ``nodes`` of the log, and returns the
    number of levels. Only blocks after the stored ones are folded: the bound on ``seq`` is a plain
    number that reaches the scan of the ledger. All levels of a run are one commit."""
    now = log.snapshot()
    stored = log.read("nodes", NODE_ROWS, now.of("nodes"))
    have = {r["level"]: r["n"] for r in stored.groupBy("level").agg((F.max("pos") + 1).alias("n")).collect()}  # one row per level
    below, add, level = _nodes(ledger.where(F.col("seq") > have.get(1, 0) * BLOCK)), [], 1
    while True:
        new = log.stage("nodes", _block_roots(below, full_only=True).withColumn("level", F.lit(level)), "level")
        if not new and level not in have:
            break
        add += new
        start = have.get(level + 1, 0) * BLOCK
        below = (stored.where(F.col("level") == level).unionByName(log.read("nodes", NODE_ROWS, new))
                 .where(F.col("pos") >= start).select("pos", "hash"))
        level += 1
    if add:
        log.commit({"nodes": add})
    return level - 1


def _pairs(hashes: Column) -> Column:
    """The level above: one node per whole pair."""
    ends = F.sequence(F.lit(0), F.call_function("div", F.size(hashes), F.lit(2)).cast("int") - 1)
    return F.when(F.size(hashes) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(ends, lambda i: _joined(F.get(hashes, i * 2), F.get(hashes, i * 2 + 1))))


def _joined(left: Column, right: Column) -> Column:
    return F.sha2(F.unhex(F.concat(left, right)), 256)


def _folded(rows: Column, block: Column, asked: Column) -> Column:
    """(root, picks) of a block of sorted (pos, hash): its root if it is full, and the nodes of any of its levels
    that are asked for as (bit, pos, up, nth). All levels are folded once. A node above a position that is
    missing or there twice is null."""
    again = lambda s, i: F.coalesce(F.get(rows, i + 1)["pos"] == s["pos"], F.lit(False))
    leaves = F.transform(rows, lambda s, i: F.when((s["pos"] == block * BLOCK + i) & ~again(s, i), s["hash"]))
    node = lambda levels, a: F.get(F.get(levels, a["up"]), a["nth"])
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_HEIGHT)), F.array(leaves), lambda levels, _: F.concat(levels, F.array(_pairs(F.element_at(levels, -1)))),
        lambda levels: F.struct(F.get(F.get(levels, F.lit(_HEIGHT)), F.lit(0)).alias("root"), F.transform(
            asked, lambda a: F.struct(a["bit"].alias("bit"), a["pos"].alias("pos"), node(levels, a).alias("hash"))).alias("picks")))


def _root_of(n: Column, nodes: Column) -> Column:
    """Root of a prefix of n entries from its nodes by bit: whole subtrees, one per bit set in n. What is left of
    a level is joined to the node of its bit, or to itself; a bit without a node gives a null root."""
    node, top = lambda bit: F.try_element_at(nodes, bit), F.length(F.bin(n)) - 1
    rest = lambda bit: n % _power(bit) != 0
    one = lambda bit: F.call_function("shiftright", n, bit) % 2 == 1
    up = lambda left, bit: F.when(one(bit) & rest(bit), _joined(node(bit), left)).when(one(bit), _joined(node(bit), node(bit))) \
        .when(rest(bit), _joined(left, left))
    return F.when(n > 0, F.when(n == _power(top), node(top)).otherwise(
        F.aggregate(F.sequence(F.lit(0), top), F.lit(None).cast("string"), up)))


def _power(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def prefix_roots(ledger: DataFrame, counts: DataFrame, levels: int | None = None, log: TableLog | None = None) -> DataFrame:
    """Roots of several prefixes: ``counts`` has a distinct column ``covers``.

    A prefix is made of whole subtrees, one per bit set in its length, so it asks for as many nodes and not for its
    rows. Every level of blocks is folded once, whatever the number of prefixes, and stored with the nodes that
    are asked of it. With the ``log`` of ``extend_nodes`` the full blocks are read from there, and the ledger only
    from the last block of the shortest prefix on."""
    n = F.col("covers")
    bits = F.filter(F.sequence(F.lit(0), F.length(F.bin(n)) - 1), lambda b: F.call_function("shiftright", n, b) % 2 == 1)
    # one row per prefix and bit, several steps read them; a prefix of nothing keeps one row
    wanted = kept(counts.select("covers", F.explode_outer(F.when(n > 0, bits)).alias("bit"))
                  .withColumn("pos", F.call_function("shiftright", n, F.col("bit")) - 1), "merkle-wanted")
    ends = wanted.agg(F.min("covers").alias("least"), F.max("covers").alias("most")).first()
    height = 1
    while BLOCK ** height <= (ends["most"] or 1):
        height += 1
    if log is None:
        # the root of a ledger that just fills its levels is a node of the next one
        nodes, stored, height = _nodes(ledger), None, min(height, _levels(ledger, levels) + 1)
    else:
        nodes = _nodes(ledger.where(F.col("seq") > max(0, (ends["least"] or 1) - 1) // BLOCK * BLOCK))
        stored = log.read("nodes", NODE_ROWS)
    found = None
    for level in range(height):
        up = F.col("bit") - _HEIGHT * level
        block = F.call_function("shiftright", F.col("pos"), _HEIGHT - up)
        node = F.struct("bit", "pos", up.alias("up"), (F.col("pos") - block * _power(_HEIGHT - up)).cast("int").alias("nth"))
        asked = (wanted.where((up >= 0) & (up < _HEIGHT)).groupBy(block.alias("_block")).agg(F.collect_set(node).alias("_asked")))
        rows = (nodes.groupBy(range_bucket("pos", BLOCK).alias("_block"))
                .agg(_sorted().alias("_h"))
                .join(asked, "_block", "left" if stored is None else "inner"))
        blocks = rows.select(F.col("_block").alias("pos"), _folded(F.col("_h"), F.col("_block"), F.col("_asked")).alias("b"))
        if stored is None:
            blocks = kept(blocks, "merkle-blocks")
            nodes = blocks.where(F.col("b.root").isNotNull()).select("pos", F.col("b.root").alias("hash"))
        else:
            nodes = stored.where(F.col("level") == level + 1).select("pos", "hash")
        picks = blocks.select(F.explode("b.picks").alias("p")).select("p.*")
        found = picks if found is None else found.unionByName(picks)
    one = F.when(F.col("hash").isNotNull(), F.struct("bit", "hash"))
    return (wanted.join(found, ["bit", "pos"], "left").groupBy("covers").agg(F.map_from_entries(F.collect_set(one)).alias("_n"))
            .select("covers", _root_of(n, F.col("_n")).alias("root")))


def seal_message(root: Column, covers: Column) -> Column:
    """Root text followed by the covered sequence number as eight big-endian bytes."""
    return F.concat(root.cast("binary"), F.unhex(F.lpad(F.hex(covers), 16, "0")))


def token_bound(token: Column, message: Column) -> Column:
    """The token bytes contain the SHA-256 of the message."""
    return F.contains(token, F.unhex(F.sha2(message, 256)))


def seal(ledger: DataFrame, sealed_at: Column, public_key: Column | None = None,
         signature: Column | None = None, countersign: Column | None = None, log: TableLog | None = None) -> DataFrame:
    """The seal row over the whole ledger. Signature and countersign come from outside.
    An empty ledger gives no row, and so does a countersign that is not bound to the
    message: nothing may be stored in either case. With the ``log`` of ``extend_nodes`` a seal folds
    what came after its last full block."""
    none = F.lit(None).cast("binary")
    last = ledger.groupBy().agg(F.max("seq").alias("covers"))
    if log is not None:
        s = prefix_roots(ledger, last.where(F.col("covers").isNotNull()), log=log).withColumnRenamed("covers", "covers_through_seq")
    else:
        s = merkle_root(ledger).withColumn("covers_through_seq", last.scalar())
    s = s.where(F.col("covers_through_seq").isNotNull())
    s = s.select(
        F.format_string("seal_%08d_%d", "covers_through_seq", F.unix_seconds(sealed_at)).alias("seal_id"),
        F.col("root").alias("root_hash"), "covers_through_seq",
        (public_key if public_key is not None else none).alias("public_key"),
        (signature if signature is not None else none).alias("signature"),
        sealed_at.alias("sealed_at"),
        (countersign if countersign is not None else none).alias("countersign"))
    if countersign is not None:
        s = s.where(F.coalesce(token_bound(F.col("countersign"), seal_message(
            F.col("root_hash"), F.col("covers_through_seq"))), F.lit(False)))
    return s


def seal_events(seals: DataFrame) -> DataFrame:
    """Ledger payloads that record new seals."""
    payload = F.to_json(F.struct(
        F.col("countersign").isNotNull().alias("countersigned"), "covers_through_seq",
        F.col("root_hash").alias("root"), "seal_id"))
    return seals.select(F.lit("ledger_seal").alias("event_type"), payload.alias("payload"),
                        F.col("sealed_at").alias("created_at"), F.col("seal_id").alias("source_id"))


def rotation_events(rotations: DataFrame) -> DataFrame:
    """Ledger payloads of key rotations (rotation_id, old_public, new_public, rotated_at)."""
    payload = F.to_json(F.struct(F.lower(F.hex("new_public")).alias("new_public"),
                                 F.lower(F.hex("old_public")).alias("old_public")))
    return rotations.select(F.lit("key_rotation").alias("event_type"), payload.alias("payload"),
                            F.col("rotated_at").alias("created_at"), F.col("rotation_id").alias("source_id"))


def verify_seals(ledger: DataFrame, seals: DataFrame) -> DataFrame:
    """(seal_id, ok, countersigned, countersign_ok, reason) for every seal. The caller
    supplies ``signature_ok``; missing means not verified, hence not ok."""
    facts = ledger.groupBy().agg(
        F.max("seq").alias("m"),
        F.min(F.when(~F.coalesce(F.col("payload_hash").rlike("^([0-9a-fA-F]{2})*$"), F.lit(False)),
                     F.col("seq"))).alias("bad"))
    covers = F.col("covers_through_seq")
    roots = prefix_roots(ledger, seals.select(covers.alias("covers")).distinct())
    # one value, from one pass over the ledger
    known = facts.select(F.struct("m", "bad")).scalar()
    s = seals.join(roots, covers == F.col("covers"), "left").withColumn("_known", known)
    beyond = covers > F.coalesce(F.col("_known")["m"], F.lit(0))
    spoiled = F.coalesce(F.col("_known")["bad"] <= covers, F.lit(False))
    matches = (F.coalesce(F.col("root") == F.col("root_hash"), F.lit(False))
               & F.coalesce("signature_ok", F.lit(False)))
    countersigned = F.col("countersign").isNotNull()
    bound = F.coalesce(token_bound(F.col("countersign"), seal_message(F.col("root"), covers)), F.lit(False))
    # fixed values: reason texts of a failed verification
    reason = (F.when(beyond, "covers seq beyond ledger")
              .when(spoiled, "corrupt payload hash in covered range")
              .when(~matches, "root or signature mismatch")
              .when(countersigned & ~bound, "countersign binding failed"))
    return s.select("seal_id", covers, reason.isNull().alias("ok"), countersigned.alias("countersigned"),
                    F.when(~beyond & ~spoiled & matches & countersigned, bound).alias("countersign_ok"),
                    reason.alias("reason"))


def latest_seal(seals: DataFrame) -> DataFrame:
    """E10."""
    top = F.max_by(F.struct("seal_id", "root_hash"), F.struct("covers_through_seq", "seal_id"))
    return (seals.groupBy().agg(top.alias("s"), F.max("covers_through_seq").alias("covers_through_seq"))
            .where(F.col("covers_through_seq").isNotNull())
            .select("s.seal_id", "s.root_hash", "covers_through_seq"))


def entries_by_type(ledger: DataFrame) -> DataFrame:
    """E10."""
    return ledger.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def integrity_card(ledger: DataFrame, seals: DataFrame) -> DataFrame:
    """One row: chain and seal state with status empty, pass or fail."""
    checked = verify_seals(ledger, seals)
    s = checked.groupBy().agg(F.struct(F.count(F.lit(1)).alias("seals"), F.count_if("ok").alias("seals_valid")).alias("s"))
    status = (F.when((F.col("entries") == 0) & (F.col("seals") == 0), "empty")
              .when(F.col("chain_ok") & (F.col("seals") == F.col("seals_valid")), "pass").otherwise("fail"))
    return (verify_chain(ledger).select(F.col("ok").alias("chain_ok"), F.col("checked").alias("entries"))
            .withColumn("s", s.scalar()).select("chain_ok", "entries", "s.seals", "s.seals_valid").withColumn("status", status))


def audit_trail(ledger: DataFrame, seals: DataFrame) -> DataFrame:
    """The chain and every seal as rows (part, id, ok, detail)."""
    chain = verify_chain(ledger).select(
        F.lit("chain").alias("part"), F.lit("ledger").alias("id"), "ok",
        F.concat(F.col("checked").cast("string"), F.lit(" entries checked")).alias("detail"))
    s = verify_seals(ledger, seals).select(
        F.lit("seal").alias("part"), F.col("seal_id").alias("id"), "ok",
        F.coalesce("reason", F.lit("")).alias("detail"))
    return chain.unionByName(s)
