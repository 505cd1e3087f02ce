"""Merkle dataset manifest: a binary hash tree over the rows of each group.

Every row is a leaf, the leaves of a group ascend by id, and every two consecutive
nodes make a parent until one is left, the group's subroot; the subroots make the
root of the table in the same way. A row's proof is the siblings on its way up,
so that anyone who holds the row and its proof can recompute the root.

A level is a window: partitioned by group and parent index, its ordered full-frame
``collect_list`` gives each node both the parent's preimage and its sibling, and the
first child of each parent goes on to the next level. ``STRIDE`` levels run on one
shuffle, because rows that are dealt by group and block of ``2 ** STRIDE`` nodes
already stand together for every window inside the block; a block is all that a task
ever has to hold, however many rows a group has. A node carries the proofs of the
nodes below it in its block; the proofs above a block are joined to it as a whole.

Leaf positions come from a range partitioning of (group, id, leaf, row), counted by
partition, so no group is sorted in one task. Digests travel as 32 bytes and are
hashed as lowercase hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.staging import stage

STRIDE = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEFT, RIGHT = b"\x00", b"\x01"  # where a sibling stands; an entry without one is empty


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def leaf_of(columns: list[Column]) -> Column:
    return digest(F.concat(*map(field, columns)))


def group_key(column: Column) -> Column:
    """Null sorts before every string, and strings by their bytes."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``idx``, from 0 in the order of ``keys`` within each ``g``, and ``n``, the rows of ``g``.

    What the driver's plan holds is a row for each group and partition.
    """
    dealt = rows.repartitionByRange("g", *keys).sortWithinPartitions("g", *keys)
    at = F.monotonically_increasing_id()
    placed = stage(dealt.withColumns({"part": F.shiftright(at, 33).cast("int"), "at": at.bitwiseAND((1 << 33) - 1)}), "positions")
    runs = placed.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"base": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(whole)})
    joined = placed.join(runs.drop("rows"), ["g", "part"])
    return joined.withColumn("idx", F.col("base") + F.col("at") - F.col("first")).drop("base", "at", "first", "part")


def level(nodes: DataFrame) -> DataFrame:
    """The parents of ``g, block, idx, n, digest, members``; a group of one node stays as it is.

    ``members`` are the rows below a node, each with its proof so far.
    """
    parent = F.expr("idx div 2")
    siblings = Window.partitionBy("g", "block", parent).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kids = F.collect_list(F.struct("digest", "members")).over(siblings)
    first = nodes.withColumn("kids", kids).filter("idx % 2 = 0")
    left, right = F.col("kids")[0], F.try_element_at("kids", F.lit(2))

    def extended(node: Column, sibling: Column, side: bytes) -> Column:
        entry = F.coalesce(F.concat(F.lit(side), sibling["digest"]), F.lit(b""))
        return F.transform(node["members"], lambda m: F.struct(m["payload"].alias("payload"), F.array_append(m["proof"], entry).alias("proof")))

    preimage = F.concat(hex_of(left["digest"]), F.coalesce(hex_of(right["digest"]), F.lit("")))
    below = F.concat(extended(left, right, RIGHT), F.coalesce(extended(right, left, LEFT), F.array()))
    alone = F.col("n") == 1
    return first.select(
        "g",
        "block",
        parent.alias("idx"),
        F.expr("(n + 1) div 2").alias("n"),
        F.when(alone, left["digest"]).otherwise(digest(preimage)).alias("digest"),
        F.when(alone, left["members"]).otherwise(below).alias("members"),
    )


def stride(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """``STRIDE`` levels over ``g, idx, n, digest``: one node for each block, with its members."""
    proof = F.array().cast("array<binary>")
    member = F.array(F.struct(F.struct("idx", *payload).alias("payload"), proof.alias("proof")))
    block = F.shiftright("idx", STRIDE)
    rows = nodes.select("g", block.alias("block"), "idx", "n", "digest", member.alias("members"))
    rows = rows.repartition("g", "block")
    for _ in range(STRIDE):
        rows = level(rows)
    return rows.drop("block")


def tree(leaves: DataFrame, payload: list[str]) -> DataFrame:
    """``g, root, proof`` and the payload for every row of ``g, idx, n, digest`` and the payload."""
    packed = [stage(stride(leaves, payload), "stride")]
    while packed[-1].filter("n > 1").limit(1).count():
        packed.append(stage(stride(packed[-1], []), "stride"))
    roots = packed[-1].select("g", F.col("digest").alias("root"))
    above = None
    for nodes in reversed(packed):
        if above is not None:
            nodes = nodes.select("g", "idx", "members").join(above, ["g", "idx"])
        rest = F.array().cast("array<binary>") if above is None else F.col("above")
        opened = nodes.select("g", rest.alias("rest"), F.explode("members").alias("m"))
        above = opened.select("g", "m.payload.*", F.concat("m.proof", "rest").alias("above"))
    return above.withColumnRenamed("above", "proof").join(roots.toDF("g", "root"), "g")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""

    def up(digest_so_far: Column, entry: Column) -> Column:
        sibling = hex_of(F.substring(entry, 2, 32))
        own = hex_of(digest_so_far)
        return digest(F.when(F.substring(entry, 1, 1) == F.lit(LEFT), F.concat(sibling, own)).otherwise(F.concat(own, sibling)))

    return F.aggregate(proof, leaf, up)


def siblings_of(proof: Column) -> Column:
    """The siblings' digests as hex text, one after the other."""
    return F.concat_ws("", F.transform(proof, lambda e: hex_of(F.substring(e, 2, 32))))


def manifest(rows: DataFrame, order: str, payload: list[str]) -> DataFrame:
    """``subroot, root, proof`` and the payload of every row of ``g, digest``, the order and the payload.

    Rows of a group ascend by ``order`` (null first), equal ones by their leaves, and
    equal leaves, which are interchangeable, as they come.
    """
    numbered = positions(rows.withColumn("row", F.monotonically_increasing_id()), [order, "digest", "row"])
    within = tree(numbered, ["digest", *payload])
    subroots = within.select("g", F.col("root").alias("digest")).distinct()
    over = positions(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"])
    top = tree(over, ["name"]).select(F.col("name").alias("g"), F.col("root").alias("whole"), F.col("proof").alias("top"))
    joined = within.join(top, "g")
    return joined.select(*payload, "digest", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("proof", "top").alias("proof"))


def verify_documents(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root recomputed after tampering.

    Groups are languages. A document is tampered with where 7 divides the unsigned
    crc32 of its decimal id: its ``n_chars`` grows by one. A null id is never
    tampered with, nor a null ``n_chars``. Null fields, empty and very long texts,
    repeated ids and rows, and other columns of any name are all allowed; an empty
    table gives no rows.
    """
    columns = {c: F.col(c) for c in FIELDS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    longer = columns | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    leaves = docs.select(
        "doc_id",
        group_key(F.col("lang")).alias("g"),
        leaf_of(list(columns.values())).alias("digest"),
        F.when(hit, leaf_of(list(longer.values()))).alias("tampered"),
    )
    made = manifest(stage(leaves, "leaves"), "doc_id", ["doc_id", "tampered"])
    folded = fold(F.coalesce("tampered", "digest"), F.col("proof"))
    return made.withColumn("folded", folded).select(
        "doc_id",
        hex_of(F.col("digest")).alias("leaf"),
        hex_of(F.col("subroot")).alias("subroot"),
        hex_of(F.col("root")).alias("root"),
        F.sha2(siblings_of(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        hex_of(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
