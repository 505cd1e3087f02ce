"""Chat formatting: collapse of cumulative snapshots, then rendering.

Chat logs often hold a conversation many times, each snapshot a few turns longer.
Every turn gets a rolling hash of the turns up to it (an exclusive-or of
position-bound turn hashes, twice 64 bits). A conversation whose last hash is
also the hash of an inner turn of another is a prefix of it; an anti-join keeps
the maximal ones, of equal ones that with the smallest id (one without an id last).

Turns are numbered and hashed in blocks of ``BLOCK_TURNS`` by their turn number,
and the blocks are joined up by their sums, so no task gathers a conversation
with numbered turns, however long; turns without a number, or with one and the
same, are one block. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.staging import stage

BLOCK_TURNS = 1024


#: A conversation: its id, or none. Plain columns, so that windows, groups and
#: joins by conversation and block find the same partitioning.
CONVERSATION = ["id", "no_id"]


def _turn_hash(salt: int) -> Column:
    known = F.coalesce(F.col("role").isNull().cast("int"), F.lit(0)) * 2 + F.col("text").isNull().cast("int")
    return F.xxhash64(F.lit(salt), F.col("pos"), known, F.col("role"), F.col("text"))


def positions(turns: DataFrame) -> DataFrame:
    """Turns with ``pos`` from 1 and ``n_turns``, by (turn, role, text), nulls first.

    Turns are numbered within blocks of turn numbers; null or equal turn numbers
    are in one block, which one task sorts (with spilling).
    """
    some = F.lit(0).cast(turns.schema["conv_id"].dataType)
    conversation = [F.coalesce("conv_id", some).alias("id"), F.col("conv_id").isNull().alias("no_id")]
    block = F.coalesce(F.floor(F.col("turn").cast("long") / BLOCK_TURNS), F.lit(-(2**62)))
    columns = [F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), block.alias("block")]
    rows = turns.select(*conversation, *columns)
    local = Window.partitionBy(*CONVERSATION, "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("local", F.row_number().over(local))
    sums = turns.select(*conversation, block.alias("block")).groupBy(*CONVERSATION, "block").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*CONVERSATION)
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*CONVERSATION, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("n_turns"))
    return rows.join(sums, [*CONVERSATION, "block"]).withColumn("pos", F.col("local") + F.col("base")).drop("base", "local")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """``id, no_id, pos, n_turns, h1, h2``: the hashes of the turns up to each placed turn."""
    rows = placed.select(*CONVERSATION, "block", "pos", "n_turns", _turn_hash(1).alias("t1"), _turn_hash(2).alias("t2"))
    inside = Window.partitionBy(*CONVERSATION, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*CONVERSATION, "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    before = Window.partitionBy(*CONVERSATION).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(b) for x, b in (("x1", "b1"), ("x2", "b2"))]
    rows = rows.withColumns({"l1": F.bit_xor("t1").over(inside), "l2": F.bit_xor("t2").over(inside)})
    joined = rows.join(sums.select(*CONVERSATION, "block", *earlier), [*CONVERSATION, "block"])
    h1, h2 = F.col("l1").bitwiseXOR(F.col("b1")), F.col("l2").bitwiseXOR(F.col("b2"))
    return joined.select(*CONVERSATION, "pos", "n_turns", h1.alias("h1"), h2.alias("h2"))


def maximal(placed: DataFrame) -> DataFrame:
    """``id, no_id, n_turns, copies`` of the conversations that prefix no longer one."""
    hashed = stage(prefix_hashes(placed), "prefix-hashes")
    first = F.min(F.struct("no_id", "id")).alias("first")
    ends = hashed.filter("pos = n_turns").groupBy("n_turns", "h1", "h2").agg(first, F.count("*").alias("copies"))
    inner = hashed.filter("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return ends.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("first.id", "first.no_id", "n_turns", "copies")


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the chat template; a null role or text is empty."""
    empty = F.lit("")
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, empty), F.lit("\n"), F.coalesce(text, empty), F.lit("<|im_end|>\n"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, copies, text`` of the maximal conversations.

    A conversation of more than ``BLOCK_TURNS`` turns is rendered in several
    parts, numbered from 0, so that no row is unbounded. A null ``conv_id`` is a
    conversation like any other; null and empty roles and texts are turns too, and
    texts of any length stay whole; repeated rows are turns of their own; other
    columns are not read, whatever their names; an empty table gives no rows.
    """
    placed = stage(positions(turns), "turns")
    parts = F.sequence(F.lit(0), F.floor((F.col("n_turns") - 1) / BLOCK_TURNS).cast("int"))
    kept = maximal(placed).withColumn("part", F.explode(parts))
    part = F.floor((F.col("pos") - 1) / BLOCK_TURNS).cast("int")
    turn = F.struct("pos", render_turn(F.col("role"), F.col("text")).alias("text"))
    rows = placed.select(*CONVERSATION, part.alias("part"), turn.alias("turn"))
    keys = [*CONVERSATION, "part", "n_turns", "copies"]
    grouped = rows.join(kept, [*CONVERSATION, "part"]).groupBy(*keys).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    conv_id = F.when(~F.col("no_id"), F.col("id"))
    text = F.array_join(F.transform("turns", lambda t: t["text"]), "")
    return grouped.select(conv_id.alias("conv_id"), "part", "n_turns", "copies", text.alias("text"))
