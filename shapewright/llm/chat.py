"""Chat formatting: cumulative-snapshot collapse.

A logger that stores a conversation after each exchange leaves many conversations that are prefixes of longer ones. A digest rolls
over a conversation's turns, so that its k-th value names the first k turns. A conversation whose
whole digest is a proper prefix digest of another is a snapshot and goes by an anti-join; of equal conversations the one of the
smallest id stays. What is kept is rendered with role markers.

The main path has DataFrame functions only. Texts are digested before the first shuffle, which moves 32 characters a turn in place
of texts; the digests joined are distinct on both sides, so a first turn that a third of all conversations share is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def turn_digest(role: Column, text: Column) -> Column:
    """md5 of a turn; null and empty roles or texts differ."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.md5(F.concat(part(role), part(text)).cast("binary"))


def lane(seed: int, digest: str = "d", k: str = "k") -> Column:
    return F.xxhash64(F.lit(seed), digest, k)


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each first 1, 2, ... turns of a conversation: conv_id, k, the digest (a, b) of these turns, and whether they are all.

    Turns are ordered by turn, then digest, nulls first. The digest rolls: each turn's digest is hashed with its place, twice, and
    added by exclusive or, so a conversation of any length is one pass of a window that spills. A turn without a conv_id is a
    conversation of its own, which needs no window.
    """
    each = turns.select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("d"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "d")
    placed = each.where("conv_id IS NOT NULL").withColumn("k", F.row_number().over(w)).withColumn("last", F.lead("d").over(w).isNull())
    rolled = w.rowsBetween(Window.unboundedPreceding, 0)
    long = placed.select("conv_id", "k", "last", F.bit_xor(lane(1)).over(rolled).alias("a"), F.bit_xor(lane(2)).over(rolled).alias("b"))
    alone = each.where("conv_id IS NULL").withColumn("k", F.lit(1)).select("conv_id", "k", F.lit(True).alias("last"), lane(1).alias("a"), lane(2).alias("b"))
    return long.unionAll(alone)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_copies (equal conversations), a and b of each conversation that is no proper prefix of another; one of equal ones."""
    rolled = prefixes(turns)
    whole = rolled.where("last").groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = rolled.where("NOT last").select("k", "a", "b").distinct()
    return whole.join(inner, ["k", "a", "b"], "left_anti").select("conv_id", "n_copies", "a", "b")


def escape(text: Column) -> Column:
    """Markers inside a text lose their bar, so that a rendered conversation parses in one way."""
    return F.replace(F.replace(text, F.lit(BEGIN), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))


def render_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered: a row for each maximal conversation.

    Turns follow each other by turn, then digest, nulls first; repeated turns stay. A null role is rendered as `user`, a null text
    as empty; they still count as different from `user` and empty in comparisons. A turn without a conv_id is a conversation of its
    own; equal ones are one row, under the smallest conv_id of a conversation equal to them, if there is one. Extra columns are not
    read. An empty table gives an empty one. A conversation is one string, so it must fit a row.
    """
    kept = maximal(turns)
    piece = F.concat(F.lit(BEGIN), escape(F.coalesce("role", F.lit("user"))), F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit(END + "\n"))
    rows = turns.select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("d"), piece.alias("piece"))
    own = rows.join(kept.where("conv_id IS NOT NULL").select("conv_id", "n_copies"), "conv_id")
    listed = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "piece"))).alias("ts"), F.first("n_copies").alias("n_copies"))
    long = listed.select("conv_id", F.size("ts").cast("long").alias("n_turns"), "n_copies", F.array_join(F.transform("ts", lambda x: x["piece"]), "").alias("rendered"))
    # equal turns are one row before any of them is moved
    alone = rows.where("conv_id IS NULL").groupBy("d").agg(F.first("piece").alias("rendered")).withColumn("k", F.lit(1)).withColumn("a", lane(1)).withColumn("b", lane(2))
    single = alone.join(kept.where("conv_id IS NULL").select("a", "b", "n_copies"), ["a", "b"])
    return long.unionByName(single.select(F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).cast("long").alias("n_turns"), "n_copies", "rendered"))


ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce('c' || conv_id, 'r' || row_number() OVER ()) AS g, turn, role, text,
         md5(coalesce('=' || octet_length(encode(role)) || ':' || role, '-') || coalesce('=' || octet_length(encode(text)) || ':' || text, '-')) AS d
  FROM conversations
), listed AS (
  SELECT any_value(conv_id) AS conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds,
         string_agg('{BEGIN}' || replace(replace(coalesce(role, 'user'), '{BEGIN}', '<im_start>'), '{END}', '<im_end>') || chr(10)
                    || replace(replace(coalesce(text, ''), '{BEGIN}', '<im_start>'), '{END}', '<im_end>') || '{END}' || chr(10), '' ORDER BY turn NULLS FIRST, d) AS rendered
  FROM turns GROUP BY g
), whole AS (
  SELECT ds, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(rendered) AS rendered FROM listed GROUP BY ds
), prefixes AS (SELECT DISTINCT ds[1:k] AS ds FROM (SELECT ds, unnest(range(1, len(ds))) AS k FROM whole))
SELECT conv_id, len(ds) AS n_turns, n_copies, rendered FROM whole ANTI JOIN prefixes USING (ds)
"""
