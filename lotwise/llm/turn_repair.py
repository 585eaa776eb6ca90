"""Repair of the structure of conversations by a fold over their turns in Spark SQL.

Windows flag the faults of each turn, the turns of a conversation are collected in order as structs, and aggregate()
carries four (cost, audit) structs, one for each state that the roles so far can be in: nothing yet, a system turn,
a user's turn, an assistant's turn. A turn is kept, given the role that fits, or deleted; turns may be inserted between
any two. least() takes the cheaper struct, and of equally cheap ones that with the least audit.

Long conversations are folded in segments of SEGMENT turns from each of the four states, and the segments are
put together by a second aggregate(), so that no audit is copied once for each turn of a long conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm.common import SPACES, column, table

SEGMENT = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States, by the role initial that came last; a conversation may end in "e" (no turns) or "a".
STATES = "esua"
LEGAL = ("su", "ua", "au")
_COST = "struct<cost:bigint,audit:string>"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, alive): the rows damaged by crc32(conv:turn) % 20, where a null counts as a space: 0
    drops a row (it stays, not alive), 1 empties its text, 2 takes full stops, exclamation and question marks out of it,
    3 doubles it, 4 makes it the user's."""
    blank = F.lit(" ")
    part = lambda c: F.coalesce(column(c).cast("string"), blank)
    fate = F.crc32(F.concat(part(conv), F.lit(":"), part(turn))) % 20
    out = rows.select(column(conv).alias("conv"), column(turn).cast("bigint").alias("turn"), part(role).alias("role"), part(text).alias("text"), fate.alias("fate"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("fate") != 0))
    new_text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return out.select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), F.explode(copies).alias("alive"))


def flagged(rows: DataFrame) -> DataFrame:
    """Rows of (conv, turn, role, text, alive) with n (place in the conversation, by turn, nulls first, then role and
    text; rows that are not alive come last), initial, fault (blank, duplicate, truncated or null), illegal and fresh
    (a turn number not seen before). One shuffle, by conversation, serves all windows."""
    order = Window.partitionBy("conv").orderBy(F.col("alive").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv", "alive", "role", "text").orderBy("n")
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "last": F.substring(ended, -1, 1)})
    rows = rows.withColumns({"n": F.row_number().over(order), "before": F.lag("initial").over(order), "turn_before": F.lag("turn").over(order)})
    again = F.row_number().over(same) > 1
    fault = F.when(F.col("last") == "", "blank").when(again, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin(*LEGAL)
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    return rows.select("conv", "turn", "role", "text", "alive", "n", "initial", fault.alias("fault"), illegal.alias("illegal"), fresh.alias("fresh"))


def _plus(x: Column, cost: Column | int, letter: str) -> Column:
    """The struct after one more edit; null stays null."""
    return F.when(x.isNotNull(), F.struct((x["cost"] + cost).cast("bigint").alias("cost"), F.concat(x["audit"], F.lit(letter)).alias("audit")))


def _states(by: dict[str, Column]) -> Column:
    return F.struct(*(by[s].alias(s) for s in STATES))


def _inserted(by: dict[str, Column]) -> Column:
    """States after inserts that pay: one user's turn, one assistant's. A third would lead back to where it began."""
    user = F.least(by["u"], *(_plus(by[s], INSERT, "I") for s in "esa"))
    return _states(by | {"u": user, "a": F.least(by["a"], _plus(user, INSERT, "I"))})


def _step(state: Column, turn: Column) -> Column:
    """States after a turn (initial, must: it has to go, extra: what leaving it costs)."""
    initial, stays = turn["initial"], ~turn["must"]
    gone = {s: _plus(state[s], DELETE, "D") for s in STATES}
    left = lambda x, fits: F.when(stays & fits, _plus(x, turn["extra"] + KEEP, "K")).when(stays, _plus(x, turn["extra"] + REROLE, "R"))
    system = F.when(stays & (initial == "s"), _plus(state["e"], turn["extra"] + KEEP, "K"))
    to_user = F.least(state["e"], state["s"], state["a"])
    by = {"e": gone["e"], "s": F.least(gone["s"], system), "u": F.least(gone["u"], left(to_user, initial == "u")), "a": F.least(gone["a"], left(state["u"], initial == "a"))}
    return _inserted(by)


def _start(at: str) -> dict[str, Column]:
    none = F.lit(None).cast(_COST)
    zero = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"))
    return {s: zero.cast(_COST) if s == at else none for s in STATES}


def _fold(turns: Column, first: Column) -> Column:
    """For each state that a segment can begin in (the first: only in "e") the states that it ends in."""
    begun = F.when(first, F.array(_inserted(_start("e")))).otherwise(F.array(*(_states(_start(s)) for s in STATES)))
    return F.transform(begun, lambda z: F.aggregate(turns, z, _step))


def _joined(segments: Column) -> Column:
    """The states at the end of all segments: cost, audit, and cuts, the audit's length at the end of each segment."""
    kind = "struct<cost:bigint,audit:string,cuts:array<bigint>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"), F.array().cast("array<bigint>").alias("cuts")).cast(kind)
    begun = _states({s: zero if s == "e" else F.lit(None).cast(kind) for s in STATES})

    def then(state: Column, segment: Column) -> Column:
        def via(k: int, to: str) -> Column:
            a, b = state[STATES[k]], F.get(segment["ends"], k)[to]
            audit = F.concat(a["audit"], b["audit"])
            made = F.struct((a["cost"] + b["cost"]).alias("cost"), audit.alias("audit"), F.concat(a["cuts"], F.array(F.length(audit).cast("bigint"))).alias("cuts"))
            return F.when(a.isNotNull() & b.isNotNull(), made)

        return _states({to: F.least(*(via(k, to) for k in range(len(STATES)))) for to in STATES})

    return F.aggregate(segments, begun, then, lambda s: F.least(s["e"], s["a"]))


def _lines(best: Column, segments: Column) -> Column:
    """role:text of the repaired turns. Roles that edits give follow from the place: turns alternate, and their number is
    odd where a system turn is first."""
    left = lambda audit: F.length(F.translate(audit, "D", ""))
    odd = left(best["audit"]) % 2

    def of_segment(segment: Column, i: Column) -> Column:
        start = F.when(i > 0, F.get(best["cuts"], i - 1)).otherwise(0).cast("int")
        own = F.substring(best["audit"], start + 1, F.get(best["cuts"], i).cast("int") - start)
        before = left(F.substring(best["audit"], F.lit(1), start))

        def line(j: Column) -> Column:
            letter, seen = F.substring(own, j, F.lit(1)), F.substring(own, F.lit(1), j)
            turn = F.get(segment["turns"], F.length(F.translate(seen, "I", "")) - 1)
            role = F.when((before + left(seen) + odd) % 2 == 1, "user:").otherwise("assistant:")
            return F.when(letter == "K", F.concat(turn["role"], F.lit(":"), turn["text"])).when(letter == "R", F.concat(role, turn["text"])).when(letter == "I", role)

        return F.when(F.length(own) > 0, F.transform(F.sequence(F.lit(1), F.length(own)), line)).otherwise(F.array().cast("array<string>"))

    return F.array_join(F.flatten(F.transform(segments, of_segment)), "\n")


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) for every conversation of ``rows`` of
    (conv, turn, role, text, alive); repaired has the turns as role:text lines.

    Rows that are not alive only name their conversation. A conversation without others has zeros, an empty audit and no
    lines. Null conversation ids are one conversation; null turns come first and count in no gap; ties of turn go by
    role and text. Null roles and texts are to be filled before. No rows: no rows. Other columns are not read. A
    conversation's text is one value in the end, so its rows meet in one task, sorted with spilling.
    """
    turn = F.struct("n", "initial", (F.col("fault").isNotNull() & (F.col("fault") != "truncated")).alias("must"), F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).alias("extra"), "role", "text")
    count = lambda what: F.sum(F.when(F.col("alive") & what, 1).otherwise(0).cast("bigint"))
    counts: dict[str, Callable[[], Column]] = {k: count(F.coalesce(F.col("fault") == k, F.lit(False))) for k in ("blank", "duplicate", "truncated")}
    counts |= {"illegal": count(F.col("illegal")), "distinct": count(F.col("fresh"))}
    low, high = (f(F.when(F.col("alive"), F.col("turn"))) for f in (F.min, F.max))
    part = F.floor((F.col("n") - 1) / segment).cast("bigint").alias("part")
    segments = flagged(rows).groupBy("conv", part).agg(F.array_sort(F.collect_list(F.when(F.col("alive"), turn))).alias("turns"), low.alias("low"), high.alias("high"), *(c.alias(k) for k, c in counts.items()))
    segments = segments.withColumn("ends", _fold(F.col("turns"), F.col("part") == 0))
    sums = [F.sum(k).alias(k) for k in counts]
    whole = segments.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "turns", "ends"))).alias("segments"), F.min("low").alias("low"), F.max("high").alias("high"), *sums)
    whole = whole.withColumn("best", _joined(F.col("segments")))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("bigint")
    return whole.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), _lines(F.col("best"), F.col("segments")).alias("repaired"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(damage(table(spark, sf_dir, "conversations")))
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
