"""Agreement with another parser's documents: values compared attribute by attribute, each pair by its own rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.functions import columns as C


@dataclass(frozen=True)
class Pair:
    """Our ``attribute`` against ``theirs``, compared by ``how``: exact, ip, int, lower, epoch_ms or suffix (ours ends with theirs)."""

    attribute: str
    theirs: str
    how: str = "exact"


def normalised(value: Column, how: str) -> Column:
    """What is compared; null where the value isn't of the rule's kind."""
    text = value.cast("string")
    if how == "ip":
        return C.ipv4_number(F.trim(text)).cast("string")
    if how == "int":
        return C.to_int(F.trim(text)).cast("string")
    if how == "lower":
        return F.lower(text)
    if how == "epoch_ms":
        return C.epoch_auto(C.to_int(F.trim(text))).cast("string")
    return text


def verdict(ours: Column, theirs: Column, how: str) -> Column:
    """agree, differ, ours_only, theirs_only, neither; a value that isn't of the rule's kind agrees with none."""
    a, b = normalised(ours, how), normalised(theirs, how)
    same = (F.endswith(a, b) if how == "suffix" else a == b) & (F.length(b) > 0)
    return (
        F.when(ours.isNull() & theirs.isNull(), "neither").when(theirs.isNull(), "ours_only").when(ours.isNull(), "theirs_only")
        .when(F.coalesce(same, F.lit(False)), "agree").otherwise("differ")
    )


def paired(ours: DataFrame, theirs: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Events and the other parser's documents of the same line text, as structs ``ours`` and ``theirs``; and the lines without a partner.

    A line that stands for several events on a side is one of them, the first by its columns.
    """

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(line).agg(F.min(F.struct(*(c for c in df.columns if c != line))).alias(name))

    both = one(ours, "ours").join(one(theirs, "theirs"), line, "full_outer")
    alone = F.when(F.col("theirs").isNull(), "ours").when(F.col("ours").isNull(), "theirs")
    return both.where(alone.isNull()), both.where(alone.isNotNull()).select(line, alone.alias("side"))


def tally(pairs: DataFrame, crosswalk: list[Pair]) -> DataFrame:
    """(attribute, theirs, verdict, n): every event against every row of the crosswalk, which is part of the plan."""
    each = F.array(*(F.struct(F.lit(p.attribute).alias("attribute"), F.lit(p.theirs).alias("theirs"), verdict(F.col(f"ours.{p.attribute}"), F.col(f"theirs.{p.theirs}"), p.how).alias("verdict")) for p in crosswalk))
    return pairs.select(F.explode(each).alias("c")).groupBy("c.attribute", "c.theirs", "c.verdict").agg(F.count("*").alias("n"))
