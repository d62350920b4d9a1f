"""Seeded draws that do not depend on partitioning, subsets, stratified and positional splits, permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import HOT_ROWS


def uniform(seed: int, *ident: Column) -> Column:
    """A number in [0, 1) from the seed and the row's identity: the first 32 bits of an md5. The same on any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ident])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_sql(seed: int, *ident: str) -> str:
    """The same in DuckDB SQL."""
    text = " || ':' || ".join([f"'{seed}'", *(f"({c})::VARCHAR" for c in ident)])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


#: Rows of a group that are put in order together, about; tables of one row a group are broadcast up to so many groups.
PART_ROWS, FEW_GROUPS = 4096, 100_000


def _sizes(df: DataFrame, group: str) -> tuple[int, bool]:
    """Rows of the largest group, and whether groups are few."""
    most, groups = df.groupBy(group).count().agg(F.max("count"), F.count(F.lit(1))).first()
    return most or 0, groups <= FEW_GROUPS


def _by_group(groups: DataFrame, few: bool) -> DataFrame:
    """A table of one row a group, to be joined: of few groups it is broadcast, so that a group's rows stay where they are and need not meet in one task."""
    return F.broadcast(groups) if few else groups


def _parted(df: DataFrame, group: str, order: Column, few: bool) -> tuple[DataFrame, DataFrame]:
    """df with __n (rows of its group) and __part, and the rows before each part: (__g, __p, __before).

    A group's span of ``order``, a number, is cut into equal parts, one for each PART_ROWS rows; nulls come first."""
    v = order.cast("double")
    spans = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"), F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    parts = F.expr(f"1 + __n div {PART_ROWS}")
    share = (v - F.col("__lo")) / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo"))
    at = F.coalesce(F.least(F.floor(share * parts), parts - 1), F.lit(0)).cast("bigint")
    out = df.join(_by_group(spans, few), F.col(group).eqNullSafe(F.col("__g"))).withColumn("__part", at).drop("__g", "__lo", "__hi")
    counts = out.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count("*").alias("__c"), F.first("__n").alias("__all"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out, counts.select("__g", "__p", "__all", before.alias("__before"))


def _ranked_plainly(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df with __k and __n as below, by one shuffle: a group is put in order by one task."""
    w = Window.partitionBy(group)
    return df.withColumn("__k", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))


def ranked(df: DataFrame, group: str, order: tuple[str, ...], hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with __k, the place of a row in its group from 1, and __n, the rows of the group. The first column of the order is a number.

    If a group has more than hot_rows rows, all are ranked in parts; the result is the same if the order is total."""
    most, few = _sizes(df, group)
    if most <= hot_rows:
        return _ranked_plainly(df, group, [F.col(c) for c in order])
    out, parts = _parted(df, group, F.col(order[0]), few)
    inner = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    out = out.withColumn("__inner", inner).join(parts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return out.withColumn("__k", F.col("__before") + F.col("__inner")).drop("__inner", "__part", "__g", "__p", "__all", "__before")


def cut_at(df: DataFrame, group: str, order: list[Column], wanted: Column, few: bool = False) -> DataFrame:
    """(__g, __cut): the order of the last of the first ``wanted`` (of __all) rows of each group. Only the part that holds it is put in order."""
    keyed = df.select(F.col(group).alias("g"), *[c.alias(f"o{k}") for k, c in enumerate(order)])
    rows, parts = _parted(keyed, "g", F.col("o0"), few)
    edge = parts.withColumn("__want", wanted).where("__before < __want").groupBy("__g", "__want").agg(F.max(F.struct("__p", "__before")).alias("e"))
    edge = edge.select("__g", "__want", F.col("e.__p").alias("__p"), F.col("e.__before").alias("__before"))
    inside = rows.join(_by_group(edge, few), F.col("g").eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    names = [f"o{k}" for k in range(len(order))]
    inside = inside.withColumn("__k", F.col("__before") + F.row_number().over(Window.partitionBy("__g").orderBy(*names)))
    return inside.where("__k <= __want").groupBy("__g").agg(F.max(F.struct(*names)).alias("__cut"))


def up_to(order: list[Column]) -> Column:
    return F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]) <= F.col("__cut")


def subset(df: DataFrame, ratio: float, seed: int, group: str, ident: str, randomly: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """floor(ratio * n) rows of each group: hashed order, or by id (a distinct number)."""
    order = [uniform(seed, F.col(ident)), F.col(ident)] if randomly else [F.col(ident)]
    most, few = _sizes(df, group)
    if most <= hot_rows:
        return _ranked_plainly(df, group, order).where(F.col("__k") <= F.floor(F.lit(ratio) * F.col("__n"))).drop("__k", "__n")
    cut = cut_at(df, group, order, F.floor(F.lit(ratio) * F.col("__all")), few)
    return df.join(_by_group(cut, few), F.col(group).eqNullSafe(F.col("__g"))).where(up_to(order)).drop("__g", "__cut")


def stratified(df: DataFrame, ratio: float, group: str, ident: str, seed: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds is_train: the first ceil(ratio * n) rows of each class by id (a distinct number), or in a hashed order with a seed."""
    order = [F.col(ident)] if seed is None else [uniform(seed, F.col(ident)), F.col(ident)]
    most, few = _sizes(df, group)
    if most <= hot_rows:
        return _ranked_plainly(df, group, order).withColumn("is_train", (F.col("__k") <= F.ceil(F.lit(ratio) * F.col("__n"))).cast("int")).drop("__k", "__n")
    cut = cut_at(df, group, order, F.ceil(F.lit(ratio) * F.col("__all")), few)
    out = df.join(_by_group(cut, few), F.col(group).eqNullSafe(F.col("__g")), "left")
    return out.withColumn("is_train", F.coalesce(up_to(order), F.lit(False)).cast("int")).drop("__g", "__cut")


def multinomial(dist: DataFrame, row: str, item: str, p: str, seed: int) -> DataFrame:
    """One draw for each row from its distribution: the first item, by id, whose running probability passes a hashed uniform number."""
    w = Window.partitionBy(row).orderBy(item).rowsBetween(Window.unboundedPreceding, 0)
    run = dist.withColumn("__c", F.sum(p).over(w)).withColumn("__total", F.sum(p).over(Window.partitionBy(row)))
    hit = run.where(F.col("__c") > uniform(seed, F.col(row)) * F.col("__total"))
    return hit.groupBy(row).agg(F.min(item).alias(item))
