"""Administrative regions, user locations and public text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.operators.grid import nearest_cell
from tremorlake.operators.scan import running_totals


def region_tree(provinces: DataFrame, regencies: DataFrame, districts: DataFrame) -> DataFrame:
    """Three levels stacked into one parent table; rows without a parent are dropped.

    ``provinces(code, name)``, ``regencies(code, parent_code, name)``,
    ``districts(code, parent_code, name)``. Ids are ``level:code``, so no counter is needed.
    """
    def shaped(df, level, parent_level):
        parent = F.lit(None).cast("string") if parent_level is None else F.concat_ws(":", F.lit(parent_level), "parent_code")
        return df.select(F.concat_ws(":", F.lit(level), "code").alias("id"), F.col("code").cast("string").alias("code"),
                         F.initcap("name").alias("name"), F.lit(level).alias("level"), parent.alias("parent_id"))

    top = shaped(provinces, "province", None)
    mid = shaped(regencies.join(provinces.select(F.col("code").alias("parent_code")), "parent_code", "left_semi"),
                 "regency", "province")
    kept = mid.select(F.col("code").alias("parent_code"))
    low = shaped(districts.withColumn("parent_code", F.col("parent_code").cast("string")).join(kept, "parent_code", "left_semi"),
                 "district", "regency")
    return top.unionByName(mid).unionByName(low)


def region_paths(tree: DataFrame) -> DataFrame:
    """District rows with regency and province names (two joins: the tree has three levels)."""
    def level(name):
        return tree.where(F.col("level") == name)

    up = level("regency").select(F.col("id").alias("parent_id"), F.col("name").alias("regency"), F.col("parent_id").alias("top"))
    top = level("province").select(F.col("id").alias("top"), F.col("name").alias("province"))
    return level("district").join(up, "parent_id").join(top, "top").select(
        "id", F.col("name").alias("district"), "regency", "province",
        F.concat_ws(" > ", "province", "regency", "name").alias("path"))


def region_pages(tree: DataFrame, page_size: int = 10) -> DataFrame:
    """Children of every parent in name order with their page number."""
    keyed = tree.withColumns({"_one": F.lit(1).cast("bigint"), "_parent": F.coalesce("parent_id", F.lit(""))})  # roots are children of nothing
    placed = running_totals(keyed, ["_parent"], ["name", "id"], {"_before": "_one"})
    return placed.withColumn("page", F.floor(F.col("_before") / page_size).cast("int")).drop("_one", "_before", "_parent")


def locate_users(users: DataFrame, regencies: DataFrame, provinces: DataFrame) -> DataFrame:
    """Attach the region path and the nearest cell to positioned users."""
    up = regencies.select(F.col("id").alias("region_id"), F.col("name").alias("regency"), "parent_id")
    top = provinces.select(F.col("id").alias("parent_id"), F.col("name").alias("province"))
    placed = nearest_cell(users, [c for c in users.columns if c not in ("lat", "lon")])
    return placed.join(up, "region_id").join(top, "parent_id").withColumns(
        {"lat_rounded": F.round("lat", 1), "lon_rounded": F.round("lon", 1)})


def upsert_latest(current: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key over both tables (later version wins, update wins ties)."""
    both = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    best = F.max(F.struct(F.col(version).alias("_v"), F.col("_new"), F.struct(*rest).alias("_row"))).alias("_best")
    return both.groupBy(*keys).agg(best).select(*keys, "_best._row.*")


# --- public text ------------------------------------------------------------------

def _found(text: Column, words, present: bool) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    test = lambda w: F.contains(low, w) if present else ~F.contains(low, w)
    return F.filter(F.array(*[F.lit(w) for w in words]), test)


def with_note(text: Column) -> Column:
    """Text with the standing note, unless its hints are already there."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    base = F.when(trimmed == "", K.EMPTY_TEXT).otherwise(trimmed)
    return F.when(F.size(_found(base, K.REQUIRED_HINTS, False)) == 0, base).otherwise(F.concat(base, F.lit(K.TEXT_NOTE)))


def guard_text(df: DataFrame, column: str = "text", forbidden=K.FORBIDDEN_PHRASES, hints=K.REQUIRED_HINTS) -> DataFrame:
    """Forbidden phrases found, hints missing, ok flag and the text to publish."""
    text = F.col(column)
    blocked = _found(text, forbidden, True)
    return df.withColumns({
        "blocked_phrases": blocked, "missing_hints": _found(text, hints, False), "ok": F.size(blocked) == 0,
    }).withColumn("safe_text", F.when(F.col("ok"), with_note(text)).otherwise(with_note(F.lit(K.BLOCKED_TEXT))))
