"""Identity bridges: exact joins on several keys, with every exclusion counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticebits.functions.columns import exact_integer

KEYS = ("session", "scan_idx", "field", "mask_id")
COHORT_FIELDS = ("asset_path", "plane", "roi_id", "mask_id", "session", "scan_idx", "field", "unit_id", "pt_root_id", "x", "y", "z", "source")


def map_rois_to_units(rois: DataFrame, units: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """rois with `unit_id`, null where no unit has the keys; an error if a key has two different units."""
    per_key = units.groupBy(*keys).agg(F.min("unit_id").alias("unit_id"), F.max("unit_id").alias("__last"))
    one = F.when(F.col("unit_id") == F.col("__last"), F.col("unit_id")).otherwise(F.raise_error(F.lit("a key has several units")))
    return rois.join(per_key.select(*keys, one.alias("unit_id")), list(keys), "left")


def conflicting_keys(units: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return units.groupBy(*keys).agg(F.count_distinct("unit_id").cast("bigint").alias("n_units")).where("n_units > 1")


def match_class(units: DataFrame, release: DataFrame, key: str = "unit_id", identity: tuple[str, ...] = ("pt_root_id", "x", "y", "z")) -> DataFrame:
    """units with `match`: unmatched, accepted or ambiguous, and the identity of accepted ones.

    Exact repeats of a release row are one; two different identities of a unit are ambiguous. Per unit only the least
    and greatest identity are kept, so a unit of very many rows costs no memory."""
    row = F.struct(*identity)
    per_unit = release.groupBy(key).agg(F.min(row).alias("__a"), F.max(row).alias("__b"))
    found = units.join(per_unit, key, "left")
    kind = F.when(F.col("__a").isNull(), "unmatched").when(F.col("__a") == F.col("__b"), "accepted").otherwise("ambiguous")
    return found.withColumn("match", kind).select("*", *[F.when(F.col("match") == "accepted", F.col(f"__a.{c}")).alias(c) for c in identity]).drop("__a", "__b")


def match_counts(matched: DataFrame, key: str = "unit_id") -> DataFrame:
    return matched.groupBy("match").agg(F.count("*").alias("rows"), F.count_distinct(key).alias("units"))


def one_to_one(rows: DataFrame, key: str = "pt_root_id") -> DataFrame:
    """Rows whose key occurs once: every row of a repeated key goes."""
    single = rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n = 1").select(key)
    return rows.join(single, key, "left_semi")


def repeated_keys(rows: DataFrame, key: str = "pt_root_id") -> DataFrame:
    """(duplicate_keys, duplicate_rows)."""
    many = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return many.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))


def id_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side) with side both, left or right, for ids of two one-column tables, each taken as a set."""
    a, b = left.toDF("id").distinct().withColumn("l", F.lit(True)), right.toDF("id").distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("l").isNotNull(), "left").otherwise("right")
    return a.join(b, "id", "full").select("id", side.alias("side"))


def overlap_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    return id_overlap(left, right).agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("both", "left", "right")])


def require_distinct_ids(df: DataFrame, column: str) -> DataFrame:
    """Positive ids of at most 64 bits, none twice, as DECIMAL(20,0); an error else."""
    value = F.col(column).cast("string")
    good = F.coalesce(value.rlike("^[1-9][0-9]{0,19}$") & (value.try_cast("decimal(20,0)") <= F.lit(str(2**64 - 1)).cast("decimal(20,0)")), F.lit(False))
    got = df.agg(F.count_if(~good).alias("bad"), (F.count("*") - F.count_distinct(column)).alias("repeats")).first()
    if got["bad"] or got["repeats"]:
        raise ValueError(f"{column}: {got['bad']} values aren't positive 64-bit ids, {got['repeats']} repeat")
    return df.withColumn(column, value.cast("decimal(20,0)"))


def cohort(rows: DataFrame, fields: tuple[str, ...] = COHORT_FIELDS) -> DataFrame:
    """The stated fields, sorted by field, mask, unit and root."""
    return rows.select(*fields).orderBy("field", "mask_id", "unit_id", "pt_root_id")


def release_rows(df: DataFrame, session: int, scan_idx: int) -> DataFrame:
    """Release rows of one scan with exact positive ids; a row of that scan that isn't marked valid is an error."""
    here = df.where((F.col("session").try_cast("int") == session) & (F.col("scan_idx").try_cast("int") == scan_idx))
    valid = F.coalesce(F.lower(F.trim(F.col("valid").cast("string"))).isin("t", "true", "1"), F.lit(False))
    root = F.when(valid, exact_integer(F.col("pt_root_id"), 1, "pt_root_id")).otherwise(F.raise_error(F.lit("a release row isn't valid")).cast("bigint"))
    places = [F.col(f"pt_position_{a}").cast("double").alias(a) for a in "xyz"]
    return here.select(exact_integer(F.col("unit_id"), 0, "unit_id").alias("unit_id"), root.alias("pt_root_id"), *places)


def bridge(rois: DataFrame, units: DataFrame, release: DataFrame, source: str) -> tuple[DataFrame, dict]:
    """ROI rows to their one structural cell: units, release match, one to one. The cohort and what was excluded."""
    mapped = map_rois_to_units(rois, units)
    matched = match_class(mapped.where("unit_id IS NOT NULL"), release)
    accepted = matched.where("match = 'accepted'").withColumn("source", F.lit(source))
    single = one_to_one(accepted)
    counts = {r["match"]: (r["rows"], r["units"]) for r in match_counts(matched).collect()}
    twice = repeated_keys(accepted).first()
    report = {"rois": rois.count(), "unmapped_rois": mapped.where("unit_id IS NULL").count(), "unmatched": counts.get("unmatched", (0, 0)), "ambiguous": counts.get("ambiguous", (0, 0)), "duplicate_roots": twice["duplicate_keys"], "duplicate_rows": twice["duplicate_rows"], "cohort": single.count()}
    return cohort(single), report
