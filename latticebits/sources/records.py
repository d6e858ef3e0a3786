"""Nested JSON event records: scan, schema, endpoints, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticebits.functions.columns import json_identity

#: Bytes that a probe reads first.
HEAD_BYTES = 1 << 16
PRE, POST = "$.pre_synaptic_site.neuron_id", "$.post_synaptic_partner.neuron_id"


def json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, record, file) of JSON lines; blank lines are skipped, a line that isn't a JSON object is an error that names its file (bad_lines() gives the numbers of such lines)."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    bad = F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(": "), F.substring("value", 1, 60))
    record = F.when(F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), parsed).otherwise(F.raise_error(bad).cast("variant"))
    return text.select("value", record.alias("record"), "file")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1 and blank ones counted too.

    Every split counts its own lines; the lines of the splits before it in its file come from one row a split."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = text.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("file", "block", "first", before.alias("before"))
    return text.join(placed, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value) of lines that json_lines() would stop at."""
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return numbered_lines(spark, path).where((F.trim("value") != "") & ~good)


def endpoints_of(lines: DataFrame, pre: str = PRE, post: str = POST) -> DataFrame:
    """(pre, post) as DECIMAL(20,0) of JSON lines in `value`, null where a record has no id there."""
    v = F.parse_json("value")
    return lines.select(json_identity(v, pre).alias("pre"), json_identity(v, post).alias("post"))


def selected_counts(ends: DataFrame, ids: DataFrame) -> DataFrame:
    """(pre, post, synapse_count) of records with both ends among the ids, loops included."""
    from latticebits.operators.graph import events_between, pair_counts

    return pair_counts(events_between(ends.dropna(), ids.toDF("id")))


def diagnostics(ends: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (records, missing, selected, loops, pairs): all in one aggregation."""
    a, b = ids.toDF("pre").distinct().withColumn("__a", F.lit(True)), ids.toDF("post").distinct().withColumn("__b", F.lit(True))
    rows = ends.join(a, "pre", "left").join(b, "post", "left")
    own = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return rows.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("pre").isNull() | F.col("post").isNull()).alias("missing"),
        F.count_if(own).alias("selected"),
        F.count_if(own & (F.col("pre") == F.col("post"))).alias("loops"),
        F.count_distinct(F.when(own, F.struct("pre", "post"))).alias("pairs"),
    )


def first_record(spark: SparkSession, path: str) -> tuple[dict, str]:
    """The first record of a JSON array, of JSON lines or of one object, and which it is.

    Only the head of the file is read, more of it while no whole record is there."""
    import json

    size, whole = HEAD_BYTES, False
    while True:
        text, whole = _head(path, size)
        text = text.lstrip("\ufeff \t\r\n")
        if not text and whole:
            raise ValueError("no record")
        if text and text[0] not in "[{":
            raise ValueError("the first record isn't an object")
        inside = text[1:].lstrip() if text.startswith("[") else text
        try:
            record, end = json.JSONDecoder().raw_decode(inside)
        except ValueError:
            if whole:
                raise ValueError("the first record isn't whole JSON") from None
            size *= 4
            continue
        if not isinstance(record, dict):
            raise ValueError("the first record isn't an object")
        if text.startswith("["):
            return record, "array"
        lines = inside[:end].count("\n") == 0 and (whole or "\n" in inside[end:])
        return record, "lines" if lines or inside[end:].lstrip().startswith("{") else "object"


def _head(path: str, size: int) -> tuple[str, bool]:
    """The first bytes of a file (of the first one of a folder), and whether that is all; .gz files are unpacked."""
    from pathlib import Path

    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else str(Path(path).absolute()))
    if system.get_file_info(at).type == fs.FileType.Directory:
        at = min(i.path for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
    with system.open_input_stream(at) as source:
        data = source.read(size + 1)
    return data[:size].decode("utf-8", "ignore" if len(data) > size else "strict"), len(data) <= size


def schema_tree(value: object) -> object:
    """Names and types of a JSON value, without its values; a list by its first element."""
    if isinstance(value, dict):
        return {k: schema_tree(v) for k, v in sorted(value.items())}
    if isinstance(value, list):
        return [schema_tree(value[0])] if value else []
    return {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string"}[type(value)]


def has_path(record: dict, path: str) -> bool:
    here: object = record
    for name in path.removeprefix("$.").split("."):
        if not isinstance(here, dict) or name not in here:
            return False
        here = here[name]
    return True


def probe(spark: SparkSession, path: str, required: tuple[str, ...] = (PRE, POST)) -> dict:
    record, kind = first_record(spark, path)
    missing = [p for p in required if not has_path(record, p)]
    if missing:
        raise ValueError(f"the first record lacks {', '.join(missing)}")
    return {"format": kind, "schema": schema_tree(record), "paths": list(required)}


def variant_schema(lines: DataFrame) -> str:
    """The merged schema of all records, in one distributed aggregation."""
    return lines.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0]
