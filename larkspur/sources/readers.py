"""Readers of the corpus's files. Missing and broken input follows one rule: a scan for
production drops or marks bad rows, a scan for training fails on them."""

from __future__ import annotations

from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import free
from ..functions.text import or_default, strip
from .sinks import persona_group

PERSONA = "persona_id STRING, id STRING, summary STRING, metadata STRING, attributes STRING, fingerprint STRING, selected_prompts STRING"
SCENARIOS = "ARRAY<STRUCT<scenario_id: STRING, context_note: STRING, category: STRING, initial_prompt: STRING>>"


def with_places(scan: DataFrame, name: str) -> DataFrame:
    """The rows of a file scan with their places from 0, files by path. Rows of a split are
    numbered where they are read, and the counts of the splits before it are added: no task
    sees all rows."""
    rows = scan.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    splits = rows.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(splits, ["_file", "_start"]).withColumn(name, F.col("_id") + F.col("_shift")).drop("_file", "_start", "_id", "_shift")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, value): lines of one text in order, blank ones counted and dropped."""
    lines = with_places(spark.read.text(path), "line_no")
    return lines.select((F.col("line_no") + 1).alias("line_no"), "value").where(strip(F.col("value")) != "")


def jsonl(spark: SparkSession, path: str, schema: str | StructType, limit: int | None = None) -> DataFrame:
    """Tolerant scan: lines that do not parse to an object are dropped; then the limit holds.
    Adds ``raw`` and ``line_no`` (ordered within a file)."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("raw"), F.monotonically_increasing_id().alias("line_no"))
    rows = rows.where(F.try_parse_json("raw").isNotNull() & F.col("raw").startswith("{"))
    rows = rows.orderBy("line_no").limit(limit) if limit else rows
    return rows.select(F.from_json("raw", schema).alias("r"), "raw", "line_no").select("r.*", "raw", "line_no")


def strict_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers; a line that is no object fails the job when it is read."""
    rows = numbered_lines(spark, path)
    good = F.try_parse_json("value").isNotNull() & strip(F.col("value")).startswith("{")
    return rows.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" is no JSON object")))))


def last_wins(rows: DataFrame, key: str, order: str = "line_no") -> DataFrame:
    """Of rows with equal keys the one that comes last."""
    [n] = free(rows, "_n")
    at = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn(n, F.row_number().over(at)).where(F.col(n) == 1).drop(n)


def personas(spark: SparkSession, path: str) -> DataFrame:
    """Personas of a JSONL file, one for each id (the last), rows without an id dropped."""
    rows = jsonl(spark, path, PERSONA).withColumn("persona_id", or_default(F.col("persona_id"), F.col("id")))
    meta = lambda k: F.try_variant_get(F.try_parse_json("metadata"), f"$.{k}", "string")
    rows = rows.where(F.coalesce("persona_id", F.lit("")) != "").drop("id")
    rows = rows.withColumn("refined_summary", F.nullif(meta("refined_summary"), F.lit(""))).withColumn("behavioral_metadata", meta("behavioral_metadata"))
    return last_wins(rows, "persona_id")


def yaml_personas(spark: SparkSession, path: str) -> DataFrame:
    """Personas of a folder of YAML files; the id defaults to the file's stem."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")

    def parse(batches):
        import json

        import yaml

        for batch in batches:
            out = []
            for name, text in zip(batch["name"], batch["value"]):
                data = yaml.safe_load(text) or {}
                out.append((str(data.get("persona_id") or data.get("id") or PurePosixPath(name).stem), data.get("summary"), json.dumps(data, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["persona_id", "summary", "raw"])

    return rows.mapInPandas(parse, "persona_id STRING, summary STRING, raw STRING").orderBy("persona_id")


def sessions(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """One session for each JSON file below a folder: path, raw, ok. A sample takes the first
    by path components; the listing is cut before any file is read."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    files = read.format("binaryFile").load(path).select("path")
    if sample:
        first = [r.path for r in files.orderBy(F.split("path", "/")).limit(sample).collect()]  # ``sample`` paths
        rows = spark.read.text(first, wholetext=True)
    else:
        rows = read.text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return rows.withColumn("ok", F.try_parse_json("raw").isNotNull())


def behaviors(spark: SparkSession, path: str) -> DataFrame:
    """The catalog: rows with a guidance template and an id, the last of each id."""
    schema = "behavior_id STRING, name STRING, description STRING, tuna_mode STRING, tuna_strategy STRING, cognitive_delegation_level STRING, guidance_template STRING, few_shot_examples ARRAY<STRUCT<request_type: STRING, user_turn: STRING>>, weight DOUBLE, simulator_control STRUCT<force_disclosure_stage: STRING, force_include_few_shot: BOOLEAN>"
    rows = jsonl(spark, path, schema).withColumn("behavior_id", strip(F.col("behavior_id")))
    filled = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    return last_wins(rows.where(filled("guidance_template") & filled("behavior_id")), "behavior_id")


def scenario_cache(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios of cached files `<persona>__<prefix>.json`: persona_id, prefix, pos, scenario."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("stem"), F.from_json("value", SCENARIOS).alias("s"))
    rows = rows.select(F.split_part("stem", F.lit("__"), F.lit(1)).alias("persona_id"), F.coalesce(F.nullif(F.split_part("stem", F.lit("__"), F.lit(2)), F.lit("")), F.lit("lifelong")).alias("prefix"), F.posexplode("s").alias("pos", "scenario"))
    return rows.select("persona_id", "prefix", "pos", "scenario.*")


def cached_or_legacy(tasks: DataFrame, cache: DataFrame, legacy: DataFrame, force: bool = False) -> DataFrame:
    """Tasks (persona_id, prefix) with their cached scenarios; those of the legacy place serve
    the prefix `lifelong` only, and ``force`` takes neither."""
    if force:
        return tasks.withColumn("scenarios", F.lit(None).cast("string"))
    old = legacy.select("persona_id", F.col("scenarios").alias("_legacy"))
    out = tasks.join(cache, ["persona_id", "prefix"], "left").join(old, "persona_id", "left")
    return out.withColumn("scenarios", F.coalesce("scenarios", F.when(F.col("prefix") == "lifelong", F.col("_legacy")))).drop("_legacy")


def training_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a .parquet, .jsonl or .json file; a bad JSON line fails the read."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "parquet":
        return spark.read.parquet(path)
    read = spark.read.option("mode", "FAILFAST")
    read = read.schema(schema) if schema else read
    if kind == "jsonl":
        return read.json(path)
    if kind == "json":
        return read.option("multiLine", True).json(path)
    raise ValueError(f"training rows come as parquet, jsonl or json: {path}")


def positional_csv(spark: SparkSession, path: str, sep: str = ";", line_breaks: bool = True) -> DataFrame:
    """A CSV without a header, all strings, with the index of each row. Quoted fields may hold
    line breaks; where none does, ``line_breaks=False`` lets large files be split."""
    return with_places(spark.read.csv(path, sep=sep, header=False, quote='"', escape='"', multiLine=line_breaks), "idx")


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON arrays, as VARIANT, with the file they are from and their position in it."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "ARRAY<VARIANT>").alias("items"))
    return whole.select("file", F.posexplode("items").alias("idx", "item"))


def sessions_by_folder(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Sessions from folders ``ablation=.../persona_id=...``, with their file. A condition on
    ablation or persona prunes folders before any file is listed for reading."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = StructType([f for f in fields.fields if f.name not in ("ablation", "persona_id")]).add("ablation", "string").add("persona_id", "string")
    return spark.read.schema(fields).option("basePath", path).json(path).withColumn("file", F.col("_metadata.file_path"))


def by_group(spark: SparkSession, path: str, schema: str | StructType, by: str, form: str = "json", persona: str | None = None) -> DataFrame:
    """Rows of ``sinks.write_grouped``, with their file. A condition on ``by`` prunes folders, and
    so does a persona."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = StructType([f for f in fields.fields if f.name not in (by, "persona_group", "persona_id")]).add("persona_id", "string").add(by, "string").add("persona_group", "integer")
    rows = spark.read.schema(fields).option("basePath", path).format(form).load(path).withColumn("file", F.col("_metadata.file_path"))
    if persona is not None:
        rows = rows.where((F.col("persona_group") == persona_group(F.lit(persona))) & (F.col("persona_id") == persona))
    return rows.drop("persona_group")


def yaml_file(path: str) -> dict:
    """A driver-side configuration file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def existing_folder(*places: str) -> str:
    """The first folder that exists; an error that names all of them otherwise."""
    import os

    for p in places:
        if p and os.path.isdir(p):
            return p
    raise FileNotFoundError(f"no data folder at any of {', '.join(p for p in places if p)}")
