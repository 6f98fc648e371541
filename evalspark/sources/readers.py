"""Readers for the file shapes the data arrives in. Malformed input becomes rows, not failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..session import spread

BAD = "_malformed"


def as_schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_jsonl(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines with their file). Compressed files are opened by their suffix."""
    s = as_schema(schema)
    lines = spark.read.text(path).filter(strip("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("_v", F.from_json("value", s.add(BAD, T.StringType()), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    broken = F.col("_v").isNull() | F.col(f"_v.{BAD}").isNotNull()
    good = parsed.filter(~broken).select(*[F.col(f"_v.{f.name}").alias(f.name) for f in s.fields if f.name != BAD])
    return good, parsed.filter(broken).select("file", "value")


def read_jsonl_gz(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines with their file). gzip files cannot be split, so few of them are spread over the
    cluster after the read."""
    good, bad = read_jsonl(spark, path, schema)
    return spread(good), bad


def read_json_arrays(spark: SparkSession, path: str, element) -> DataFrame:
    """Files that are one JSON array of elements, or an object with the array under ``simulations``."""
    e = as_schema(element)
    names = [f.name for f in e.fields]
    whole = T.StructType([*e.fields, T.StructField("simulations", T.ArrayType(e))])
    rows = spark.read.schema(whole).option("multiLine", True).json(path)
    own = F.array(F.struct(*names))
    return rows.select(F.explode(F.coalesce("simulations", own)).alias("e")).select("e.*")


def read_pipe_table(spark: SparkSession, path: str, columns: Sequence[str], id_type: str = "long") -> DataFrame:
    """Pipe-separated lines, ``;`` comments, trimmed fields; rows whose first field is no number are skipped."""
    lines = spark.read.text(path).select(strip("value").alias("v")).filter((F.col("v") != "") & ~F.startswith("v", F.lit(";")))
    parts = lines.select(F.transform(F.split("v", r"\|"), lambda p: strip(p)).alias("p")).filter(F.size("p") >= 2)
    out = parts.select(*[F.try_element_at("p", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])
    return out.withColumn(columns[0], F.col(columns[0]).try_cast(id_type)).filter(F.col(columns[0]).isNotNull())


def read_csv_manifest(spark: SparkSession, paths: dict[str, str], schema) -> DataFrame:
    """Headered CSV files by split name, with the split as a column. Quoted fields may hold line breaks."""
    s, out = as_schema(schema), None
    for split, path in paths.items():
        part = spark.read.schema(s).option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# File suffixes taken and folder names left out by a harvest.
HARVEST_SUFFIXES = ("md", "py", "sh", "yaml", "yml", "toml")
HARVEST_SKIP = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".deps",
    "site-packages", "lib/python", "dist-info", "package-lock.json",
)


LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def harvest_files(spark: SparkSession, root: str, suffixes: Sequence[str] = HARVEST_SUFFIXES, skip: Sequence[str] = HARVEST_SKIP,
                  least: int = 200, most: int = 50_000) -> DataFrame:
    """path, length and text of the files below a root with a wanted suffix and size outside skipped folders.

    Size and path are tested before the content column is opened. Folders are listed by a few tasks for each core: Spark's
    default is a task for each folder, up to 10,000, which costs more than listing a small one.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}")
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        files = reader.load(root)
    finally:
        spark.conf.set(LISTING_TASKS, before)
    parts = F.split("path", "/")
    unwanted = F.arrays_overlap(parts, F.array(*[F.lit(s) for s in skip]))
    kept = files.filter(F.col("length").between(least, most) & ~unwanted)
    text = F.regexp_replace(F.decode(F.try_validate_utf8("content").cast("binary"), "UTF-8"), "�", "")
    loose = F.regexp_replace(F.make_valid_utf8("content"), "�", "")
    return kept.select("path", "length", F.coalesce(text, loose).alias("text"))


def union_knowledge(papers: DataFrame, findings: DataFrame, digests: DataFrame) -> DataFrame:
    """Three tables as one document table with typed id prefixes."""
    none = F.lit("")
    paper = F.concat(F.lit("# "), "title", F.lit("\n\n"), F.coalesce("abstract", none), F.lit("\n\n"), F.coalesce("summary", none))
    source = F.nullif("source", none)
    finding = F.concat(
        F.lit("["), F.coalesce(F.nullif("topic", none), F.lit("general")), F.lit("] "), "content",
        F.coalesce(F.concat(F.lit("\n(Source: "), source, F.lit(")")), none))
    key = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("doc_id")
    return (
        papers.select(key("paper"), strip(paper).alias("text"))
        .unionByName(findings.select(key("finding"), finding.alias("text")))
        .unionByName(digests.select(key("digest"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "content").alias("text"))))


def parse_metric_exposition(lines: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Exposition text lines -> (name, total); comments and lines without a number drop out."""
    line = F.col(value)
    kept = lines.filter((line != "") & ~F.startswith(line, F.lit("#")))
    name, number = F.split(line, r"\{")[0], F.element_at(F.split(line, " "), -1).try_cast("double")
    bare = F.when(F.contains(line, F.lit("{")), name).otherwise(F.split(line, " ")[0])
    return kept.select(*by, bare.alias("name"), number.alias("v")).filter(F.col("v").isNotNull()).groupBy(*by, "name").agg(F.sum("v").alias("total"))


def read_telemetry(spark: SparkSession, path: str, schema, streaming: bool = False) -> DataFrame:
    """Fixed-header telemetry CSV; blanks are missing. The same schema reads batches and streams."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(as_schema(schema)).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_grader_tasks(suites: DataFrame) -> DataFrame:
    """One row per test; graders and system prompt of the file apply where the test has none.

    suites: suite, system_prompt, graders, tests array<struct<id, prompt, system_prompt, graders>>.
    """
    rows = suites.select("suite", F.col("system_prompt").alias("_sp"), F.col("graders").alias("_g"), F.posexplode("tests").alias("pos", "t"))
    return rows.select(
        "suite", "pos", F.col("t.id").alias("id"), F.col("t.prompt").alias("prompt"),
        F.coalesce("t.system_prompt", "_sp").alias("system_prompt"), F.coalesce("t.graders", "_g").alias("graders"))
