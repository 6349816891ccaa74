"""Records from JSON, JSON lines, CSV, TSV (gzipped or not) and folders of them, with aliases for their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Column names by which records state their id, source and reference text, first non-blank one first.
ALIASES = {
    "record_id": ["record_id", "case_id", "encounter_id", "dialogue_id", "id", "file"],
    "source_text": ["source_text", "dialogue", "conversation", "transcript", "src", "input", "text"],
    "reference_text": ["reference_text", "reference_note", "note", "clinical_note", "target", "tgt", "summary"],
}
WRAPPERS = ["records", "rows", "data", "examples"]


def read_records(spark: SparkSession, path: str, kind: str | None = None, files: str | None = None) -> DataFrame:
    """Rows of a file or folder; kind is json, jsonl, csv or tsv, or told by the name. A JSON object that wraps an array gives its elements.

    Folders are read with all folders below; `files` is a pattern for the names of their files. Rows whose cells are all blank go.
    """
    name = path.lower().removesuffix(".gz")
    kind = kind or next((k for k in ("jsonl", "ndjson", "json", "csv", "tsv") if name.endswith(f".{k}")), "json")
    if kind in ("csv", "tsv"):
        rows = spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, recursiveFileLookup=True, pathGlobFilter=files)
        rows = rows.toDF(*(c.strip().lstrip("﻿") for c in rows.columns))
        return rows.filter(F.concat_ws("", *(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns)) != "")
    rows = spark.read.json(path, multiLine=kind == "json", recursiveFileLookup=True, pathGlobFilter=files)
    wrapped = next((w for w in WRAPPERS if w in rows.columns and rows.schema[w].dataType.typeName() == "array"), None)
    return rows.select(F.explode(wrapped).alias("r")).select("r.*") if wrapped else rows


def first_of(rows: DataFrame, names: list[str]) -> Column:
    """The first value that isn't blank among the columns that exist, their case ignored where no exact name does."""
    lower = {c.lower(): c for c in rows.columns}
    have = [n for n in names if n in rows.columns] or [lower[n.lower()] for n in names if n.lower() in lower]
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))
    return F.coalesce(*(blank(c) for c in have)) if have else F.lit(None).cast("string")


def as_records(rows: DataFrame) -> DataFrame:
    """(record_id, source_text, reference_text); rows without a source go."""
    return rows.select(*(first_of(rows, names).alias(k) for k, names in ALIASES.items())).filter("source_text is not null")


def as_cases(rows: DataFrame, text: str, case_id: str = "case_id") -> DataFrame:
    """Rows whose text isn't blank, with a case_id: their own, or CASE_ and the row's number in five digits by the order of their text."""
    own = F.col(case_id).cast("string") if case_id in rows.columns else F.lit(None).cast("string")
    rows = rows.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("case_id", F.when(F.trim(own) != "", own))
    named, bare = rows.filter("case_id is not null"), rows.filter("case_id is null")
    number = F.row_number().over(Window.orderBy(text)).cast("string")
    return named.unionByName(bare.withColumn("case_id", F.concat(F.lit("CASE_"), F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit("0")))))


def synthetic(spark: SparkSession, n: int, pools: dict[str, list[str]]) -> DataFrame:
    """case_id from 0, and for each pool a column of its entries in turn: cases whose answers are known by how they are made."""
    rows = spark.range(n).withColumnRenamed("id", "case_id")
    return rows.select("case_id", *(F.element_at(F.array(*(F.lit(x) for x in own)), (F.col("case_id") % len(own) + 1).cast("int")).alias(name) for name, own in pools.items()))


def union_batches(spark: SparkSession, folder: str, key: list[str], files: str = "batch_*.json") -> DataFrame:
    """The rows of all batch files of a folder; a key that occurs twice raises."""
    rows = read_records(spark, folder, "json", files)
    if not rows.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError(f"a {', '.join(key)} occurs in the batches twice")
    return rows


def every_value(spark: SparkSession, folder: str, name: str, files: str = "*.json") -> DataFrame:
    """(file, value): each string or number that stands under a name at any depth of a folder's JSON files, once a file."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=files).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    found = F.regexp_extract_all("value", F.lit(rf'"{name}"\s*:\s*("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*)'), F.lit(1))
    return rows.select("file", F.explode(found).alias("value")).select("file", F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")[0].alias("value")).distinct()


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, every cell in quotes."""
    rows.write.csv(path, header=True, quoteAll=True, escape='"')


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as Markdown, for a report; more than `most` rows raise."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["-"] * len(rows.columns), *([cell(v) for v in r] for r in got)]
    return f"# {title}\n\n" + "\n".join(f"| {' | '.join(x)} |" for x in lines) + "\n"


# The entities that markup always has.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def marked_up(rows: DataFrame, key: str, column: str, tag: str) -> DataFrame:
    """(key, ordinal, text): the content of each element of a name, inner tags dropped, entities decoded, white space as single spaces."""
    found = rows.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))).alias("p", "x"))
    text = F.regexp_replace("x", "<[^>]*>", "")
    for name, character in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    return found.select(key, (F.col("p") + 1).alias("ordinal"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def union_reports(reports: list[DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """All rows of some reports, and the keys that occur more than once."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out, out.groupBy(*key).count().filter("count > 1")
