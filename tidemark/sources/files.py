"""File and JSONL sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Objects of a JSONL file; blank lines and lines that start with # are skipped, malformed ones are
    kept in ``_corrupt`` with nulls elsewhere."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    parsed = lines.select("value", F.from_json("value", schema).alias("r"))
    return parsed.select("r.*", F.when(F.col("r").isNull(), F.col("value")).alias("_corrupt"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """(path, modified, size, text, sha256) of text files below ``root``; binaries (a NUL in the first 2048
    bytes) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    plain = F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 2048)), "(..)", "$1 ")) == 0
    return files.where(wanted & plain).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), text.alias("text"), F.sha2("content", 256).alias("sha256"))


def chunk_markdown(text: str, limit: int = 2048) -> list[tuple[str, str]]:
    """(heading, chunk) pairs: sections at headings, paragraphs packed up to ``limit`` characters, longer
    ones cut hard; a section of a heading alone is dropped."""
    sections: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        if line.startswith("#") and line.lstrip("#").startswith(" "):
            sections.append((line.lstrip("#").strip(), []))
        else:
            sections[-1][1].append(line)
    out: list[tuple[str, str]] = []
    for heading, lines in sections:
        held = ""
        for paragraph in "\n".join(lines).split("\n\n"):
            paragraph = paragraph.strip()
            if not paragraph:
                continue
            if held and len(held) + 2 + len(paragraph) > limit:
                out.append((heading, held))
                held = ""
            while len(paragraph) > limit:
                if held:
                    out.append((heading, held))
                    held = ""
                out.append((heading, paragraph[:limit]))
                paragraph = paragraph[limit:]
            held = f"{held}\n\n{paragraph}" if held else paragraph
        if held:
            out.append((heading, held))
    return out


def chunks(files: DataFrame, limit: int = 2048) -> DataFrame:
    """(path, chunk_index, heading, text, chunk_hash) of (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, h, t) for p, text in zip(batch.path, batch.text) for i, (h, t) in enumerate(chunk_markdown(text or "", limit))]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "heading", "text"])

    made = files.select("path", "text").mapInPandas(run, "path string, chunk_index int, heading string, text string")
    return made.withColumn("chunk_hash", F.sha2(F.col("text").cast("binary"), 256))


def freshness(points: DataFrame, files: DataFrame) -> DataFrame:
    """(id, freshness) of points (id, source_uri, content_hash) against files (path, sha256)."""
    joined = points.join(files.select(F.col("path").alias("source_uri"), "sha256"), "source_uri", "left")
    return joined.select("id", F.when(F.col("sha256").isNull(), "missing").when(F.col("content_hash").isNull(), "exists").when(F.col("content_hash") == F.col("sha256"), "current").otherwise("changed").alias("freshness"))
