"""Sources: files by content hash, archives, artifacts, JSON lines, evaluation sets, chat memory."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T

CONTEXT_CHARS = 30_000


def select_rows(df: DataFrame, columns: dict[str, str] | None = None, scope: dict[str, object] | None = None) -> DataFrame:
    """A scan with column names of one's own and equality predicates; a predicate whose value is None is not there."""
    for name, value in (scope or {}).items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df.select(*[F.col(a).alias(b) for a, b in columns.items()]) if columns else df


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, file_sha256, file_size of the non-empty PDF files below path; content is hashed, not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fit = files.filter((F.col("length") > 0) & F.lower("path").endswith(".pdf"))
    return fit.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("file_sha256"), F.col("length").alias("file_size"))


def safe_name(name: str) -> bool:
    """Whether an archive's entry stays below the folder it is unpacked to."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    return not (clean.startswith(("/", "../")) or clean == ".." or ":" in clean.split("/")[0])


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """archive, entry, content of every safe entry of the archives below path; an unsafe entry is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for archive, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not safe_name(info.filename):
                            raise ValueError(f"{archive}: entry outside the archive: {info.filename}")
                        if not info.is_dir():
                            yield pd.DataFrame([(archive, info.filename, z.read(info))], columns=["archive", "entry", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, entry string, content binary")


def choose_markdown(entries: DataFrame, doc: str, path: str, stem: str) -> DataFrame:
    """One Markdown file of each document: that of its own name first, then in order of path."""
    own = F.element_at(F.split(path, "/"), -1) == F.concat(F.col(stem), F.lit(".md"))
    order = W.partitionBy(doc).orderBy(own.desc(), path)
    return entries.filter(F.lower(path).endswith(".md")).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, text, page_index from parsers' JSON artifacts ([{text, page_idx}])."""
    rows = spark.read.schema("text string, page_idx int").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("seq"), F.coalesce("text", F.lit("")).alias("text"), F.col("page_idx").alias("page_index"))
    return rows.filter("page_index is not null")


def text_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries from JSON lines; blank lines are skipped, rows must be whole."""
    rows = spark.read.schema("id string, type string, question string, paperId bigint, expectedHeading string").json(path)
    whole = ~T.blank("id") & ~T.blank("question") & (F.col("paperId") > 0) & ~T.blank("expectedHeading") & ~T.blank("type")
    return rows.filter(whole).select("id", "type", F.col("question").alias("query"), F.col("paperId").alias("paper_id"), F.col("expectedHeading").alias("expected"))


def judge_samples(spark: SparkSession, path: str) -> DataFrame:
    """user_input, response, retrieved_contexts (each cut), reference; older key names are taken where the new are missing."""
    rows = spark.read.schema("user_input string, question string, response string, answer string, retrieved_contexts array<string>, contexts array<string>, reference string, ground_truth string").json(path, multiLine=True)
    contexts = F.coalesce("retrieved_contexts", "contexts", F.array().cast("array<string>"))
    return rows.select(F.coalesce("user_input", "question").alias("user_input"), F.coalesce("response", "answer").alias("response"), F.transform(contexts, lambda c: F.substring(c, 1, CONTEXT_CHARS)).alias("retrieved_contexts"), F.coalesce("reference", "ground_truth").alias("reference"))


def chat_memory(df: DataFrame, session: str = "session_id", payload: str = "messages") -> DataFrame:
    """session, turn, role, text from a JSON list a session."""
    return df.select(session, F.posexplode(F.from_json(payload, "array<struct<role:string,text:string>>")).alias("turn", "m")).select(session, "turn", "m.role", "m.text")


#: Parsers by name: each maps frames of (path, content) to frames of (path, markdown).
PARSERS: dict[str, Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]] = {}
ALIASES = {"legacy": "llama"}


def register_parser(name: str, parse: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> None:
    PARSERS[name.strip().lower()] = parse


def parse_files(files: DataFrame, kind: str) -> DataFrame:
    """path, markdown, by the parser of that name."""
    name = kind.strip().lower()
    name = ALIASES.get(name, name)
    if name not in PARSERS:
        raise ValueError(f"unknown parser: {kind}")
    return files.select("path", "content").mapInPandas(PARSERS[name], "path string, markdown string")


def external_works(references: DataFrame, catalogue: DataFrame, on: str = "search_string") -> DataFrame:
    """References with what a supplied catalogue of works says of them."""
    return references.join(catalogue, on, "left")
