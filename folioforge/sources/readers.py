"""Readers of documents, page corpora, question sets, bounds and annotations; and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import strip

DOCUMENT = "doc_id string, title string, content string, source_path string, doc_type string, metadata map<string,string>, pages array<string>"
PAGE_CORPUS = "page_num int, printed_page string, appendix string, text string"
QA_ITEM = (
    "id string, query string, query_en string, constraint_type string, constraint_type_id int, answer string, "
    "answer_source struct<document:string,section:string,page:int,quote:string>, difficulty string, equipment_types array<string>, keywords array<string>, "
    "relevant_chunk_ids array<string>, related_constraints array<string>, source_record_type string, source_id string, mapping_method string"
)
BOUND_ROW = "parameter string, unit string, lower_bound double, upper_bound double, n_guidelines int, n_values int, source string, pages string, example_quote string"
EVAL_FORM = "item_id string, query string, method_code string, answer string, correctness int, numeric_accuracy int, type_match int, readability int, annotator string"


def text_documents(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*.{md,txt}") -> DataFrame:
    """Whole text files as documents, named by their stem."""
    raw = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source_path"))
    name = F.regexp_extract("source_path", r"([^/]+?)\.[^./]+$", 1)
    return raw.select(name.alias("doc_id"), name.alias("title"), "content", "source_path", F.lower(F.regexp_extract("source_path", r"\.([^./]+)$", 1)).alias("doc_type"), F.create_map().cast("map<string,string>").alias("metadata"), F.array("content").alias("pages"))


Parser = Callable[[bytes], list[str]]


def parsed_documents(spark: SparkSession, path: str, parser: Parser, pattern: str, ocr: DataFrame | None = None, least: int = 50) -> DataFrame:
    """Binary files (PDF, DOCX) through ``parser``: bytes to page texts.  A file that fails
    gets an ``error`` and no pages.  Pages with fewer than ``least`` characters take the text
    of ``ocr`` (doc_id, page from 1, text) where it has them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages, errors = [], []
            for raw in frame["content"]:
                try:
                    pages.append(list(parser(bytes(raw))))
                    errors.append(None)
                except Exception as e:  # one bad file mustn't end the scan; it is reported in its row
                    pages.append([])
                    errors.append(str(e)[:500])
            yield pd.DataFrame({"path": frame["path"], "pages": pages, "error": errors})

    rows = files.mapInPandas(run, "path string, pages array<string>, error string").withColumn("doc_id", F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1))
    if ocr is not None:
        better = ocr.select(F.col("doc_id").alias("o_doc"), F.col("page").alias("o_page"), F.col("text").alias("o_text"))
        each = rows.select("doc_id", F.posexplode("pages").alias("i", "text")).join(better, (F.col("doc_id") == F.col("o_doc")) & (F.col("i") + 1 == F.col("o_page")), "left")
        text = F.when(F.length(strip(F.col("text"))) < least, F.coalesce("o_text", "text")).otherwise(F.col("text"))
        fixed = each.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", text.alias("text")))), lambda x: x["text"]).alias("pages2"))
        rows = rows.join(fixed, "doc_id", "left").withColumn("pages", F.coalesce("pages2", "pages")).drop("pages2")
    name = F.col("doc_id")
    return rows.select("doc_id", name.alias("title"), F.array_join("pages", "\n").alias("content"), F.col("path").alias("source_path"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("doc_type"), F.create_map().cast("map<string,string>").alias("metadata"), "pages", "error")


def documents(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """By suffix: md and txt are read as text, others need a parser.  A missing path raises."""
    suffix = path.rpartition(".")[2].lower()
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    if suffix in ("md", "txt"):
        return text_documents(spark, path, recursive=False, pattern="*")
    if parsers and suffix in parsers:
        return parsed_documents(spark, path, parsers[suffix], "*")
    raise ValueError(f"no reader for .{suffix}")


def page_corpus(spark: SparkSession, path: str, prefix: str, least: int = 100) -> DataFrame:
    """Pages of a JSONL corpus with more than ``least`` characters, named prefix_page_n."""
    rows = spark.read.schema(PAGE_CORPUS).json(path)
    return rows.where(F.length(strip(F.col("text"))) > least).select(F.concat(F.lit(f"{prefix}_page_"), F.col("page_num").cast("string")).alias("doc_id"), "page_num", "text")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def qa_items(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """split.jsonl, else split_v2.jsonl, else an empty table."""
    jvm = spark.sparkContext._jvm
    for name in (f"{folder}/{split}.jsonl", f"{folder}/{split}_v2.jsonl"):
        target = jvm.org.apache.hadoop.fs.Path(name)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return spark.read.schema(QA_ITEM).json(name)
    return spark.createDataFrame([], QA_ITEM)


def write_json_lines(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """One folder of JSON lines; ``by`` makes a folder per configuration."""
    writer = rows.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)


def append_new(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Append the rows whose key isn't yet below ``path``; returns what was new."""
    from folioforge.operators.datasets import resume
    from folioforge.storage import materialize

    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    new = materialize(resume(rows, key, spark.read.schema(rows.schema).json(path) if there else None), "new-rows")
    write_json_lines(new, path, mode="append")
    return new


def bounds_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(BOUND_ROW).csv(path)
    return rows.withColumn("pages", F.split("pages", ";"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Filled evaluation forms; an empty score is null."""
    return spark.read.option("header", True).option("nullValue", "").option("multiLine", True).option("escape", '"').schema(EVAL_FORM).csv(path)


def write_form(rows: DataFrame, path: str) -> None:
    """A blind form as CSV, and the item-to-method mapping beside it as JSON."""
    from folioforge.operators.statistics import blind_labels

    coded = blind_labels(rows)
    blank = [F.lit(None).cast("int").alias(c) for c in ("correctness", "numeric_accuracy", "type_match", "readability")]
    coded.select("item_id", "query", "method_code", "answer", *blank, F.lit(None).cast("string").alias("annotator")).write.option("header", True).csv(path)
    coded.select("item_id", "method_code", "method").write.json(f"{path}.mapping")


def batched_model(rows: DataFrame, prompt: str, call: Callable[[list[str]], list[str]], size: int = 20, tries: int = 3, parallel: int = 8) -> DataFrame:
    """Ask a remote model in batches: adds ``answer`` and ``status`` (ok, or the last error).

    ``parallel`` bounds the requests in flight.  Failures back off exponentially and end
    in the row's status; they never look like an answer.
    """
    import time

    at = rows.columns.index(prompt)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), size):
                part = frame.iloc[start : start + size].copy()
                error = ""
                for attempt in range(tries):
                    try:
                        part["answer"], part["status"] = call(part.iloc[:, at].tolist()), "ok"
                        break
                    except Exception as e:  # the status tells; the next try may succeed
                        error = str(e)[:300] or type(e).__name__
                        time.sleep(min(30, 2**attempt) if attempt + 1 < tries else 0)
                else:
                    part["answer"], part["status"] = None, error
                yield part

    from pyspark.sql.types import StructType

    schema = StructType([*rows.schema.fields, *StructType.fromDDL("answer string, status string").fields])
    return rows.repartition(parallel).mapInPandas(run, schema)
