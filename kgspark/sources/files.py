"""Files: type by content, validation, the decision for optical recognition, assembly of pages and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Leading bytes in hex, and extensions.
SIGNATURES = [("pdf", "255044462D"), ("docx", "504B0304"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("bmp", "424D")]
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "tiff": "tiff", "tif": "tiff", "bmp": "bmp"}
IMAGES = ["png", "jpeg", "tiff", "bmp"]
MOST_BYTES = 150 * 1024 * 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, content and size of the files under a path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length")


def file_type(content: Column, filename: Column) -> Column:
    """By the first signature that fits, else by extension, else unknown."""
    head = F.hex(F.substring(content, 1, 8))
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    out: Column = F.lit("unknown")
    for name, kind in EXTENSIONS.items():
        out = F.when(extension == name, kind).otherwise(out)
    for kind, signature in reversed(SIGNATURES):
        out = F.when(head.startswith(signature), kind).otherwise(out)
    return out


def validate(files: DataFrame) -> DataFrame:
    """files (filename, content) with type, size, SHA-256 and an error (null: valid)."""
    size = F.octet_length("content")
    kind = file_type(F.col("content"), F.col("filename"))
    error = F.when(F.col("content").isNull(), "File does not exist.").when(size == 0, "File is empty.").when(size > MOST_BYTES, "File is too large.").when(kind == "unknown", "Unknown file type.")
    return files.select("filename", kind.alias("file_type"), size.alias("size"), F.sha2("content", 256).alias("sha256"), error.alias("error"))


def ocr_decision(pages: DataFrame, files: DataFrame, least: int = 30, share: float = 0.5, force: bool = False) -> DataFrame:
    """Whether each file needs optical recognition: a PDF does unless enough of its pages have native text.

    pages: document_id, raw_text. files: document_id, file_type.
    """
    dense = F.length(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"\s", "")) >= least
    native = pages.groupBy("document_id").agg((F.avg(dense.cast("int")) >= share).alias("native"))
    rows = files.join(native, "document_id", "left")
    has = F.when(F.lit(force), False).when(F.col("file_type") == "docx", True).when(F.col("file_type") == "pdf", F.coalesce("native", F.lit(False))).otherwise(False)
    return rows.select("document_id", "file_type", has.alias("has_native_text"), (~has).alias("use_ocr"))


def assemble_pages(blocks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """raw_text of each page: its blocks in order, then its tables' markdown, with blank lines between; empty ones left out.

    blocks: document_id, page_number, idx, text. tables: document_id, page_number, idx, markdown.
    """
    parts = blocks.select("document_id", "page_number", F.lit(0).alias("kind"), "idx", "text")
    if tables is not None:
        parts = parts.union(tables.select("document_id", "page_number", F.lit(1), "idx", "markdown"))
    found = parts.where(F.coalesce("text", F.lit("")) != "").groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("kind", "idx", "text"))).alias("parts"))
    return found.select("document_id", "page_number", F.array_join(F.col("parts.text"), "\n\n").alias("raw_text"))


def full_text(pages: DataFrame) -> DataFrame:
    """A document's pages under their separators."""
    one = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.coalesce("raw_text", F.lit("")))
    found = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", one.alias("text")))).alias("parts"))
    return found.select("document_id", F.array_join(F.col("parts.text"), "\n\n").alias("full_text"))


def sections(blocks: DataFrame) -> DataFrame:
    """Sections of a document: each heading opens one; blocks before the first are its body. The last block counts for the end.

    blocks: document_id, page_number, idx (order in the document), block_id, is_heading, text.
    """
    w = Window.partitionBy("document_id").orderBy("idx")
    heads = F.sum(F.col("is_heading").cast("int")).over(w)
    # A document that begins without a heading has a section more.
    leads = F.first("is_heading").over(w)
    rows = blocks.withColumn("number", heads + F.when(leads, 0).otherwise(1))
    found = rows.groupBy("document_id", "number").agg(
        F.min_by(F.when(F.col("is_heading"), F.col("text")).otherwise("Document Body"), "idx").alias("title"),
        F.min("page_number").alias("page_start"),
        F.max("page_number").alias("page_end"),
        F.count(F.lit(1)).alias("n_blocks"),
    )
    return found.select("document_id", F.format_string("sec_%03d", F.col("number")).alias("section_id"), "title", "page_start", "page_end", "n_blocks")


def list_documents(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), F.sum(F.length("raw_text")).alias("chars"))
