"""Extraction as a table function of SQL: SELECT * FROM extract_entities(TABLE(pages) PARTITION BY (document_id) ORDER BY (page_number), 'date').

Its table argument has a row for each page; a partition is a document. Any family of `extract.EXTRACTORS`, registered ones
included, can be named. For bulk work `extract.extract` is the faster way, as it takes Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..shipping import ship
from .extract import EXTRACTORS, Document, Page

NEEDED = {"document_id", "page_number", "raw_text"}
_TYPES = {"page_number": T.IntegerType(), "confidence": T.DoubleType(), "start": T.IntegerType(), "end": T.IntegerType()}
# Built from types, for the worker that analyzes has no session to parse a schema with.
FOUND = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in ("document_id", "page_number", "entity_type", "rule_name", "confidence", "start", "end", "original_value", "normalized_value", "source_text")])


class ExtractEntities:
    @staticmethod
    def analyze(pages: AnalyzeArgument, category: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("the first argument has to be a table of pages")
        missing = NEEDED - {f.name for f in pages.dataType.fields}
        if missing:
            raise ValueError(f"the table of pages has no {', '.join(sorted(missing))}")
        if not category.isConstantExpression or category.value not in EXTRACTORS:
            raise ValueError(f"the second argument has to be one of {', '.join(EXTRACTORS)}")
        return AnalyzeResult(schema=FOUND)

    def __init__(self) -> None:
        self.document, self.category = Document(None, []), ""

    def eval(self, page: Row, category: str) -> None:
        own = page.asDict()
        self.document_id, self.category = own["document_id"], category
        self.document = Document(own.get("title"), [*self.document.pages, Page(own["page_number"], own["raw_text"] or "", own.get("normalized_text"), [])])

    def terminate(self) -> Iterator[tuple]:
        if self.category:
            for number, f in EXTRACTORS[self.category](self.document):
                yield (self.document_id, number, f.entity_type, f.rule, f.confidence, f.start, f.end, f.original, f.normalized, f.snippet)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("extract_entities", udtf(ExtractEntities))
