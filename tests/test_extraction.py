import pytest
from pyspark.sql import functions as F

from kgspark.functions import extract, text
from kgspark.plans import texts

DOC = "document_id string, case_id string, title string, pages array<struct<page_number:int,raw_text:string,normalized_text:string,blocks:array<struct<block_type:string,level:int,raw_text:string,normalized_text:string>>>>"


def run(spark, pages, category, title=None):
    rows = [(k + 1, p, None, []) if not isinstance(p, tuple) else (k + 1, *p) for k, p in enumerate(pages)]
    frame = spark.createDataFrame([("d", "c", title, rows)], DOC)
    return extract.extract(frame, [category]).orderBy("pos").collect()


@pytest.mark.parametrize(
    ("category", "page", "want"),
    [
        ("case_citation", "See Brown, 347 U.S. 483 (1954); Heller, 554 U. S. 570 and 12 F. Supp. 2d 34.", ["347 U.S. 483", "554 U.S. 570", "12 F. Supp. 2d 34"]),
        ("statutory_citation", "under 42 U.S.C. § 1983, 18 USC 1001. and 12 C.F.R. § 226.1(a).", ["42 U.S.C. § 1983", "18 U.S.C. § 1001", "12 C.F.R. § 226.1(a"]),
        ("date", "on January 15, 2024, the 15th day of May, 2023, 2022-12-01 and 3/14/2021, not 2024-02-30 or 02/30/2024", ["2023-05-15", "2024-01-15", "2022-12-01", "2021-03-14"]),
        ("docket_number", "Case No. 3:24-cv-00123-JMB; Civil Action No. 1:20-cv-09876; No. 24-CV-1234", ["3:24-CV-00123-JMB", "1:20-CV-09876", "24-CV-1234"]),
        ("docket_number", "no docket here, only 12 and 34", []),
        ("section_reference", "see § 1983, Section 12. Article III and Section 4(a)", ["Section 1983", "Section 12", "Section 4(a)", "Article III"]),
        ("exhibit", "Exhibit A, Ex. b, Exhibit 12 and Plaintiff's Exhibit 3", ["Exhibit A", "Exhibit B", "Exhibit 12", "Exhibit 3 (Plaintiff)"]),
        ("court_name", "in S.D.N.Y. and N.D. Cal., then the 9th Cir. ruled", ["United States District Court for the Southern District of New York", "United States District Court for the Northern District of California", "United States Court of Appeals for the Ninth Circuit"]),
    ],
)
def test_values(spark, category, page, want):
    assert [r.normalized_value for r in run(spark, [page], category)] == want


def test_spans_and_snippets(spark):
    page = "x" * 50 + " filed on\nJanuary 15, 2024 in court"
    r = run(spark, [page], "date")[0]
    assert page[r.start : r.end] == r.original_value == "January 15, 2024"
    assert r.source_text == "x" * 19 + " filed on January 15, 2024 in court" or "\n" not in r.source_text


def test_a_span_that_holds_an_accepted_one_is_kept():
    assert extract.crosses((5, 8), [(4, 9)]) and extract.crosses((2, 5), [(4, 9)]) and not extract.crosses((2, 12), [(4, 9)])


def test_state_statutes_look_at_all_pages(spark):
    page = "; Penal Code § 12"
    assert [r.page_number for r in run(spark, [page, page, "y" * 40 + page], "statutory_citation")] == [1, 3]


def test_filing_types(spark):
    heading = [("HEADING", 1, "Motion for Summary Judgment", None)]
    found = run(spark, [("Notice of Appeal", None, heading), "Stipulation"], "filing_type", "Motion to Dismiss and Answer")
    assert [(r.normalized_value, r.confidence) for r in found] == [("Motion to Dismiss", 0.99), ("Motion for Summary Judgment", 0.95)]
    assert [(r.normalized_value, r.confidence) for r in run(spark, ["The Notice of Appeal and a Subpoena", "Petition"], "filing_type")] == [("Notice of Appeal", 0.9), ("Subpoena", 0.9)]


def test_blank_and_missing_pages(spark):
    for category in extract.EXTRACTORS:
        assert run(spark, ["", "  "], category) == []
    assert extract.extract(spark.createDataFrame([("d", "c", None, None)], DOC)).count() == 0


def test_a_failing_family_leaves_the_others(spark, monkeypatch):
    def broken(document):
        raise ValueError("broken")
        yield

    frame = spark.createDataFrame([("d", "c", None, [(1, "on 2024-01-15", None, [])])], DOC)
    monkeypatch.setitem(extract.EXTRACTORS, "exhibit", broken)
    assert [r.category for r in extract.extract(frame, ["exhibit", "date"]).collect()] == ["date"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("the juris-\ndiction  of   the\tcourt", "the jurisdiction of the court"),
        ("“ﬁling” — ‘ok’", "\"filing\" - 'ok'"),
        ("a\n\n\n\nb \n c", "a\n\nb\nc"),
        ("café​", "café"),
        ("x-\ny", "x-\ny"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize_text(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.normalize_text(F.col("t")).alias("x")).first().x == want


def test_every_document_is_normalised(spark):
    at = "/root/testdata/sf0.001"
    assert texts.t_normalize(spark, at).count() == spark.read.parquet(f"{at}/documents.parquet").count()


def test_references_to_a_case_cited_before():
    from kgspark.functions import extract

    text = "Brown, 347 U. S. 483 (1954). Id. at 490; id., at 491. Brown, supra, at 5. 347 U.S., at 492 and 410 U.S. at 113. Ibid. Idaho, supranational and 12 at 5 aren't."
    found = [(f.normalized, f.original, f.rule.removeprefix("case_citation_pattern")) for _, f in extract.case_citations(extract.Document(None, [extract.Page(1, text, None)]))]
    assert found == [
        ("347 U.S. 483", "347 U. S. 483", ""),
        ("347 U.S. 492", "347 U.S., at 492", "_short"),
        ("410 U.S. 113", "410 U.S. at 113", "_short"),
        ("Id.", "Id.", "_id"),
        ("id.,", "id.,", "_id"),
        ("Ibid.", "Ibid.", "_id"),
        ("supra,", "supra,", "_supra"),
    ]
