"""Queries on files, texts, extraction and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract, tables, text
from ..operators import chunks, intervals
from ..session import shared_folder
from ..sources import files, parsed
from .fixtures import frame, sql
from .registry import query

# --- Files ---------------------------------------------------------------------------------------------------------

KINDS = ["pdf", "docx", "png", "jpeg", "tiff", "tiff", "bmp", "unknown", "pdf", "unknown"]
HEADS = [s for _, s in files.SIGNATURES] + ["414243", "", ""]
NAMES = ["a.bin", "b.txt", "c.png", "d.pdf", "e.tif", "f.tif", "g.bmp", "h.xyz", "i.PDF", "noextension"]
_pick = lambda values: "case doc_id % 10 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values[:-1])) + f" else '{values[-1]}' end"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "select doc_id, text from documents")
    head = F.unhex(F.expr(_pick(HEADS)))
    content = F.when(F.col("doc_id") % 37 == 0, F.lit("").cast("binary")).otherwise(F.concat(head, F.col("text").cast("binary")))
    return rows.select(F.col("doc_id").alias("document_id"), F.concat(F.col("doc_id").cast("string"), F.expr(_pick(NAMES))).alias("filename"), content.alias("content"))


KIND_SQL = _pick(KINDS)
EMPTY_KIND = _pick(["unknown", "unknown", "png", "pdf", "tiff", "tiff", "bmp", "unknown", "pdf", "unknown"])


@query(f"select doc_id as document_id, case when doc_id % 37 = 0 then {EMPTY_KIND} else {KIND_SQL} end as file_type from documents")
def s_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("document_id", files.file_type(F.col("content"), F.col("filename")).alias("file_type"))


@query(f"""with f as (select doc_id, doc_id || {_pick(NAMES)} as filename, case when doc_id % 37 = 0 then ''::blob else unhex({_pick(HEADS)}) || encode(text) end as content, case when doc_id % 37 = 0 then {EMPTY_KIND} else {KIND_SQL} end as kind from documents)
  select filename, sha256(content) as sha256, cast(octet_length(content) as bigint) as size, case when octet_length(content) = 0 then 'File is empty.' when kind = 'unknown' then 'Unknown file type.' end as error from f""")
def s_validate_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.validate(_files(spark, sf_dir)).select("filename", "sha256", F.col("size").cast("long").alias("size"), "error")


# Pages with their whole texts, and scanned ones, which have a stamp only: none, one, two or three for each of the former.
PAGED = """select doc_id % 97 as document_id, cast(doc_id as int) as page_number, text as raw_text from documents
  union all select doc_id % 97, cast(-1 - doc_id * 3 - k as int), source from documents join (values (0), (1), (2)) s(k) on k < (doc_id % 97) % 4"""


@query(f"""with p as ({PAGED}), n as (select document_id, avg(case when length(regexp_replace(raw_text, '\\s', '', 'g')) >= 30 then 1 else 0 end) >= 0.5 as native from p group by 1),
  f as (select distinct document_id, case document_id % 4 when 0 then 'docx' when 1 then 'png' else 'pdf' end as file_type from p)
  select document_id, file_type, case file_type when 'docx' then true when 'pdf' then native else false end as has_native_text, not (case file_type when 'docx' then true when 'pdf' then native else false end) as use_ocr from f join n using (document_id)""")
def s_ocr_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = sql(spark, sf_dir, PAGED)
    kinds = pages.select("document_id").distinct().withColumn("file_type", F.expr("case document_id % 4 when 0 then 'docx' when 1 then 'png' else 'pdf' end"))
    return files.ocr_decision(pages, kinds)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a document as blocks: three pages, every seventh line a heading."""
    rows = sql(spark, sf_dir, "select doc_id as document_id, text from documents").select("document_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return rows.select(
        "document_id",
        (F.floor(F.col("idx") / 5) + 1).cast("int").alias("page_number"),
        "idx",
        F.concat(F.lit("b"), F.col("idx").cast("string")).alias("block_id"),
        ((F.col("idx") + F.col("document_id")) % 7 == 0).alias("is_heading"),
        "text",
        F.when((F.col("idx") + F.col("document_id")) % 7 == 0, F.concat(F.lit("s"), F.col("idx").cast("string"))).alias("section_id"),
    )


LINES = """lines0 as (select doc_id as document_id, string_split(text, chr(10)) as l from documents), blocks as (select document_id, cast(generate_subscripts(l, 1) - 1 as int) as idx, unnest(l) as text from lines0),
  blk as (select document_id, cast(floor(idx / 5) + 1 as int) as page_number, idx, 'b' || idx as block_id, (idx + document_id) % 7 = 0 as is_heading, text from blocks)"""


@query(f"with {LINES} select document_id, page_number, string_agg(text, chr(10) || chr(10) order by idx) as raw_text from blk where text <> '' group by 1, 2")
def s_page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.assemble_pages(_lines(spark, sf_dir))


@query(f"""with {LINES}, pg as (select document_id, page_number, string_agg(text, chr(10) || chr(10) order by idx) as raw_text from blk where text <> '' group by 1, 2)
  select document_id, string_agg('--- Page ' || page_number || ' ---' || chr(10) || raw_text, chr(10) || chr(10) order by page_number) as full_text from pg group by 1""")
def t_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.full_text(files.assemble_pages(_lines(spark, sf_dir)))


@query(f"""with {LINES}, n as (select *, sum(case when is_heading then 1 else 0 end) over (partition by document_id order by idx) + case when document_id % 7 = 0 then 0 else 1 end as k from blk)
  select document_id, printf('sec_%03d', cast(k as int)) as section_id, arg_min(case when is_heading then text else 'Document Body' end, idx) as title, min(page_number) as page_start, max(page_number) as page_end, count(*) as n_blocks from n group by document_id, k""")
def s_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sections(_lines(spark, sf_dir))


@query(f"with {LINES}, pg as (select document_id, page_number, string_agg(text, chr(10) || chr(10) order by idx) as raw_text from blk where text <> '' group by 1, 2) select document_id, count(*) as page_count, cast(sum(length(raw_text)) as bigint) as chars from pg group by 1")
def s_list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.list_documents(files.assemble_pages(_lines(spark, sf_dir)))


# --- Chunks --------------------------------------------------------------------------------------------------------

LIMIT = 300


@query(f"""with recursive {LINES}, own as (select document_id, page_number, trim(text) as text, block_id, idx, length(trim(text)) as len, row_number() over (partition by document_id, page_number order by idx) as rn from blk where trim(text) <> ''),
  walk as (select document_id, page_number, rn, len + 1 as held, 0 as chunk from own where rn = 1
    union all select o.document_id, o.page_number, o.rn, case when w.held + o.len > {LIMIT} then o.len + 1 else w.held + o.len + 1 end, case when w.held + o.len > {LIMIT} then w.chunk + 1 else w.chunk end
    from walk w join own o on o.document_id = w.document_id and o.page_number = w.page_number and o.rn = w.rn + 1),
  up as (select o.*, w.chunk, sum(o.len + 1) over (partition by o.document_id, o.page_number order by o.rn) as upto from own o join walk w using (document_id, page_number, rn)),
  c as (select document_id, page_number, chunk, string_agg(text, chr(10) order by idx) as text, string_agg(block_id, ',' order by idx) as block_ids, max(upto) as upto from up group by 1, 2, 3)
  select 'chunk_' || document_id || '_p' || page_number || '_' || chunk as chunk_id, cast(length(text) as int) as chars, cast(upto - length(text) as int) as start_char_offset, block_ids from c""")
def c_chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.pack(_lines(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("string")), LIMIT)
    return found.select("chunk_id", F.length("text").alias("chars"), "start_char_offset", F.array_join("block_ids", ",").alias("block_ids"))


@query("""with p as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents), l as (select doc_id, string_split(trim(text), chr(10) || chr(10)) as l from p), e as (select doc_id, generate_subscripts(l, 1) - 1 as idx, unnest(l) as part from l),
  o as (select *, sum(length(part) + 2) over (partition by doc_id order by idx) - length(part) - 2 as place from e)
  select doc_id as document_id, cast(place + length(part) - length(ltrim(part)) as int) as start_char_offset, trim(part) as text from o where trim(part) <> ''""")
def c_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = sql(spark, sf_dir, "select doc_id as document_id, 1 as page_number, replace(text, '\n', '\n\n') as text from documents")
    return chunks.paragraphs(pages).select("document_id", "start_char_offset", "text")


@query(f"""with {LINES}, h as (select document_id, idx, last_value(case when is_heading then 's' || idx end ignore nulls) over (partition by document_id order by idx) as s, block_id from blk) select document_id, block_id, coalesce(s, 'body') as section_id from h""")
def c_block_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by the section that lists them last: every block is also listed by a body section before all others."""
    rows = _lines(spark, sf_dir)
    body = rows.groupBy("document_id").agg(F.collect_list("block_id").alias("block_ids")).select("document_id", F.lit(-1).alias("number"), F.lit("body").alias("section_id"), "block_ids")
    w = Window.partitionBy("document_id").orderBy("idx")
    own = rows.withColumn("s", F.last("section_id", ignorenulls=True).over(w)).where("s is not null").groupBy("document_id", "s").agg(F.min("idx").alias("number"), F.collect_list("block_id").alias("block_ids"))
    return chunks.block_sections(body.union(own.select("document_id", "number", F.col("s").alias("section_id"), "block_ids")))


# --- Normaliser ----------------------------------------------------------------------------------------------------

DIRTY = "select doc_id, replace(replace(replace(replace(text, 'the ', '“the”  '), ' on', ' o-\n n'), 'ing', 'i​ng\u0007'), 'f', 'ﬁ') as text from documents"
CLEAN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(t, 'ﬁ', 'fi'), '“', '"'), '”', '"'), '[​\u0007]', '', 'g'), '(\\b[a-zA-Z]{2,})-\\s*\\n\\s*([a-zA-Z]{2,}\\b)', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"""
DUCK_DIRTY = DIRTY.replace("\n", "' || chr(10) || '").replace("​", "' || chr(8203) || '").replace("\u0007", "' || chr(7) || '")


@query(f"with d as ({DUCK_DIRTY}), n as (select doc_id, text as t from d) select doc_id, trim({CLEAN.replace('[' + chr(8203) + chr(7) + ']', '[' + chr(92) + 'x{200b}' + chr(92) + 'x07]')}, ' ' || chr(10)) as text from n")
def t_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, DIRTY).select("doc_id", text.normalize_text(F.col("text")).alias("text"))


# --- Extraction ----------------------------------------------------------------------------------------------------

COURT_NAMES = ["S.D.N.Y.", "N.D. Cal.", "Ninth Circuit", "2nd Cir.", "SCOTUS"]
COURT_FULL = [
    "United States District Court for the Southern District of New York",
    "United States District Court for the Northern District of California",
    "United States Court of Appeals for the Ninth Circuit",
    "United States Court of Appeals for the Second Circuit",
    "Supreme Court of the United States",
]
FILING = ["Motion to Dismiss", "Notice of Appeal", "Stipulation", "Reply Brief"]
FILING_NAME = ["Motion to Dismiss", "Notice of Appeal", "Stipulation", "Brief"]
_of = lambda k, values: f"case o_orderkey % {k} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"
DAY = "case form % 3 when 0 then mname || ' ' || cast(dd as string) || ', ' || cast(y as string) when 1 then iso else cast(m as string) || '/' || cast(dd as string) || '/' || cast(y as string) end"
LEGAL = f"""select 'd_' || cast(cast(floor(o_orderkey / 4) as bigint) as string) as document_id, cast(o_orderkey % 4 as int) + 1 as page_number, o_orderkey, iso,
  'Filed in ' || {_of(5, COURT_NAMES)} || ' as Case No. ' || cast(o_orderkey % 9 + 1 as string) || ':24-cv-' || cast(10000 + o_orderkey as string) || ' on ' || {DAY} || ' under ' || cast(o_orderkey % 50 + 1 as string) || ' U.S.C. § ' || cast(o_custkey + 10 as string)
  || ' and; Penal Code § ' || cast(o_orderkey % 90 + 1 as string) || ', with Exhibit ' || cast(o_orderkey % 26 as string) || ' and Article ' || cast(o_orderkey % 7 + 1 as string) || '; see ' || cast(o_orderkey % 500 + 1 as string) || ' F.3d ' || cast(o_orderkey % 900 + 1 as string) || '. ' || {_of(4, FILING)} || ' follows.' as raw_text
  from orders join date_texts on id = o_orderkey"""
VALUE = {
    "court_name": _of(5, COURT_FULL),
    "docket_number": "cast(o_orderkey % 9 + 1 as string) || ':24-CV-' || cast(10000 + o_orderkey as string)",
    "date": "iso",
    "statute": "cast(o_orderkey % 50 + 1 as string) || ' U.S.C. § ' || cast(o_custkey + 10 as string)",
    "state": "'Penal Code § ' || cast(o_orderkey % 90 + 1 as string)",
    "exhibit": "'Exhibit ' || cast(o_orderkey % 26 as string)",
    "case_citation": "cast(o_orderkey % 500 + 1 as string) || ' F.3d ' || cast(o_orderkey % 900 + 1 as string)",
    "filing_type": _of(4, FILING_NAME),
}
PAGE_KEY = "select 'd_' || cast(cast(floor(o_orderkey / 4) as bigint) as string) as document_id, cast(o_orderkey % 4 as int) + 1 as page_number"


def _paged(rows: DataFrame) -> DataFrame:
    """Documents with their pages nested. rows: document_id, page_number, raw_text and, if there are any, title and heading."""
    none = "array<struct<block_type:string,level:int,raw_text:string,normalized_text:string>>"
    blocks = F.array().cast(none)
    if "heading" in rows.columns:
        block = F.struct(F.lit("HEADING").alias("block_type"), F.lit(2).alias("level"), F.col("heading").alias("raw_text"), F.lit(None).cast("string").alias("normalized_text"))
        blocks = F.when(F.col("heading").isNotNull(), F.array(block)).otherwise(blocks)
    page = F.struct("page_number", "raw_text", F.lit(None).cast("string").alias("normalized_text"), blocks.alias("blocks"))
    title = F.max("title") if "title" in rows.columns else F.lit(None).cast("string")
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list(page)).alias("pages"), title.alias("title")).select("document_id", F.lit("c").alias("case_id"), "title", "pages")


def _legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(sql(spark, sf_dir, LEGAL))


_JSON = "select doc_id, 'd' || cast(doc_id as string) as document_id, text, source, lang from documents"


@query("""select 'document' as kind, 'd' || cast(doc_id as string) as document_id, case when doc_id % 7 = 0 then 'again.txt' else source || '.txt' end as filename, case when text is null then 1 else 2 end as page_count, sha256(coalesce(text, '')) as text_sha from documents
  union all select 'bad', null, null, 0, sha256('{"document_id": "d' || cast(doc_id as string) || '", "pages": [') from documents where doc_id % 10 = 3""")
def s_parsed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through JSON and back, some saved twice, with lines among them that break off."""
    at, own = shared_folder(spark, "parsed"), sql(spark, sf_dir, _JSON)
    page = lambda n, text: F.struct(F.lit(n).alias("page_number"), text.alias("raw_text"), F.array(F.struct(F.lit("b1").alias("block_id"), F.lit("TEXT").alias("block_type"), text.alias("raw_text"))).alias("blocks"))
    pages = F.when(F.col("text").isNull(), F.array(page(1, F.lit("").cast("string")))).otherwise(F.array(page(1, F.col("text")), page(2, F.lit("end"))))
    meta = F.struct(F.lit("SUCCESS").alias("processing_status"), F.lit("2024-01-01").alias("started_at")).alias("processing_metadata")
    rows = own.select("doc_id", "document_id", F.concat("source", F.lit(".txt")).alias("filename"), F.lit("txt").alias("file_type"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256_hash"), pages.alias("pages"), meta)
    parsed.save(rows.drop("doc_id"), at)
    parsed.save(rows.where("doc_id % 7 = 0").withColumn("filename", F.lit("again.txt")).drop("doc_id"), at)
    broken = own.where("doc_id % 10 = 3").select(F.concat(F.lit('{"document_id": "'), "document_id", F.lit('", "pages": [')).alias("value"), F.lit(0).alias("shard"))
    broken.write.mode("append").partitionBy("shard").text(at)
    found = parsed.load(spark, at).select(F.lit("document").alias("kind"), "document_id", "filename", F.size("pages").alias("page_count"), F.sha2(F.col("pages")[0]["blocks"][0]["raw_text"], 256).alias("text_sha"))
    none = F.lit(None)
    return found.union(parsed.read(spark, at).where(F.col(parsed.BAD).isNotNull()).select(F.lit("bad"), none.cast("string"), none.cast("string"), F.lit(0), F.sha2(parsed.BAD, 256)))


def _candidates(spark: SparkSession, sf_dir: str, category: str, legal: DataFrame | None = None) -> DataFrame:
    """Values with their places, what stands there and around it, the type and the rule."""
    found = extract.extract(_legal(spark, sf_dir) if legal is None else legal, [category])
    return found.select("document_id", "page_number", "normalized_value", "confidence", "entity_type", "rule_name", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "original_value", "source_text")


def _twin(raw: str, value: str, confidence: str, kind: str, rule: str, margin: int = 30, blanks: int = 0, where: str = "true", legal: str = "", after: str = "''") -> str:
    """The twin of _candidates. raw: what stands in the text; after: what it is found behind; blanks: before it, part of its
    span; margin: of the snippet."""
    rows = (legal or LEGAL).replace("\n  from orders join", f", {raw} as raw, {value} as v, {rule if ' ' in rule else repr(rule)} as rule_name, cast({confidence} as double) as confidence\n  from orders join", 1)
    rows = rows.replace(" as raw,", f" as raw, {after} as lead,", 1)
    a = f"strpos(raw_text, lead || raw) - 1 + length(lead) - {blanks}"
    return f"""select document_id, page_number, v as normalized_value, confidence, '{kind}' as entity_type, rule_name, {a} as span_start, {a} + {blanks} + length(raw) as span_end, raw as original_value,
      trim(substr(raw_text, greatest({a} - {margin}, 0) + 1, {a} + {blanks} + length(raw) + {margin} - greatest({a} - {margin}, 0))) as source_text from ({rows}) z where {where}"""


@query(_twin(VALUE["case_citation"], VALUE["case_citation"], "0.95", "CASE", "case_citation_pattern", 40))
def x_case_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "case_citation")


# A state citation counts only if its span meets none found before in the document, whatever the page: the offsets decide.
@query(_twin(VALUE["statute"], VALUE["statute"], "0.98", "STATUTE", "usc_cfr_statute_pattern", 40))
def x_statute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "statutory_citation").where("confidence = 0.98")


# A document's pages in order: a state citation counts if it meets no federal one so far and no state one that counted.
CITED = LEGAL.replace("\n  from orders join", f", {VALUE['statute']} as fed, {VALUE['state']} as st\n  from orders join")
STATE_FOLD = f"""cited as ({CITED}), spans as (select document_id, page_number, o_orderkey, st, row_number() over (partition by document_id order by page_number) as rn, strpos(raw_text, fed) as fs, strpos(raw_text, fed) + length(fed) as fe, strpos(raw_text, st) as ss, strpos(raw_text, st) + length(st) as se from cited),
  first_page as (select *, [struct_pack(s := fs, e := fe)] as held from spans where rn = 1),
  fold as (select document_id, rn, len(list_filter(held, lambda x: x.s < se and ss < x.e)) = 0 as counted, case when len(list_filter(held, lambda x: x.s < se and ss < x.e)) = 0 then list_append(held, struct_pack(s := ss, e := se)) else held end as held from first_page
    union all select p.document_id, p.rn, len(list_filter(list_append(f.held, struct_pack(s := p.fs, e := p.fe)), lambda x: x.s < p.se and p.ss < x.e)) = 0,
      case when len(list_filter(list_append(f.held, struct_pack(s := p.fs, e := p.fe)), lambda x: x.s < p.se and p.ss < x.e)) = 0 then list_append(list_append(f.held, struct_pack(s := p.fs, e := p.fe)), struct_pack(s := p.ss, e := p.se)) else list_append(f.held, struct_pack(s := p.fs, e := p.fe)) end
      from fold f join spans p on p.document_id = f.document_id and p.rn = f.rn + 1)"""


@query(f"with recursive {STATE_FOLD}, t as ({_twin(VALUE['state'], VALUE['state'], '0.9', 'STATUTE', 'state_statute_pattern', 40)}) select t.* from t join (select document_id, page_number from fold join spans using (document_id, rn) where counted) c using (document_id, page_number)")
def x_statute_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State statutes: earlier pages' spans count in the overlap check."""
    return _candidates(spark, sf_dir, "statutory_citation").where("confidence = 0.9")


@query(_twin(DAY, "iso", "0.96", "DATE", "legal_date_pattern"))
def x_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "date")


@query(_twin(DAY, "iso", "0.96", "DATE", "legal_date_pattern"))
def x_date_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of x_date by a table function of SQL, a partition a document."""
    tables.register(spark)
    pages = _legal(spark, sf_dir).select("document_id", "title", F.explode("pages").alias("p")).select("document_id", "title", "p.page_number", "p.raw_text", "p.normalized_text")
    columns = "document_id, page_number, normalized_value, confidence, entity_type, rule_name, cast(start as long) as span_start, cast(end as long) as span_end, original_value, source_text"
    return spark.sql(f"select {columns} from extract_entities(table(select * from {{pages}}) partition by (document_id) order by (page_number), 'date')", pages=pages)


DOCKET = _twin("'Case No. ' || cast(o_orderkey % 9 + 1 as string) || ':24-cv-' || cast(10000 + o_orderkey as string)", VALUE["docket_number"], "0.97", "CASE", "docket_pattern")


@query(DOCKET)
def x_docket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "docket_number")


SECTION = lambda raw, value, after="''": _twin(raw, value, "0.92", "DOCUMENT", "section_article_clause_pattern", after=after)


@query(" union all ".join([SECTION("'§ ' || cast(o_custkey + 10 as string)", "'Section ' || cast(o_custkey + 10 as string)"), SECTION("'§ ' || cast(o_orderkey % 90 + 1 as string)", "'Section ' || cast(o_orderkey % 90 + 1 as string)", "'Code '"), SECTION("'Article ' || cast(o_orderkey % 7 + 1 as string)", "'Article ' || cast(o_orderkey % 7 + 1 as string)")]))
def x_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "section_reference")


# A place for the party's name comes first in the pattern, and blanks after it, so that a span begins with the blank.
@query(_twin(VALUE["exhibit"], VALUE["exhibit"], "0.96", "EXHIBIT", "exhibit_designation_pattern", blanks=1))
def x_exhibit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "exhibit")


@query(_twin(_of(4, FILING), VALUE["filing_type"], "0.90", "FILING", "page1_caption_filing_vocab", 20, where="page_number = 1"))
def x_filing_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "filing_type")


# A stop at the end isn't part of an abbreviation.
@query(_twin(_of(5, [n.rstrip(".") for n in COURT_NAMES]), VALUE["court_name"], "case when o_orderkey % 5 in (2, 3) then 0.97 else 0.96 end", "COURT", "case when o_orderkey % 5 in (2, 3) then 'numbered_circuit_court_pattern' else 'controlled_court_pattern' end"))
def x_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "court_name")


# Every reporter, written with and without its blanks, and each form that refers to a case cited before.
REPORTER = _of(len(extract.REPORTERS), [w for w, _ in extract.REPORTERS]).replace("o_orderkey", "o_custkey")
WRITTEN = f"case when o_orderkey % 2 = 0 then {REPORTER} else replace({REPORTER}, ' ', '') end"
CITING = f"""select 'd_' || cast(o_orderkey as string) as document_id, 1 as page_number, 'In Roe v. Doe, ' || cast(o_orderkey % 500 + 1 as string) || ' ' || {WRITTEN} || ' ' || cast(o_orderkey % 900 + 1 as string) || ' (1954), it was held so. Id. at 5; Doe, supra, at 9. Then '
  || cast(o_orderkey % 500 + 1 as string) || ' ' || {WRITTEN} || ', at ' || cast(o_orderkey % 900 + 7 as string) || ' follows. Ibid. That is all.' as raw_text
  from orders join date_texts on id = o_orderkey"""


def _cited(raw: str, value: str, rule: str) -> str:
    return _twin(raw, value, "0.95", "CASE", f"case_citation_pattern{rule}", 40, legal=CITING)


def _number(plus: int) -> str:
    return f"cast(o_orderkey % 900 + {plus} as string)"


VOLUME = "cast(o_orderkey % 500 + 1 as string) || ' ' || "


@query(" union all ".join([
    _cited(f"{VOLUME}{WRITTEN} || ' ' || {_number(1)}", f"{VOLUME}{REPORTER} || ' ' || {_number(1)}", ""),
    _cited(f"{VOLUME}{WRITTEN} || ', at ' || {_number(7)}", f"{VOLUME}{REPORTER} || ' ' || {_number(7)}", "_short"),
    _cited("'Id.'", "'Id.'", "_id"), _cited("'Ibid.'", "'Ibid.'", "_id"), _cited("'supra,'", "'supra,'", "_supra"),
]))
def x_citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "case_citation", _paged(sql(spark, sf_dir, CITING)))


# A title on every third document, a heading on page 2 and, on every other document, on page 1; else page 1's caption counts.
FILED = f"""select 'd_' || cast(o_orderkey as string) as document_id, p.page_number, case when o_orderkey % 3 = 0 then 'Re: ' || {_of(4, FILING)} || ' of record' end as title,
  case when p.page_number = 2 or o_orderkey % 2 = 0 then {_of(4, FILING[1:] + FILING[:1])} || ' (part)' end as heading, 'Some words first. ' || {_of(4, FILING)} || ' follows.' as raw_text
  from orders join date_texts on id = o_orderkey cross join (select 1 as page_number union all select 2) p"""
TITLED = _of(4, FILING_NAME), _of(4, FILING_NAME[1:] + FILING_NAME[:1])


@query(f"""with f as ({FILED.replace("p.page_number,", f"p.page_number, {_of(4, FILING)} as own, {TITLED[0]} as own_name, {_of(4, FILING[1:] + FILING[:1])} as head, {TITLED[1]} as head_name,", 1)}),
  w as (select *, own as own_raw, head as head_raw from f)
  select document_id, 1 as page_number, own_name as normalized_value, cast(0.99 as double) as confidence, 'FILING' as entity_type, 'document_metadata_title_filing_vocab' as rule_name, strpos(title, own_raw) - 1 as span_start, strpos(title, own_raw) - 1 + length(own_raw) as span_end, own_raw as original_value, 'Document Metadata Title: ' || title as source_text from w where title is not null and page_number = 1
  union all select document_id, page_number, head_name, 0.95, 'FILING', 'heading_filing_vocab', strpos(heading, head_raw) - 1, strpos(heading, head_raw) - 1 + length(head_raw), head_raw, heading from w where heading is not null
  union all select document_id, page_number, own_name, 0.9, 'FILING', 'page1_caption_filing_vocab', strpos(raw_text, own_raw) - 1, strpos(raw_text, own_raw) - 1 + length(own_raw), own_raw, trim(substr(raw_text, greatest(strpos(raw_text, own_raw) - 20, 1), strpos(raw_text, own_raw) + length(own_raw) + 20 - greatest(strpos(raw_text, own_raw) - 20, 1))) from w where heading is null and page_number = 1""")
def x_filing_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing types by title, heading and caption."""
    return _candidates(spark, sf_dir, "filing_type", _paged(sql(spark, sf_dir, FILED)))


@query(f"""with recursive {STATE_FOLD}, pages as (select 'd_' || cast(cast(floor(o_orderkey / 4) as bigint) as string) as document_id, o_orderkey from orders)
  select document_id, c.category, cast(count(*) * c.per as bigint) as n from pages cross join (values ('case_citation', 1), ('date', 1), ('docket_number', 1), ('section_reference', 3), ('exhibit', 1), ('court_name', 1)) c(category, per) group by 1, 2, c.per
  union all select document_id, 'filing_type', count(*) from pages where o_orderkey % 4 = 0 group by 1
  union all select document_id, 'statutory_citation', count(*) + count(*) filter (where counted) from fold group by 1""")
def x_summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.summary_counts(extract.extract(_legal(spark, sf_dir)))


@query(DOCKET)
def x_filter_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one category and type; other families aren't run."""
    return _candidates(spark, sf_dir, "docket_number").where("entity_type = 'CASE'")


@query(f"select document_id, page_number, trim(substr(raw_text, position('U.S.C.' in raw_text) - 12, 30)) as snippet from ({LEGAL})")
def x_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, LEGAL)
    at = F.expr("locate('U.S.C.', raw_text) - 1")
    return rows.select("document_id", "page_number", text.snippet(F.col("raw_text"), at, at + 6, 12).alias("snippet"))


SPANS = "select okey as page, line as pos, cast(line * 7 + okey % 5 as int) as s, cast(line * 7 + okey % 5 + 3 + okey % 9 as int) as e from lines"


@query(f"""with recursive sp as ({SPANS}), o as (select *, row_number() over (partition by page order by pos) as rn from sp),
  w as (select page, rn, [struct_pack(s := s, e := e)] as kept, true as ok from o where rn = 1
    union all select o.page, o.rn, case when len(list_filter(w.kept, lambda x: (x.s <= o.s and o.s < x.e) or (x.s < o.e and o.e <= x.e))) > 0 then w.kept else list_append(w.kept, struct_pack(s := o.s, e := o.e)) end,
    len(list_filter(w.kept, lambda x: (x.s <= o.s and o.s < x.e) or (x.s < o.e and o.e <= x.e))) = 0 from w join o on o.page = w.page and o.rn = w.rn + 1)
  select o.page, o.pos, w.ok as accepted from w join o using (page, rn)""")
def x_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap suppression as a fold over a page's spans, without Python."""
    rows = sql(spark, sf_dir, SPANS).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "e"))).alias("spans"))
    empty = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("kept"), F.array().cast("array<boolean>").alias("ok"))

    def step(state, x):
        hit = F.exists(state["kept"], lambda k: ((k["s"] <= x["s"]) & (x["s"] < k["e"])) | ((k["s"] < x["e"]) & (x["e"] <= k["e"])))
        return F.struct(F.when(hit, state["kept"]).otherwise(F.array_append(state["kept"], F.struct(x["s"].alias("s"), x["e"].alias("e")))).alias("kept"), F.array_append(state["ok"], ~hit).alias("ok"))

    folded = rows.withColumn("ok", F.aggregate("spans", empty, step)["ok"])
    return folded.select("page", F.explode(F.arrays_zip("spans", "ok")).alias("x")).select("page", F.col("x.spans.pos").alias("pos"), F.col("x.ok").alias("accepted"))


@query("select mention_id, round(confidence, 4) as confidence from mentions where confidence >= 0.4")
def x_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "mentions").where("confidence >= 0.4").select("mention_id", F.round("confidence", 4).alias("confidence"))


# Spans of two tables in one document's places: mentions, and annotations of which every fiftieth is very long.
MENTIONED = "select mention_id, document_id, page_number * 1000 + start_offset as s, page_number * 1000 + end_offset as e from mentions"
NOTED = """select o_orderkey as note_id, 'd_' || cast(cast(floor(o_orderkey / 32) as bigint) as string) as document_id, (o_orderkey % 32 + 1) * 1000 + o_custkey % 200 as note_start,
  (o_orderkey % 32 + 1) * 1000 + o_custkey % 200 + case when o_orderkey % 50 = 0 then 1000000000 else 20 + o_orderkey % 300 end as note_end from orders"""


@query(f"with a as ({MENTIONED}), b as ({NOTED}) select a.mention_id, b.note_id from a join b on a.document_id = b.document_id and s < note_end and note_start < e")
def x_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of mentions and of annotations that overlap, by bins."""
    return intervals.overlap_join(sql(spark, sf_dir, MENTIONED), sql(spark, sf_dir, NOTED), ["document_id"], ("s", "e"), ("note_start", "note_end")).select("mention_id", "note_id")


@query(f"with a as ({MENTIONED}), b as ({NOTED}) select a.mention_id, b.note_id, s - note_start as distance from a join b on a.document_id = b.document_id and abs(s - note_start) <= 5")
def x_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that begin within five characters of an annotation's beginning."""
    rows = intervals.near_join(sql(spark, sf_dir, MENTIONED), sql(spark, sf_dir, NOTED), ["document_id"], "s", "note_start", 5)
    return rows.select("mention_id", "note_id", (F.col("s") - F.col("note_start")).alias("distance"))
