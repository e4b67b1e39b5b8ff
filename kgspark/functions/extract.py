"""Rule extraction: spans of citations, dates, docket numbers and other references in the pages of a document.

A rule family is a list of patterns with a way to read a match. Patterns run in order over a page; a match that begins or
ends inside an accepted one of the same page is dropped, while one that strictly holds it is not. Documents are independent
and read once, with their pages nested, by a task that needs nothing else.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

log = logging.getLogger(__name__)

Span = tuple[int, int]

# Reporters of case citations, as (written form, pattern).
REPORTERS = [
    ("U.S.", r"U\.\s?S\."),
    ("S. Ct.", r"S\.\s?Ct\."),
    ("L. Ed. 2d", r"L\.\s?Ed\.\s?2d"),
    ("L. Ed.", r"L\.\s?Ed\."),
    ("F. Supp. 3d", r"F\.\s?Supp\.\s?3d"),
    ("F. Supp. 2d", r"F\.\s?Supp\.\s?2d"),
    ("F. Supp.", r"F\.\s?Supp\."),
    ("F.4th", r"F\.\s?4th"),
    ("F.3d", r"F\.\s?3d"),
    ("F.2d", r"F\.\s?2d"),
    ("F.", r"F\."),
    ("B.R.", r"B\.\s?R\."),
    ("Cal. Rptr.", r"Cal\.\s?Rptr\."),
    ("N.Y.S.2d", r"N\.\s?Y\.\s?S\.\s?2d"),
    ("N.E.2d", r"N\.\s?E\.\s?2d"),
    ("N.W.2d", r"N\.\s?W\.\s?2d"),
    ("S.E.2d", r"S\.\s?E\.\s?2d"),
    ("S.W.3d", r"S\.\s?W\.\s?3d"),
    ("So. 2d", r"So\.\s?2d"),
    ("P.2d", r"P\.\s?2d"),
    ("P.3d", r"P\.\s?3d"),
    ("A.2d", r"A\.\s?2d"),
]
CASE_CITATION = re.compile(r"\b(\d{1,4})\s+(" + "|".join(p for _, p in REPORTERS) + r")\s+(\d{1,5})\b")

# A reporter's name by its form without blanks.
REPORTER_NAME = {"".join(w.split()): w for w, _ in REPORTERS}

# References to a case cited before: volume, reporter and the place in it; the last one; one by its name.
SHORT_CITATION = re.compile(r"\b(\d{1,4})\s+(" + "|".join(p for _, p in REPORTERS) + r")\s?,?\s+at\s+(\d{1,5})\b")
ID_CITATION = re.compile(r"(?<!\S)(?:id\.,?|ibid\.)(?=\s|$)", re.IGNORECASE)
SUPRA_CITATION = re.compile(r"(?<!\S)supra,?(?=\s|$)", re.IGNORECASE)

# Federal and state statutes.
FEDERAL = re.compile(r"\b(?P<title>\d+)\s+(?P<code>U\.?\s*S\.?\s*C\.?|C\.?\s*F\.?\s*R\.?)\s*(?:App\.?\s*)?(?:(?:§+|Sec(?:tion|\.)?)\s*)?(?P<section>\d+[a-zA-Z0-9\-\.\(\)]*)", re.IGNORECASE)
STATE = re.compile(r"\b(?P<code>[A-Z][a-zA-Z\.\s]{1,25}(?:Stat|Code|Law|Act|Regs)\.?)\s*(?:§+|Sec(?:tion|\.)?)\s*(?P<section>\d+[a-zA-Z0-9\-\.\(\)]*)")

# Month names, and dates in their order of preference.
MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
DATES = [
    re.compile(rf"\b(?P<day>\d{{1,2}})(?:st|nd|rd|th)?\s+day\s+of\s+(?P<month>{MONTHS})[\.,\s]+(?P<year>\d{{4}})\b", re.IGNORECASE),
    re.compile(rf"\b(?P<month>{MONTHS})[\.,\s]+(?P<day>\d{{1,2}})(?:st|nd|rd|th)?[\.,\s]+(?P<year>\d{{4}})\b", re.IGNORECASE),
    re.compile(rf"\b(?P<day>\d{{1,2}})[\.,\s]+(?P<month>{MONTHS})[\.,\s]+(?P<year>\d{{4}})\b", re.IGNORECASE),
    re.compile(r"\b(?P<year>\d{4})-(?P<month>\d{2})-(?P<day>\d{2})\b"),
    re.compile(r"\b(?P<month>\d{1,2})/(?P<day>\d{1,2})/(?P<year>\d{4})\b"),
]

# Docket numbers, and prefixes that aren't part of them.
DOCKETS = [
    re.compile(r"\b(?:(?:Case|Civil Action|Docket|Misc\.)\s+)?(?:No\.|#)?\s*(?P<docket>\d{1,2}:\d{2}-(?:cv|cr|mc|md|bk|ap)-\d{4,7}(?:-[A-Za-z0-9]+)?)\b", re.IGNORECASE),
    re.compile(
        r"\b(?:Case|Civil Action|Docket|Civil|Criminal)\s+(?:No\.|#)\s*(?P<docket>[A-Za-z0-9]{1,4}[-–][A-Za-z0-9]{2,6}[-–][A-Za-z0-9]{2,7}|[0-9]{2,4}[-–][A-Za-z]{2,4}[-–][0-9]{3,6}|[0-9]{2,4}[-–][0-9]{4,7})\b",
        re.IGNORECASE,
    ),
    re.compile(r"\bNo\.\s*(?P<docket>[0-9]{2,4}-[A-Z]{2,4}-[0-9]{3,6}|[0-9]{2,4}-[0-9]{4,7})\b", re.IGNORECASE),
]
DOCKET_PREFIX = re.compile(r"^(?:Case|Civil Action|Docket|Misc\.|Civil|Criminal|No\.|#|\s)+", re.IGNORECASE)

# References to sections, articles and clauses.
SECTIONS = [
    re.compile(r"(?:^|[\s\(\[\{,;])(?P<prefix>§+)\s*(?P<num>\d+[a-zA-Z0-9\-\.\(\)]*)", re.IGNORECASE),
    re.compile(r"\b(?P<prefix>Sec(?:tion|\.)?)\s*(?P<num>\d+[a-zA-Z0-9\-\.\(\)]*)", re.IGNORECASE),
    re.compile(r"\b(?P<prefix>Article|Art\.)\s*(?P<num>[IVXLCDM\d]+[a-zA-Z0-9\-\.\(\)]*)", re.IGNORECASE),
    re.compile(r"\b(?P<prefix>Clause|Cl\.)\s*(?P<num>\d+[a-zA-Z0-9\-\.\(\)]*)", re.IGNORECASE),
]

# Exhibits, and the parties that offer them.
EXHIBIT = re.compile(r"\b(?P<party>Plaintiff\'s|Defendant\'s|Pl\.|Def\.|Trial|Joint)?\s*(?:Exhibit|Ex\.)\s*(?P<label>[A-Za-z0-9]+(?:[\-\.][A-Za-z0-9]+)?)", re.IGNORECASE)
PARTIES = [("pl", "Plaintiff"), ("def", "Defendant"), ("trial", "Trial"), ("joint", "Joint")]

# Filing types, the more special ones first, as (name, pattern).
FILINGS = [
    ("Motion for Summary Judgment", r"\b(?:Plaintiff\'s|Defendant\'s|Joint)?\s*(?:Cross-)?Motion\s+for\s+Summary\s+Judg?ment\b"),
    ("Motion to Dismiss", r"\b(?:Plaintiff\'s|Defendant\'s)?\s*Motion\s+to\s+Dismiss(?:\s+the\s+Complaint)?\b"),
    ("Amended Complaint", r"\b(?:First|Second|Third|Fourth)?\s*Amended\s+(?:Class\s+Action\s+)?Complaint\b"),
    ("Complaint", r"\b(?:Class\s+Action\s+)?Complaint(?:\s+for\s+[A-Za-z\s]+)?\b"),
    ("Answer", r"\bAnswer(?:\s+and\s+Affirmative\s+Defenses)?(?:\s+to\s+Complaint)?\b"),
    ("Memorandum of Law", r"\bMemorandum\s+of\s+Law\s+(?:in\s+Support|in\s+Opposition)?\b"),
    ("Brief", r"\b(?:Brief\s+in\s+Support|Brief\s+in\s+Opposition|Reply\s+Brief|Amicus\s+Brief)\b"),
    ("Order", r"\b(?:Court\s+)?Order\s+(?:Granting|Denying|Directing|Dismissing|Scheduling|STIPULATED)?\b"),
    ("Judgment", r"\b(?:Final\s+|Consent\s+|Summary\s+)?Judg?ment\b"),
    ("Declaration", r"\bDeclaration\s+of\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"),
    ("Affidavit", r"\bAffidavit\s+(?:of\s+[A-Z][a-z]+)?\b"),
    ("Notice of Appeal", r"\bNotice\s+of\s+Appeal\b"),
    ("Notice of Motion/Filing", r"\bNotice\s+of\s+(?:Motion|Filing|Appearance)\b"),
    ("Subpoena", r"\bSubpoena(?:\s+Duces\s+Tecum)?\b"),
    ("Stipulation", r"\bStipulation(?:\s+and\s+Order)?\b"),
    ("Petition", r"\bPetition(?:\s+for\s+Writ\s+of\s+[A-Za-z]+)?\b"),
    ("Motion", r"\b(?:Emergency\s+)?Motion\s+(?:to\s+[A-Za-z]+|for\s+[A-Za-z\s]+)\b"),
]

# Courts, as (name, pattern).
COURTS = [
    ("Supreme Court of the United States", r"\b(?:Supreme\s+Court\s+of\s+the\s+United\s+States|United\s+States\s+Supreme\s+Court|U\.?\s*S\.?\s*Supreme\s+Court|U\.?\s*S\.?\s*Sup\.?\s*Ct\.?|SCOTUS)\b"),
    ("United States Court of Appeals for the D.C. Circuit", r"\b(?:United\s+States\s+Court\s+of\s+Appeals\s+for\s+the\s+D\.?C\.?\s*Circuit|D\.?C\.?\s*Circuit(?:\s+Court\s+of\s+Appeals)?|D\.?C\.?\s*Cir\.?)\b"),
    ("United States Court of Appeals for the Federal Circuit", r"\b(?:United\s+States\s+Court\s+of\s+Appeals\s+for\s+the\s+Federal\s+Circuit|Federal\s+Circuit(?:\s+Court\s+of\s+Appeals)?|Fed\.?\s*Cir\.?)\b"),
    ("United States District Court for the Southern District of New York", r"\b(?:United\s+States\s+District\s+Court\s+(?:for\s+the\s+)?Southern\s+District\s+of\s+New\s+York|U\.?\s*S\.?\s*Dist\.?\s*Ct\.?,?\s*S\.?\s*D\.?\s*N\.?\s*Y\.?|S\.?\s*D\.?\s*N\.?\s*Y\.?)\b"),
    ("United States District Court for the Eastern District of New York", r"\b(?:United\s+States\s+District\s+Court\s+(?:for\s+the\s+)?Eastern\s+District\s+of\s+New\s+York|E\.?\s*D\.?\s*N\.?\s*Y\.?)\b"),
    ("United States District Court for the Northern District of California", r"\b(?:United\s+States\s+District\s+Court\s+(?:for\s+the\s+)?Northern\s+District\s+of\s+California|N\.?\s*D\.?\s*Cal\.?)\b"),
    ("United States District Court for the Central District of California", r"\b(?:United\s+States\s+District\s+Court\s+(?:for\s+the\s+)?Central\s+District\s+of\s+California|C\.?\s*D\.?\s*Cal\.?)\b"),
    ("United States District Court for the Southern District of Texas", r"\b(?:United\s+States\s+District\s+Court\s+(?:for\s+the\s+)?Southern\s+District\s+of\s+Texas|S\.?\s*D\.?\s*Tex\.?)\b"),
    ("United States District Court for the Eastern District of Texas", r"\b(?:United\s+States\s+District\s+Court\s+(?:for\s+the\s+)?Eastern\s+District\s+of\s+Texas|E\.?\s*D\.?\s*Tex\.?)\b"),
    ("United States District Court for the District of Delaware", r"\b(?:United\s+States\s+District\s+Court\s+(?:for\s+the\s+)?District\s+of\s+Delaware|D\.?\s*Del\.?)\b"),
    ("United States District Court for the District of Columbia", r"\b(?:United\s+States\s+District\s+Court\s+(?:for\s+the\s+)?District\s+of\s+Columbia|D\.?\s*D\.?\s*C\.?)\b"),
    ("United States District Court", r"\bUnited\s+States\s+District\s+Court(?:\s+for\s+the\s+[A-Za-z\s]+District\s+of\s+[A-Za-z\s]+)?\b"),
    ("Supreme Court of California", r"\b(?:Supreme\s+Court\s+of\s+California|California\s+Supreme\s+Court|Cal\.?\s*Supreme\s+Court)\b"),
    ("Supreme Court of Texas", r"\b(?:Supreme\s+Court\s+of\s+Texas|Texas\s+Supreme\s+Court|Tex\.?\s*Supreme\s+Court)\b"),
    ("New York Court of Appeals", r"\b(?:New\s+York\s+Court\s+of\s+Appeals|N\.?\s*Y\.?\s*Court\s+of\s+Appeals)\b"),
]
# Numbered circuits, by ordinal.
CIRCUITS = ["First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth", "Eleventh"]
ORDINALS = ["1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th", "9th", "10th", "11th"]
CIRCUIT = re.compile(rf"\b(?:United\s+States\s+Court\s+of\s+Appeals\s+for\s+the\s+)?(?P<num>{'|'.join(ORDINALS + CIRCUITS)})\s+(?:Circuit(?:\s+Court\s+of\s+Appeals)?|Cir\.?)\b", re.IGNORECASE)

MONTH_NUMBER = {m.lower()[:3]: i + 1 for i, m in enumerate("January February March April May June July August September October November December".split())}
NAMED_CIRCUIT = {k.lower(): name for k, name in zip(ORDINALS + CIRCUITS, CIRCUITS * 2, strict=True)}

# Cues of patterns. Whatever a pattern matches holds one of its cues, once both are squeezed: lower case, without
# blanks and full stops. A search for a few strings is many times cheaper than a pattern that finds nothing.
FILING_CUES = {
    "Motion for Summary Judgment": ["motionforsummaryjud"],
    "Motion to Dismiss": ["motiontodismiss"],
    "Amended Complaint": ["complaint"],
    "Complaint": ["complaint"],
    "Answer": ["answer"],
    "Memorandum of Law": ["memorandumoflaw"],
    "Brief": ["brief"],
    "Order": ["order"],
    "Judgment": ["judgment", "judment"],
    "Declaration": ["declarationof"],
    "Affidavit": ["affidavit"],
    "Notice of Appeal": ["noticeofappeal"],
    "Notice of Motion/Filing": ["noticeof"],
    "Subpoena": ["subpoena"],
    "Stipulation": ["stipulation"],
    "Petition": ["petition"],
    "Motion": ["motionto", "motionfor"],
}
COURT_CUES = {
    "Supreme Court of the United States": ["supremecourtoftheunitedstates", "unitedstatessupremecourt", "ussupremecourt", "ussupct", "scotus"],
    "United States Court of Appeals for the D.C. Circuit": ["dccir"],
    "United States Court of Appeals for the Federal Circuit": ["federalcircuit", "fedcir"],
    "United States District Court for the Southern District of New York": ["southerndistrictofnewyork", "sdny"],
    "United States District Court for the Eastern District of New York": ["easterndistrictofnewyork", "edny"],
    "United States District Court for the Northern District of California": ["northerndistrictofcalifornia", "ndcal"],
    "United States District Court for the Central District of California": ["centraldistrictofcalifornia", "cdcal"],
    "United States District Court for the Southern District of Texas": ["southerndistrictoftexas", "sdtex"],
    "United States District Court for the Eastern District of Texas": ["easterndistrictoftexas", "edtex"],
    "United States District Court for the District of Delaware": ["districtofdelaware", "ddel"],
    "United States District Court for the District of Columbia": ["districtofcolumbia", "ddc"],
    "United States District Court": ["unitedstatesdistrictcourt"],
    "Supreme Court of California": ["supremecourtofcalifornia", "californiasupremecourt", "calsupremecourt"],
    "Supreme Court of Texas": ["supremecourtoftexas", "texassupremecourt", "texsupremecourt"],
    "New York Court of Appeals": ["newyorkcourtofappeals", "nycourtofappeals"],
}
FILING_PATTERNS = [(name, re.compile(p, re.IGNORECASE)) for name, p in FILINGS]
COURT_PATTERNS = [(name, re.compile(p, re.IGNORECASE)) for name, p in COURTS]
#: By the text of a pattern.
CUES: dict[str, tuple[str, ...]] = {
    p.pattern: tuple(cues)
    for p, cues in [
        (ID_CITATION, ["id"]),
        (SUPRA_CITATION, ["supra"]),
        (FEDERAL, ["usc", "cfr"]),
        (STATE, [code + sign for code in ("stat", "code", "law", "act", "regs") for sign in ("§", "sec")]),
        (DATES[0], ["dayof"]),
        *[(p, list(MONTH_NUMBER)) for p in DATES[1:3]],
        (DATES[3], ["-"]),
        (DATES[4], ["/"]),
        (DOCKETS[0], [f"-{kind}-" for kind in ("cv", "cr", "mc", "md", "bk", "ap")]),
        (DOCKETS[1], [kind + no for kind in ("case", "action", "docket", "civil", "criminal") for no in ("no", "#")]),
        (DOCKETS[2], ["no"]),
        (SECTIONS[0], ["§"]),
        (SECTIONS[1], ["sec"]),
        (SECTIONS[2], ["art"]),
        (SECTIONS[3], ["cl"]),
        (EXHIBIT, ["ex"]),
        (CIRCUIT, ["cir"]),
        *[(p, FILING_CUES[name]) for name, p in FILING_PATTERNS],
        *[(p, COURT_CUES[name]) for name, p in COURT_PATTERNS],
    ]
}

#: Letters beyond ASCII that stand for one of ASCII where case is ignored.
ODD = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))


def squeezed(text: str) -> str:
    """Lower case, without blanks and full stops: what cues are looked for in."""
    for odd, plain in ODD:
        if odd in text:
            text = text.replace(odd, plain)
    return "".join(text.lower().split()).replace(".", "")


def matches(pattern: re.Pattern, text: str, held: str) -> Iterator[re.Match]:
    """All matches in a text; held: it squeezed. Without one of the pattern's cues in it there are none."""
    cues = CUES.get(pattern.pattern)
    if cues is not None:
        for cue in cues:
            if cue in held:
                break
        else:
            return iter(())
    return pattern.finditer(text)


@dataclass(slots=True)
class Found:
    start: int
    end: int
    original: str
    normalized: str
    entity_type: str
    rule: str
    confidence: float
    snippet: str


@dataclass
class Page:
    number: int
    raw: str | None
    normalized: str | None
    blocks: list[dict] = field(default_factory=list)

    @property
    def text(self) -> str:
        return self.raw or self.normalized or ""

    @cached_property
    def held(self) -> str:
        return squeezed(self.text)


@dataclass
class Document:
    title: str | None
    pages: list[Page]


def crosses(span: Span, accepted: list[Span]) -> bool:
    """Whether a span begins or ends inside an accepted one."""
    a, b = span
    return any(s <= a < e or s < b <= e for s, e in accepted)


def around(text: str, a: int, b: int, margin: int) -> str:
    return text[max(0, a - margin) : b + margin].replace("\n", " ").strip()


#: Reads a match: (start, end, original, normalised), or None where it is no hit.
Reader = Callable[[re.Match, str], tuple[int, int, str, str] | None]


def by_patterns(document: Document, patterns: list[tuple[re.Pattern, Reader, str, str, float]], margin: int = 30) -> Iterator[tuple[int, Found]]:
    """The common form of most families: patterns in order over every page that isn't blank."""
    for page in document.pages:
        text, accepted = page.text, []
        if not text.strip():
            continue
        for pattern, read, entity_type, rule, confidence in patterns:
            for match in matches(pattern, text, page.held):
                hit = read(match, text)
                if hit is None or crosses(hit[:2], accepted):
                    continue
                a, b, original, normalized = hit
                accepted.append((a, b))
                yield page.number, Found(a, b, original, normalized, entity_type, rule, confidence, around(text, a, b, margin))


def _whole(name: Callable[[re.Match], str | None]) -> Reader:
    def read(match: re.Match, text: str) -> tuple[int, int, str, str] | None:
        value = name(match)
        return None if value is None else (*match.span(), match[0].strip(), value)

    return read


def case_citations(document: Document) -> Iterator[tuple[int, Found]]:
    """Full citations and, for a case cited before, short ones (at a page of the reporter), id. and supra, which stand as they
    are written."""

    def name(m: re.Match) -> str:
        return f"{m[1]} {REPORTER_NAME[''.join(m[2].split())]} {m[3]}"

    written = lambda m: m[0]
    forms = [(CASE_CITATION, name, ""), (SHORT_CITATION, name, "_short"), (ID_CITATION, written, "_id"), (SUPRA_CITATION, written, "_supra")]
    return by_patterns(document, [(p, _whole(read), "CASE", f"case_citation_pattern{form}", 0.95) for p, read, form in forms], 40)


def _without_stop(match: re.Match, section: str) -> tuple[int, int, str]:
    """A match without punctuation at its end that isn't part of the section."""
    a, b, raw = *match.span(), match[0]
    if raw[-1] in ".,;:" and not section.endswith(raw[-1]):
        raw = raw.rstrip(".,;:")
        b = a + len(raw)
    return a, b, raw


def statutes(document: Document) -> Iterator[tuple[int, Found]]:
    """Federal statutes and regulations of a page, then state statutes that overlap nothing found so far, on any page."""
    seen: list[Span] = []
    for page in document.pages:
        text = page.text
        if not text.strip():
            continue
        for pattern in (FEDERAL, STATE):
            for match in matches(pattern, text, page.held):
                a, b = match.span()
                if pattern is STATE and any(not (b <= s or a >= e) for s, e in seen):
                    continue
                section = match["section"].rstrip(".,;:)")
                if not section:
                    continue
                a, b, raw = _without_stop(match, section)
                if pattern is STATE:
                    kind, rule, confidence, code = "STATUTE", "state_statute_pattern", 0.90, match["code"].strip()
                    value = f"{code} § {section}"
                else:
                    regulation = "CFR" in match["code"].upper().replace(" ", "").replace(".", "")
                    kind, rule, confidence = "REGULATION" if regulation else "STATUTE", "usc_cfr_statute_pattern", 0.98
                    value = f"{match['title']} {'C.F.R.' if regulation else 'U.S.C.'} § {section}"
                seen.append((a, b))
                yield page.number, Found(a, b, raw, value, kind, rule, confidence, around(text, a, b, 40))


def iso_date(match: re.Match) -> str | None:
    month = match["month"]
    try:
        found = date(int(match["year"]), int(month) if month.isdigit() else MONTH_NUMBER[month.lower()[:3]], int(match["day"]))
    except ValueError:
        return None
    return found.isoformat() if 1800 <= found.year <= 2100 else None


def dates(document: Document) -> Iterator[tuple[int, Found]]:
    return by_patterns(document, [(p, _whole(iso_date), "DATE", "legal_date_pattern", 0.96) for p in DATES])


def docket_numbers(document: Document) -> Iterator[tuple[int, Found]]:
    name = lambda m: DOCKET_PREFIX.sub("", m["docket"].strip()).strip().replace("–", "-").upper()
    return by_patterns(document, [(p, _whole(name), "CASE", "docket_pattern", 0.97) for p in DOCKETS])


def sections(document: Document) -> Iterator[tuple[int, Found]]:
    def read(match: re.Match, text: str) -> tuple[int, int, str, str] | None:
        number = match["num"].rstrip(".,;:")
        if not number:
            return None
        a, b = match.start("prefix"), match.end()
        if match[0][-1] in ".,;:" and not number.endswith(match[0][-1]):
            b -= len(match["num"]) - len(number)
        prefix = match["prefix"].lower()
        kind = "Article" if "art" in prefix else "Clause" if "cl" in prefix else "Section"
        return a, b, text[a:b].strip(), f"{kind} {number}"

    return by_patterns(document, [(p, read, "DOCUMENT", "section_article_clause_pattern", 0.92) for p in SECTIONS])


def exhibits(document: Document) -> Iterator[tuple[int, Found]]:
    def name(m: re.Match) -> str:
        party = next((f" ({n})" for k, n in PARTIES if k in (m["party"] or "").lower()), "")
        return f"Exhibit {m['label'].upper()}{party}"

    return by_patterns(document, [(EXHIBIT, _whole(name), "EXHIBIT", "exhibit_designation_pattern", 0.96)])


def filing_types(document: Document) -> Iterator[tuple[int, Found]]:
    """The title's first type; types in headings; in the first 1500 characters of page 1 only if page 1 had none."""
    if document.title:
        held = squeezed(document.title)
        hit = next(((n, m) for n, p in FILING_PATTERNS if (m := next(matches(p, document.title, held), None))), None)
        if hit:
            name, m = hit
            yield 1, Found(*m.span(), m[0], name, "FILING", "document_metadata_title_filing_vocab", 0.99, f"Document Metadata Title: {document.title}")
    by_page: dict[int, list[Span]] = {}
    on_first = False
    for page in document.pages:
        accepted = by_page.setdefault(page.number, [])
        places = [(b["raw_text"] or b["normalized_text"] or "", "heading_filing_vocab", 0.95) for b in page.blocks if b["block_type"] in ("HEADING", "HEADER") or b["level"] == 1]
        for caption in (False, True):
            if caption:
                if page.number != 1 or on_first:
                    break
                places = [(page.text[:1500], "page1_caption_filing_vocab", 0.90)]
            for text, rule, confidence in places:
                held = squeezed(text)
                for name, pattern in FILING_PATTERNS:
                    for m in matches(pattern, text, held):
                        if crosses(m.span(), accepted):
                            continue
                        accepted.append(m.span())
                        on_first = on_first or page.number == 1
                        yield page.number, Found(*m.span(), m[0], name, "FILING", rule, confidence, around(text, *m.span(), 20) if caption else text.strip())


def courts(document: Document) -> Iterator[tuple[int, Found]]:
    return by_patterns(document, COURT_READERS)


COURT_READERS = [
    *[(p, _whole(lambda m, n=name: n), "COURT", "controlled_court_pattern", 0.96) for name, p in COURT_PATTERNS],
    (CIRCUIT, _whole(lambda m: f"United States Court of Appeals for the {NAMED_CIRCUIT[m['num'].lower()]} Circuit"), "COURT", "numbered_circuit_court_pattern", 0.97),
]


#: Category -> family, in the order in which results are listed. More families may be registered.
EXTRACTORS: dict[str, Callable[[Document], Iterator[tuple[int, Found]]]] = {
    "case_citation": case_citations,
    "statutory_citation": statutes,
    "date": dates,
    "docket_number": docket_numbers,
    "section_reference": sections,
    "exhibit": exhibits,
    "filing_type": filing_types,
    "court_name": courts,
}

CANDIDATES = pa.schema(
    [("document_id", pa.string()), ("case_id", pa.string()), ("category", pa.string()), ("pos", pa.int64()), ("page_number", pa.int32()), ("entity_type", pa.string()), ("rule_name", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]
    + [(c, pa.string()) for c in ("original_value", "normalized_value", "source_text")]
)
CANDIDATES_DDL = "document_id string, case_id string, category string, pos long, page_number int, entity_type string, rule_name string, confidence double, start int, end int, original_value string, normalized_value string, source_text string"


def extract(documents: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Candidates of all families, or of some. documents: document_id, case_id, title, pages (array of page_number, raw_text,
    normalized_text, blocks (array of block_type, level, raw_text, normalized_text)). A family that fails on a document
    gives that document no candidates of its category, and a warning in the task's log; the others go on."""
    ship(documents.sparkSession)
    chosen = categories or list(EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d in batch.to_pylist():
                doc = Document(d["title"], [Page(p["page_number"], p["raw_text"], p["normalized_text"], p["blocks"] or []) for p in d["pages"] or []])
                pos = 0
                for category in chosen:
                    try:
                        found = list(EXTRACTORS[category](doc))
                    except Exception as e:  # noqa: BLE001  whatever fails in a family, the others go on
                        log.warning("%s failed on document %s: %r", category, d["document_id"], e)
                        found = []
                    for page, f in found:
                        out.append((d["document_id"], d["case_id"], category, pos, page, f.entity_type, f.rule, f.confidence, f.start, f.end, f.original, f.normalized, f.snippet))
                        pos += 1
            columns = zip(*out, strict=True) if out else [()] * len(CANDIDATES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CANDIDATES.types, strict=True)], schema=CANDIDATES)

    return documents.select("document_id", "case_id", "title", "pages").mapInArrow(run, CANDIDATES_DDL)


def summary_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("document_id", "category").agg(F.count(F.lit(1)).alias("n"))
