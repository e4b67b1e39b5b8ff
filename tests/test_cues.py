import random

from kgspark.functions import extract

SAMPLES = """S.D.N.Y. | s d n y | N.D. Cal. | U.S. Sup. Ct. | SCOTUS | United  States\nSupreme Court | D.C. Cir. | Fed. Cir. | Ninth Circuit | 2nd Cir. | E. D. Tex. | D. Del. | D.D.C. | Cal Supreme Court
N.Y. Court of Appeals | United States District Court for the Middle District of Florida | Motion to Dismiss | Cross-Motion for Summary Judment | Class Action Complaint for damages | Reply Brief | Order Granting
Declaration of Ann Roe | Notice of Filing | Stipulation and Order | Petition for Writ of Mandamus | 42 u.s.c. § 1983 | 29 C. F. R. 1630 | Penal Code § 12 | Tex. Stat. Sec. 4 | 5th day of May, 2020 | Sept. 4, 2021 | 4 June 2019
2020-02-29 | 1/2/2020 | Case No. 1:24-cv-10000 | Docket # 20-cv-12345 | No. 20-1234 | § 12(a) | Sec. 4 | Art. IV | Cl. 7 | Pl. Ex. 4 | Exhibit B-1 | 410 U.S. 113 | 1 F. Supp.3d 5 | 410 U.S., at 115 | Id. | supra,
ſCOTUſ | Ninth Cİrcuıt | 4 UſC 5 | oſſ Kne""".replace("\n", " | ", 3).split(" | ")


def documents():
    rng = random.Random(5)
    for _ in range(400):
        parts = [rng.choice(SAMPLES) for _ in range(rng.randrange(1, 6))]
        parts = [rng.choice([str, str.upper, str.lower])(p) if rng.random() < 0.4 else p for p in parts]
        text = rng.choice([" ", ", ", " and "]).join(parts)
        heading = {"block_type": "HEADING", "level": 2, "raw_text": rng.choice(SAMPLES), "normalized_text": None}
        yield extract.Document(rng.choice([None, text]), [extract.Page(1, text, None, [heading] if rng.random() < 0.3 else []), extract.Page(2, rng.choice(SAMPLES), None)])


def test_cues_lose_no_match(monkeypatch):
    read = lambda: [list(family(d)) for d in documents() for family in extract.EXTRACTORS.values()]
    got = read()
    monkeypatch.setattr(extract, "CUES", {})
    want = read()
    assert got == want
    assert len({f.rule for x in want for _, f in x}) > 12


def test_patterns_without_a_cue_in_the_text_are_not_run():
    tried = [p for _, p in extract.COURT_PATTERNS if next(extract.matches(p, "S.D.N.Y.", extract.squeezed("S.D.N.Y.")), None) is not None]
    assert len(tried) == 1
    assert all(p.pattern in extract.CUES for _, p in extract.COURT_PATTERNS + extract.FILING_PATTERNS)
