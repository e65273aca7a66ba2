"""Facts, dates and candidate rules against stated cases."""

from datetime import date

import pytest

from jobloom.functions import dates, extract
from jobloom.plans import fixtures


@pytest.mark.parametrize("text,want", fixtures.DATE_TEXTS)
def test_deadline(text, want):
    assert dates.deadline(text) == want


@pytest.mark.parametrize(
    "text,want",
    [("2026-10-15", (2026, 10, 15)), ("15.10.2026.", (2026, 10, 15)), ("1 October 2026", (2026, 10, 1)), ("October 1st, 2026", (2026, 10, 1)), ("3-Nov-2026", (2026, 11, 3)),
     ("99.99.2026", None), ("soon", None), ("Thursday, 07 November 2024", (2024, 11, 7)), ("June 5, 2026", (2026, 6, 5)), ("July 1, 2026", (2026, 7, 1)), ("Sept 30, 2026", (2026, 9, 30)), ("3 2026", None)],
)
def test_parse_date(text, want):
    found = dates.parse_date(text)
    assert (found and (found.year, found.month, found.day)) == want


def test_published():
    assert dates.published("Data pubblicazione: 28 Aprile 2026") == date(2026, 4, 28)


#: id of the advert -> the facts that it states
STATED = {
    1: {"level": "bachelor", "years": 6, "required": ["en"], "licence": "required", "grade": "S3"},
    2: {"levels": ["bachelor", "master"], "years": 2, "fields": {"law", "social", "political", "human_rights"}, "required": ["en", "bcs"]},
    3: {"years": 5, "level": "bachelor", "fields": {"engineering"}},
    4: {"level": "bachelor", "fields": {"law", "economics"}, "years": 3, "required": ["en"], "desirable": ["de"], "licence": "required", "work_time": "full", "duration": "12 mjeseci", "salary": "2.400 KM neto mjesečno"},
    5: {"level": "secondary", "years": 5},
    6: {"duration": "October 2026 - December 2026", "levels": [], "fields": set(), "years": None, "required": [], "desirable": [], "licence": None, "citizenship": None, "remote": None, "work_time": None, "salary": None, "grade": None},
    7: {"years": None, "salary": None},
    8: {"required": ["en"], "desirable": ["de"]},
    9: {"levels": ["junior_college"], "years": 4},
    10: {"level": "junior_college"}, 11: {"level": "junior_college"}, 12: {"level": "junior_college"}, 13: {"level": "junior_college"}, 14: {"levels": ["junior_college"]},
    15: {"levels": ["secondary", "junior_college"]}, 16: {"level": "bachelor"}, 17: {"level": None, "levels": []},
    18: {"citizenship": "eu", "required": ["en"], "desirable": ["bcs"]},
    19: {"level": None, "levels": [], "quotes": {}},
}


def test_requirements(spark):
    got = {r.id: r for r in extract.requirements(fixtures.adverts(spark)).collect()}
    for i, facts in STATED.items():
        found = {k: set(got[i][k]) if isinstance(v, set) else got[i][k] for k, v in facts.items()}
        assert found == facts, i
    assert "Fluency in English" in got[2].quotes["languages"]
    assert all(q.removesuffix(" …") in " ".join(t.split()) for i, _, t in fixtures.ADVERTS if t for k, quotes in got[i].quotes.items() for q in quotes.split(" … "))


@pytest.mark.parametrize(
    "text,want",
    [("Five years of experience, of which at least two years of experience as a manager.", 5), ("In the last 3 years we grew.", None), ("Experience: minimum 4 years.", 4), ("A contract of 2 years.", None),
     ("No prior experience is required.", 0), ("Bez radnog iskustva.", 0), ("Experience: up to 3 years.", None)],
)
def test_years(text, want):
    assert extract.facts("", text).get("years") == want


@pytest.mark.parametrize(
    "text,want",
    [("Salary: EUR 1,890.00 per month", "EUR 1,890.00 per month"), ("Naknada 30 000 - 40 000 EUR godišnje.", "30 000 - 40 000 EUR godišnje"), ("Salary in 2026 EUR", None), ("Fee: 50 EUR", None), ("Costs 3000 EUR", None)],
)
def test_pay(text, want):
    assert extract.facts("", text).get("salary") == want


@pytest.mark.parametrize("title,text,want", [("Officer (P3)", "", "P3"), ("Clerk", "Grade: LCH-6", "LCH-6"), ("Driver", "Licence B and D1", "D1"), ("Expert NOB", "", "NOB"), ("Clerk", "level: XY 4", "XY4"), ("Clerk", "S3 road", None)])
def test_grade(title, text, want):
    assert extract.facts(title, text).get("grade") == want


def test_cities(spark):
    cases = [
        ("Embassy in Sarajevo. Vacancy: Driver. Duty station: Banja Luka office", "Banja Luka"), ("Location: Banjaluka", "Banja Luka"), ("Brcko District of BiH", "Brčko"), ("Field office Bihac", "Bihać"),
        ("Mjesto rada: Goražde", "Goražde"), ("Duty Station : Tuzla", "Tuzla"), ("Mjesto rada: u Sarajevu", "Sarajevo"), ("Radno mjesto u Banjoj Luci", "Banja Luka"), ("Kancelarija u Mostaru", "Mostar"), ("Paris", ""),
    ]
    df = spark.createDataFrame(cases, "text string, want string")
    assert [r.text for r in df.withColumn("got", extract.city(df["text"])).where("got != want").collect()] == []


def test_scopes(spark):
    cases = [
        ("Project Associate", "Agency: UNDP. Grade: NPSA-9. Vacancy Type: National Personnel Service Agreement.", "national"), ("Chief, General Services (S3)", "", "international"),
        ("Purchasing Administrator", "Post no. CL FIN 0056 Grade: LCH-6", "national"), ("Senior Project Officer", "Recruitment type: External recruitment (international)", "international"),
        ("Driver", "Licence categories B and D1 required.", ""), ("Programme Officer (P3 / NOC)", "", ""), ("Programme Associate", "Applicant(s) must be citizens of Bosnia and Herzegovina.", ""),
        ("Finance Assistant, GS-5", "National(s) of Bosnia and Herzegovina only.", "national"), ("Project Assistant, SB-3", "", "national"), ("VA26P127V01 - Project Management Assistant - LS2", "", "national"),
        ("VA26P172V01 Senior Project Manager (IP4)", "", "international"), ("Programme Associate", "Contract type: Service Contract, SC-7.", "national"),
    ]
    df = spark.createDataFrame(cases, "title string, text string, want string")
    assert [(r.title, r.got) for r in df.withColumn("got", extract.scope(df["title"], df["text"])).where("got != want").collect()] == []


def test_types(spark):
    cases = [("Family Law and Legal Reform Expert, National Consultant,NOC, Sarajevo, BIH", "consultancy"), ("Project Associate [Open to internal and external applicants]", "employment"), ("PSP Fundraising Intern", "paid_internship"),
             ("Plaćena praksa u Ambasadi", "paid_internship"), ("Senior Guard", "employment")]
    df = spark.createDataFrame(cases, "title string, want string")
    assert [(r.title, r.got) for r in df.withColumn("got", extract.opportunity_type(df["title"])).where("got != want").collect()] == []


def test_candidates(spark):
    got = {r.id: r for r in extract.candidates(fixtures.leads(spark), fixtures.TODAY, 2026).collect()}
    assert got[1].eligible and got[1].year_proven and got[1].city == "Sarajevo" and got[1].reason == ""
    assert not got[2].eligible and got[2].reason == "excluded kind" and not got[2].year_proven and got[2].in_scope_year
    assert got[3].type == "consultancy" and got[3].scope == "national" and got[3].reason == "deadline has passed" and got[3].city == "Banja Luka"
    assert got[4].scope == "" and "another country" in got[4].reason
    assert got[5].reason == "not an advert; no location in the country; no deadline"
    assert got[6].in_scope_year and not got[6].year_proven and not got[7].in_scope_year and not got[7].year_proven


def test_labelled_stations(spark):
    """A text that labels its duty station is in that place, though by chance another word looks like a town's name."""
    texts = [(1, "doó doboja esie. Duty station: Vienna. Vacancy"), (2, "doboja. Duty station: Mostar, Bosnia and Herzegovina. Vacancy"), (3, "Position in Doboj. Vacancy")]
    leads = spark.createDataFrame([(i, "https://x.org", "Vacancy", x) for i, x in texts], "id long, url string, title string, text string")
    got = {r.id: (r.city, r.reason) for r in extract.candidates(leads, fixtures.TODAY, 2026, labelled=True).collect()}
    assert got == {1: ("", "no location in the country; no deadline"), 2: ("Mostar", "no deadline"), 3: ("Doboj", "no deadline")}
    assert {r.id: r.city for r in extract.candidates(leads, fixtures.TODAY, 2026).collect()} == {1: "Doboj", 2: "Mostar", 3: "Doboj"}


def test_plain_words_are_passed_over(monkeypatch):
    """Of words parted by single spaces none is looked at as the end of a sentence, but before figures; stops, bullets and numbered items still end one."""
    asked, ends = [], extract.Advert.ends
    monkeypatch.setattr(extract.Advert, "ends", lambda self, k: asked.append(k) or ends(self, k))
    text = "word " * 500 + "last. Next 2. Item here•Other"
    assert extract.Advert(text).sentences == [(0, 501), (501, 502), (502, 503), (503, 505), (505, 506)] and len(asked) < 6
