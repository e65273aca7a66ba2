"""Small tables that the queries on adverts use: the given tables have no adverts."""

from __future__ import annotations

import hashlib
import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession

TODAY = date(2026, 10, 2)
TEXT = "Project Officer in Sarajevo. Apply by 20 October 2026."
HASH = hashlib.sha256(TEXT.encode()).hexdigest()


def profiles(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "urgent help", "NATION_1", True, "BUILDING", "f1", "master", 5, ["en", "bs"], False, False, False),
        (2, "", "nation_2", False, "MACHINERY", "", "", None, None, True, False, False),
    ]
    return spark.createDataFrame(
        rows,
        "user_id long, want_role string, want_city string, want_remote boolean, want_type string, want_field string, want_education string, want_experience int, "
        "want_languages array<string>, must_city boolean, must_remote boolean, must_type boolean",
    )


#: Adverts whose facts are stated in the tests.
ADVERTS = [
    (1, "Chief, General Services (S3)", "Level of Professional Competence Requirements Furthermore, this level of responsibility requires the following: Education: Second-level university degree degree; "
     "Certified training course in a relevant field desirable. A first-level university degree in combination with two years of additional qualifying experience may be "
     "accepted in lieu of the second-level university degree. Experience: Minimum 6 years (8 years with a relevant first-level degree) of relevant, diversified and "
     "progressively responsible professional experience including at least 3 years at the management level relevant to the actual position. Professional fluency in English "
     "with excellent communication skills; Holding a valid driving license. Desirable: Field experience with the OSCE."),
    (2, "Project Coordinator", "Required Skills and Experience Education: Advanced university degree (Master's degree or equivalent) in Law, Social Sciences, International Relations, Human Rights "
     "or any other related field is required; OR A first-level university degree (bachelor's degree) in the areas mentioned above, in combination with an additional two "
     "years of qualifying work experience, will be given due consideration in lieu of the advanced university degree. Experience: Minimum two years (with Master´s degree) or "
     "four years (with Bachelor´s degree) of proven project management experience. Languages: Fluency in English and any official languages of Bosnia and Herzegovina "
     "(Bosnian/Croatian or Serbian) is required."),
    (3, "Electrical Engineer Supervisor", "Qualifications: Experience : Non-supervisory: Must have a minimum of five (5) years’ experience working as a project engineer at a manufacturing plant, hospital, or a "
     "large university/school system. Supervisory: Must have a minimum of one year experience managing/supervising at least 5 subordinates. Education Requirements: The "
     "completion of a 4-year Bachelor of Science degree, or equivalent, in Electrical Engineering from an accredited university."),
    (4, "Administrativni asistent", "Uslovi: VSS – završen pravni ili ekonomski fakultet; najmanje 3 godine radnog iskustva na sličnim poslovima; odlično poznavanje engleskog jezika; "
     "poznavanje njemačkog jezika je prednost; vozačka dozvola B kategorije. Ugovor na period od 12 mjeseci, puno radno vrijeme. Plata: 2.400 KM neto mjesečno."),
    (5, "Field Consultant", "Minimum requirements: Education: Secondary education, preferably supplemented by relevant training, or university degree in social sciences; Work Experience: Minimum five years of relevant professional experience in social protection."),
    (6, "GEF8-Flora Expert", "Introduction Country: Bosnia and Herzegovina Assignment Duration: October 2026 - December 2026 Proposal should be submitted directly in the portal no later than indicated deadline. Documents must be submitted in English."),
    (7, "Expert", "Experience in at least three relevant processes in the last five years. The roster is valid for three years. Salary: Not Specified."),
    (8, "Assistant", "Languages: Fluency in English is required and German would be an advantage."),
    (9, "Purchasing Administrator", "A. ESSENTIAL QUALIFICATIONS: 1. Professional Experience: Minimum 4 years progressively responsible experience in procurement. "
     "2. Education / Training: Junior college education in Economy or Finance. B. DESIRABLE QUALIFICATIONS: 1. Professional Experience: "
     "Previous experience with SAP. 2. Education / Training: University degree up to 3 years, in Finance or Economics."),
    (10, "Administrator", "Education: Junior college education in Economy or Finance."),
    (11, "Administrator", "Uslovi: VŠS ekonomskog smjera."),
    (12, "Administrator", "Uslovi: viša stručna sprema ili VI stepen."),
    (13, "Administrator", "Obrazovanje: završena viša škola."),
    (14, "Administrator", "Education: associate degree in accounting."),
    (15, "Administrator", "Uslovi: SSS ili VŠS ekonomskog smjera."),
    (16, "Analyst", "Education: VSS, fakultet ekonomskog smjera."),
    (17, "Assistant", "Ima više školskih projekata i vi stepenujete prioritete."),
    (18, "Head of Communications", "GENERAL CONDITIONS Citizenship – Citizen of a Member State of the European Union (EU) and enjoying full rights as a citizen. Language Skills – The candidates must be fully fluent in written and oral English language. Language - Proficiency in local language(s) will be considered an advantage."),
    (19, "Nothing", None),
]


def adverts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVERTS, "id long, title string, text string")


#: Texts and their deadlines.
DATE_TEXTS = [
    ("najkasnije do 17. septembra 2026.", date(2026, 9, 17)),
    ("Deadline: August 25, 2026", date(2026, 8, 25)),
    ("deadline AUGUST 25,2026", date(2026, 8, 25)),
    ("Closing date 2026-10-15", date(2026, 10, 15)),
    ("Interested candidates should by 28.03.2025 submit their CV", date(2025, 3, 28)),
    ("Široki Brijeg, 01.03.2026. Deadline: 15.10.2026", date(2026, 10, 15)),
    ("Closing date: Sept 30, 2026", date(2026, 9, 30)),
    ("Rok za prijavu: 15. 10. 2026.", date(2026, 10, 15)),
    ("Deadline: 15th October 2026", date(2026, 10, 15)),
    ("Deadline: 15 October, 2026", date(2026, 10, 15)),
    ("Deadline 2026/10/15", date(2026, 10, 15)),
    ("Deadline to apply 15-Oct-2026", date(2026, 10, 15)),
    ("Rok za prijavu je 15. listopada 2026.", date(2026, 10, 15)),
    ("Deadline: October 15 2026 (extended to 30 October 2026)", date(2026, 10, 30)),
    ("Deadline: 99.99.2026, corrected deadline: 20.10.2026", date(2026, 10, 20)),
    ("Rok za prijavu: 5. oktobar 2026.", date(2026, 10, 5)),
    ("Deadline for applications: 15 October 2026. Initial contract of one year, may be extended until 31 December 2027.", date(2026, 10, 15)),
    ("Rok za prijave: 30.09.2026. Ugovor se može produžiti do 31.12.2027.", date(2026, 9, 30)),
    ("Deadline 20.12.2026, extended until 15.01.2027.", date(2027, 1, 15)),
    ("The deadline for applications has been extended to 20 October 2026.", date(2026, 10, 20)),
    ("Rok za prijavu je produžen do 25.10.2026.", date(2026, 10, 25)),
    ("Extended deadline: 5 November 2026", date(2026, 11, 5)),
    ("Deadline: 15 October 2026. Only shortlisted applications will be contacted. Contract may be extended until 31.12.2027", date(2026, 10, 15)),
    ("Vacancy: Driver. Fixed-term, may be extended until 31 December 2027. Deadline 15 October 2026", date(2026, 10, 15)),
    ("Oglas za posao. Ugovor može biti produžen do 31.12.2027. Rok 15.10.2026.", date(2026, 10, 15)),
    ("The position remains open until filled. Expected start: 1 January 2027", None),
    ("Applications received by email only. Published 1.10.2026", None),
    ("Applications will be accepted until 20 October 2026.", date(2026, 10, 20)),
    ("Deadline: 16:00 UTC+1 15/10/2026", date(2026, 10, 15)),
    ("Closing date: 12:00 PM (UTC+1), 15 October 2026", date(2026, 10, 15)),
    ("Deadline: 5 p.m., 15 March 2026", date(2026, 3, 15)),
    ("Closing date: 12:00 CET, 1 November 2026", date(2026, 11, 1)),
    ("Rok za prijavu: 15 dana od objave, najkasnije do 20.10.2026.", date(2026, 10, 20)),
    ("Deadline: 17:00 h, 15.03.2026", date(2026, 3, 15)),
    ("Candidates should submit the form by 7 December 2026.", date(2026, 12, 7)),
    ("Applications are received until Friday, 9 October 2026.", date(2026, 10, 9)),
    ("Apply by June 5, 2026", date(2026, 6, 5)),
    ("Deadline: July 1, 2026", date(2026, 7, 1)),
    ("Rok 15.10.2026. (produžen do 20.10.2026.)", date(2026, 10, 20)),
    ("", None),
]


def date_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, (t, _) in enumerate(DATE_TEXTS)], "id long, text string")


LEADS = [
    (1, "https://a.test/2026/10/job", "Project Officer", "Vacancy in Sarajevo, Bosnia and Herzegovina. Deadline: 15 October 2026."),
    (2, "https://a.test/job", "Volunteer coordinator position", "Unpaid position in Mostar. Deadline: 15 October 2026."),
    (3, "https://a.test/job", "National Consultant (NOB)", "Job. Published: 1 September 2026. Duty station: Banja Luka. Deadline: 1 October 2026."),
    (4, "https://a.test/job", "Officer (P3 / NOC)", "Position in Belgrade, Serbia and Sarajevo. Apply by 30.10.2026"),
    (5, "https://a.test/job", "News", None),
    (6, "https://a.test/job", "Job", "Job in Tuzla. Recruitment year: 2026"),
    (7, "https://a.test/2025/10/job", "Job", "Job in Tuzla. Deadline: 15 October 2026"),
]


def leads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEADS, "id long, url string, title string, text string")


STORED = [(1, HASH, TEXT, "", "Project Officer"), (2, HASH, TEXT, "Mostar", "")]


def stored(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STORED, "id long, content_hash string, text string, city string, title string")


def _proposal(job: int, proposed: dict, evidence: dict, content_hash: str = HASH) -> str:
    return json.dumps({"id": job, "content_hash": content_hash, "proposed": proposed, "evidence": evidence})


PROPOSALS = [
    _proposal(1, {"city": "Sarajevo"}, {"city": "Officer in Sarajevo"}),
    _proposal(1, {"city": "Tuzla"}, {"city": "Officer in Sarajevo"}),
    _proposal(1, {"deadline": "20 October 2026"}, {"deadline": "not in the text 20 October 2026"}),
    _proposal(1, {"city": "Sarajevo"}, {"city": "in Sarajevo"}, "old"),
    _proposal(2, {"city": "Sarajevo"}, {"city": "in Sarajevo"}),
    _proposal(9, {"city": "Sarajevo"}, {"city": "in Sarajevo"}),
    _proposal(1, {"colour": "red"}, {}),
    _proposal(1, {"title": "Officer"}, {"title": "Project Officer in"}),
    _proposal(1, {"deadline": "20 October 2026"}, {"deadline": "by 20 October 2026"}),
    "{not json",
]


def proposals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PROPOSALS, 1)), "line long, value string")


BRONZE = [
    (1, "links", "https://a.test/jobs/", '<nav><a href="/x">skip</a></nav><a href="1">Officer</a><a href="1">again</a><a href="/jobs/2">Driver</a>'),
    (2, "table", "https://b.test/", "<table><tr><th>Job Title</th><th>Location</th></tr><tr><td><a href='n.pdf'>Clerk</a></td><td>Sarajevo</td></tr></table>"),
    (3, "json", "https://c.test/api/", '{"total": 2, "jobPostings": [{"title": "A", "externalPath": "a"}, {"title": "B", "externalPath": "b"}]}'),
    (4, "feed", "https://d.test/", "<rss><channel><item><title>Post</title><link>https://d.test/1</link><description>&lt;p&gt;In Mostar&lt;/p&gt;</description></item></channel></rss>"),
    (5, "sitemap", "https://e.test/", "<urlset><url><loc>https://e.test/vacancy-one</loc></url></urlset>"),
    (6, "fields", "https://f.test/", "17!|!Analyst!|!Tuzla!|!18!|!Cook!|!Doboj"),
    (7, "script", "https://g.test/", "var x=JSON.parse('[{\"title\":\"Nurse\",\"id\":5}]');run()"),
    (8, "json", "https://h.test/", "not json"),
]


def bronze(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BRONZE, "source_id long, kind string, url string, payload string")


def stated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1), (5, 1), (6, 2), (7, 1), (8, 1)], "source_id long, total long")
