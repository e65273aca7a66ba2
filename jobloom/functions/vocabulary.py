"""Words that adverts are read by.

All of these are fixed values. A phrase is words parted by spaces; a star stands for any ending of a word; a word with
capitals is told from the same word without them. Phrases are parted by commas.
"""

from __future__ import annotations

#: Month names by number, in the languages of the adverts.
MONTHS = {
    1: "january jan januara januar siječnja gennaio", 2: "february feb februara februar veljače febbraio", 3: "march mar marta mart ožujka marzo",
    4: "april apr aprila travnja aprile", 5: "may maja maj svibnja maggio", 6: "june jun juna juni lipnja giugno", 7: "july jul jula juli srpnja luglio",
    8: "august aug augusta kolovoza agosto", 9: "september sep sept septembra septembar rujna settembre", 10: "october oct oktobra oktobar listopada ottobre",
    11: "november nov novembra novembar studenoga studenog novembre", 12: "december dec decembra decembar prosinca dicembre",
}
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday"
#: What follows a number that is a time of day or a count of days.
TIMES = "a am p pm h hrs hours sati časova ore cet cest utc gmt day days dana giorni"
ZONES = "utc gmt cet cest"

#: Numbers as words.
COUNTS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "fifteen": 15,
    "jedna": 1, "jednu": 1, "jedne": 1, "dvije": 2, "dve": 2, "dva": 2, "tri": 3, "četiri": 4, "pet": 5, "šest": 6, "sedam": 7, "osam": 8, "devet": 9, "deset": 10,
}

#: Dates: what announces a deadline somewhere after it; what is taken, and until; who should apply; verbs of "submit by"; extensions; what announces a publication.
DATES = {
    "announced": "deadline, closing date, closing for application, closing for applications, posting end date, apply by, rok, rok za prijavu, prijave do, "
    "application deadline, najkasnije do, no later than, scad, scad presentazione domande",
    "taken": "accepted, received, open, primaju, application, applications, documents",
    "until": "until, till, through, by, do",
    "runs_out": "ističe",
    "people": "candidate, candidates, applicant, applicants",
    "verb": "submit*, send, apply",
    "call": "deadline, closing date, rok*, prijav*, application, applications, vacancy, natječaj*, natjecaj*, konkurs*, oglas*",
    "longer": "extended, prolonged, produžen*, produljen*",
    "longer_call": "extended deadline, extended closing date, produžen* rok*",
    "term": "contract, ugovor*, appointment, angažman*",
    "published": "published, date of publication, issue date, data pubblicazione, datum objave, objavljeno",
}

#: Education levels from low to high.
LEVELS = {
    "secondary": "secondary school, secondary education, high school, srednj* stručn* sprem*, srednj* škol*, srednj* obrazovanj*, sss, kv",
    "junior_college": "junior college, associate degree, associates degree, associate s degree, všs, viš* stručn* sprem*, viša škol*, više škole, višu škol*, višoj škol*, "
    "višom škol*, VI stepen*",
    "bachelor": "bachelor*, first level degree, first level university degree, 1st level degree, 1st level university degree, university degree, university education, "
    "university diploma, higher education, academic qualification, academic degree, undergraduate*, college degree, degree in, bsc, fakultet*, vss, visok* stručn* sprem*, visok* obrazovanj*",
    "master": "master*, advanced degree, advanced university degree, second level degree, second level university degree, postgraduate*, post graduate*, msc, llm, ll m, mba, magist*, VII 1",
    "phd": "phd, ph d, doctorate, doctoral, doktor*",
}
#: Words of a passage about schooling; those that a field of study stands next to; and what ends the fields named after them.
SCHOOLING = {
    "schooling": "education, degree, diploma, qualification, graduate, university, bachelor, master, phd, ph d, obrazovanj*, fakultet*, diplom*, sprem*, studij*, škol*, college, všs, vss, sss",
    "study_anchor": "degree*, education*, diploma*, qualification*, fakultet*, studij*, sprem*, bachelor*, master*",
    "study_end": "experience, iskustv*, language, languages, jezi*, competenc*, skills, vještin*, knowledge, poznavanj*",
}
#: Fields of study.
FIELDS = {
    "law": "law, legal studies, legal science, legal sciences, jurisprudence, llm, ll m, pravn*, pravo",
    "economics": "economic, economics, financ*, accounting, accountancy, business, commerce, mba, ekonom*, finansij*, financij*, računovod*",
    "public_admin": "public administration, public policy, public management, public affairs, management studies, management sciences, administrative science, administrative sciences, "
    "javn* uprav*, javn* politik*, menadžment*",
    "political": "political science, political sciences, international relations, international affairs, international studies, diplomacy, european studies, european integration, "
    "polit* nau*, politolog*, međunarodn* odnos*, diplomatij*",
    "social": "social science, social sciences, sociology, psychology, social work, social policy, anthropology, društven* nau*, sociolog*, psiholog*, socijaln* rad*",
    "human_rights": "human rights, gender, ljudsk* prav*, rodn* studij*",
    "engineering": "engineering, architecture, inženjer*, građevin*, elektrotehn*, mašin*, arhitekt*",
    "it": "computer science, computer sciences, information technology, information systems, informatics, software, telecommunication, telecommunications, informati*, računarst*",
    "statistics": "statistic, statistics, mathematics, demography, data science, statisti*, matemati*",
    "communications": "communication, communications, journalism, media, public relations, marketing, novinar*, komunikolog*, komunikacij*",
    "languages": "linguistic, linguistics, philology, translation, interpreting, interpretation, literature, filolog*, prevođ*, anglist*, germanist*",
    "health": "medicine, medical, public health, health, nursing, pharmac*, medicin*, zdravstv*",
    "environment": "environment*, ecology, biology, forestry, agricultur*, natural science, natural sciences, climate, geography, chemistry, okoliš*, šumarst*, poljoprivred*, biolog*, ekolog*",
    "pedagogy": "education science, education sciences, educational science, educational sciences, pedagog*, teaching",
    "security": "security studies, military, criminology, kriminal*, sigurnosn* studij*",
    "logistics": "logistic, logistics, supply chain, logisti*",
}
#: Languages, the words of a passage about them, and of one about the language of an application.
TONGUES = {
    "en": "english, engle*",
    "bcs": "bosnian, croatian, serbian, local language, local languages, national language, national languages, official language of bosnia, official languages of bosnia, "
    "official language of bih, official languages of bih, b c s, bcs, bosansk*, hrvatsk* jezik*, srpsk* jezik*, lokaln* jezik*, jezik* naroda",
    "de": "german, njemač*", "fr": "french, francusk*", "it": "italian, talijansk*, italijansk*", "es": "spanish, španjolsk*, špansk*",
    "tr": "turkish, turs* jezik*", "ru": "russian, rusk* jezik*", "ar": "arabic, arapsk*",
}
SPEECH = {
    "speech": "language, languages, fluen*, proficien*, command of, speaker, spoken, written, slp, jezi*, poznavanj*, znanj*",
    "mastery": "fluen*, proficien*, command of, knowledge of, poznavanj*, speaker",
    "paper": "application, cv, curriculum, cover letter, motivation letter, document, documents, form, translation, translations, prijav*, dokument*",
    "in_english": "in english, in the english, na engleskom, in engleskom, na english",
}
#: Words that make what stands before them an asset, or a duty; words of headings about what is wished, what is needed, and other things.
WEIGHT = {
    "asset": "asset, advantage, desirable, desired, preferred, preferably, plus, optional, would be, an added, prednost*, poželjn*",
    "duty": "required, mandatory, must, essential, obavez*, neophod*, potreb*",
    "wish": "desirable, desired, preferred, additional, poželjn*",
    "need": "essential, required, minimum, mandatory, obavezn*",
    "headed": "qualifications, requirements, skills, kvalifikacij*, uslov*, uvjet*",
    "other_heading": "attributes, competencies, remarks, employment conditions, duties, responsibilities",
    "wished_label": "desirable, desirables, asset, assets, poželjno, prednost*",
    "asked_label": "mandatory, requirements, qualifications",
}
#: Experience: words for it and for years; words of rank.
WORK = {
    "worked": "experience*, iskustv*, staž*",
    "years": "year, years, year s, years s, yr, yrs, godin*",
    "unneeded": "bez iskustva, bez radnog iskustva, nije potrebno iskustvo, nije potrebno radno iskustvo",
    "rank": "management, managerial, manager, supervisory, supervisor, senior",
    "ranking": "managing, supervising, rukovodn*",
}
#: Words of a span, a limit, a term or a share: years counted from them are no total. And words that may stand between those and the number, or a number and a rank.
SPANS = "last past posljednjih every once maximum up under over within valid period duration including uključujući which čega combination plus additional"
BETWEEN = "a an at least minimum najmanje of must have the to for in with"
AT_RANK = "of at in as a an the on na experience additional position"
NO_EXPERIENCE = {"lead": "no", "between": "prior previous work professional", "end": "required needed necessary"}
#: Facts that are read from a first mention.
MENTIONS = {
    "licence": "driving licence, driving license, driver licence, driver license, drivers licence, drivers license, driver s licence, driver s license, driving permit, vozačk* dozvol*",
    "citizen": "citizen, citizens, national, nationals, državljan*",
    "remote": "remote first, remote based, remote work*, remote position, remote with travel, remotely, fully remote, home based, work from home, working from home, rad od kuće, rad na daljinu",
    "hybrid": "hybrid, hibridn*",
    "full": "full time, puno radno vrijeme, punim radnim vremenom",
    "part_time": "part time, nepuno radno vrijeme, nepunim radnim vremenom",
}
#: Citizenship: what ties it to the country or the union, and what makes it a condition.
OF_COUNTRY, OF_UNION = "country bosnia bosnian bosne bih local", "eu member države"
CONDITION = "must only are open residents"
#: Pay: what a passage about it says, that it is not told, currencies, spans, and what a sum is for.
PAY = {
    "pay": "salary, compensation, remuneration, pay, fee, plat*, naknad*, primanj*, zarad*",
    "untold": "salary not specified, salary competitive, salary tbd, salary negotiable, compensation not specified, compensation competitive, compensation tbd, compensation negotiable",
}
CURRENCIES = "EUR EURO EUROS € BAM KM USD US$ $ CHF"
PAY_SPANS = "- – to do"
PAY_TERMS = "per month, per year, per annum, per hour, per day, a month, a year, / month, / year, / hour, / day, mjesečno, godišnje, neto, bruto, gross, net, monthly, annually"
#: Duration: what announces it, and its units.
LASTING = {
    "lasts": "duration, contract length, contract period, contract duration, trajanj*, trajanj* od, period angažmana, period od, na period od, za period od, assignment duration, for a period of, "
    "duration of the contract, duration of the assignment",
    "unit": "month, months, year, years, week, weeks, working days, mjesec*, godin*, sedmic*, radnih dana",
}
ABOUT = "up to, do, approximately, approx"
#: Grades: the highest number of each series, series told by a label, and letters without numbers.
GRADES = {"G": 7, "P": 6, "D": 2, "LCH": 99, "NPSA": 99, "SB": 5, "LICA": 99, "LE": 99, "FSN": 99}
GRADE_LABELS = "grade level razred"
GRADE_LETTERS = "NOA NOB NOC NOD"

#: Words of adverts, of what is left out, of closed adverts and of kinds of posts.
ADVERT = (
    "vacancy, vacancies, job, career, position, officer, assistant, adviser, advisor, traineeship, internship, consultant, oglas, konkurs, natječaj, posao, radno mjesto, "
    "slobodna radna mjesta, prijava, asistent, savjetnik, selezione, assunzione, impiegato, impiegati, stellenangebot, stellenausschreibung, stelle, lehrkraft, lehrkräfte"
)
LEFT_OUT = "unpaid, volunteer, volont*, scholarship, stipendij*, tender, call for proposals, poziv za projekte, javna nabavka"
UNPAID = "unpaid, neplaćena, neplaćeno, neplaćene"
CONSULTANCY = "consultant, consultancy, consultants, konsultant*, individual contractor, ic contract"
INTERNSHIP = "intern, interns, internship, internships, traineeship, traineeships, praksa, pripravni*, tirocinio"
#: Markers of national and international posts; the highest number of each series of grades.
NATIONAL = (
    "national post, national position, national consultant, national personnel, national officer, national professional, npsa, noa, nob, noc, nod, service contract, local agent, local staff, "
    "locally engaged, LICA, external recruitment (local)"
)
NATIONAL_GRADES = {"g": 7, "gs": 7, "lch": 9, "sb": 5, "sc": 99, "lp": 5, "ls": 5}
INTERNATIONAL = "international consultant, international position, international post, international recruitment, international staff, ipsa, secondment, seconded, IICA, external recruitment (international)"
INTERNATIONAL_GRADES = {"p": 5, "ip": 5}
#: Places: other countries near a mention, cities as they are spelled, labels of a duty station, the country.
ELSEWHERE = "albania, chad, kosovo, montenegro, serbia, croatia, north macedonia, belgrade, zagreb, tirana, pristina"
CITIES = {
    "Sarajevo": "sarajevo, sarajevu, sarajeva",
    "Banja Luka": "banja luka, banja luku, banja luke, banja luci, banjaluka, banjaluku, banjaluke, banjaluci, banjoj luci, banje luke",
    "Mostar": "mostar, mostaru, mostara",
    "Brčko": "brčko, brcko, brčkom, brčka, brčku",
    "Tuzla": "tuzla, tuzle, tuzli, tuzlu",
    "Zenica": "zenica, zenice, zenici, zenicu",
    "Bijeljina": "bijeljina, bijeljine, bijeljini, bijeljinu",
    "Trebinje": "trebinje, trebinju, trebinja",
    "Bihać": "bihać, bihac, bihaću, bihaća",
    "Doboj": "doboj, doboju, doboja",
    "Prijedor": "prijedor, prijedoru, prijedora",
    "Travnik": "travnik, travniku, travnika",
    "Goražde": "goražde, gorazde",
    "Livno": "livno",
    "Cazin": "cazin",
}
STATION = "duty station, location, work location, place of work, mjesto rada, lokacija"
COUNTRY = "bosnia and herzegovina, bosnia & herzegovina, bosnia herzegovina, bosna i hercegovina"
