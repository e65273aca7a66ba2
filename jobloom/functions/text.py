"""Text as columns: folding, normalized names, URL keys, title stems, plurals and the language of a text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folding() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one letter or figure, those in the same order, and letters that fold to several, by compatibility decomposition."""
    one, several = {"đ": "d"}, {}
    for x in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)]):
        base = "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))
        if x == x.lower() and x not in one and base != x and base.isascii() and base.isalnum():
            (one if len(base) == 1 else several)[x] = base
    return "".join(one), "".join(one.values()), several


#: Combining marks have no counterpart, and so fall away.
MARKED, PLAIN, SEVERAL = _folding()
MARKED += "".join(map(chr, range(0x300, 0x370)))
#: Words of each language that mark a text as written in it.
STOPWORDS = {
    "en": "the and of to in for with is are will be this that or an on as by from have has should",
    "bs": "i u za na je se od sa kao ili da su koji koja koje biti iz po te ako prijava rok oglas radno iskustvo",
    "it": "il di che per della delle dei con non sono del alla una gli le nel nella al questo essere",
    "de": "der die und das für mit ist nicht von zu den dem des ein eine im auf sich werden oder bei",
    "fr": "le la les des et pour avec est une du dans au aux sur par sont ce qui être ou",
    "es": "el los las del para con una por que y en es se al como más su sus o",
    "pt": "os das dos para com uma não são em ao pela pelo processo seletivo no na do da ou",
    "tr": "ve bir için ile olan bu da de olarak veya en çok gibi daha",
    "sl": "in ki je za na se so pri tudi lahko ter oziroma delovno mesto bo ali",
    "id": "dan yang untuk dengan di ini dari atau akan pada dalam kami adalah",
}
LEAST_WORDS, LEAST_SHARE = 20, 0.04
#: Title words that do not say what the work is, and six-letter stems of job families.
NOISE = (
    "and for the with from open all interested applicants applicant candidates candidate internal external national international post position tier "
    "sarajevo mostar banja luka tuzla bosnia herzegovina bih fbih nob noc noa nod nationals only local staff vacancy job hiring team level grade full part "
    "time unfpa undp unicef osce eufor eeas rta who ilo iom unhcr unops women"
).split()
ROLE_STEMS = "expert consul advise assist office specia manage coordi associ analys admini chief head senior junior superv lead projec".split()
#: Names of employers that mean the same one.
EMPLOYERS = {
    "unicef": ["unicef u bosni i hercegovini", "unicef united nations children s fund"],
    "undp": ["undp u bosni i hercegovini", "undp united nations development programme"],
    "unfpa": ["unfpa u bosni i hercegovini", "unfpa united nations population fund"],
    "unwomen": ["un women u bosni i hercegovini", "un women united nations entity for gender equality and the empowerment of women"],
    "osce": ["misija osce a u bosni i hercegovini", "osce organization for security and co operation in europe"],
}
#: Paths that are a portal's front page, never one vacancy.
SHARED_PATHS = ("", "/jobs", "/careers", "/vacancies", "/search", "/en/jobs", "/en/careers")


def fold(text: Column) -> Column:
    """Lower case without marks, letters of several in full; dj and d with stroke both become d."""
    plain = F.translate(F.lower(text), MARKED, PLAIN)
    for x, base in SEVERAL.items():
        plain = F.replace(plain, F.lit(x), F.lit(base))
    return F.replace(plain, F.lit("dj"), F.lit("d"))


def normalized(text: Column) -> Column:
    """The folded words with single spaces."""
    return F.array_join(F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def employer_key(name: Column) -> Column:
    """The normalized name, or the key of the employer it is an alias of."""
    pairs = [F.lit(x) for key, names in EMPLOYERS.items() for n in names for x in (n, key)]
    key = normalized(name)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def all_words(text: Column, query: Column) -> Column:
    """Whether every word of the query (its first 100 characters) stands in the text, both folded."""
    words = F.filter(F.split(fold(F.substring(query, 1, 100)), " "), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(fold(text), w))


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def under(host: Column, domain: str) -> Column:
    """Whether a host is the domain or lies below it."""
    return (host == domain) | host.endswith("." + domain)


def sorted_query(url: Column, tracking: bool) -> Column:
    """The query's parameters in order; without tracking ones unless told to keep them."""
    found = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: p != "")
    if not tracking:
        found = F.filter(found, lambda p: ~F.lower(p).rlike(r"^(utm_[^=]*|fbclid|gclid)(=|$)"))
    return F.array_join(F.array_sort(found), "&")


def url_key(url: Column) -> Column:
    """What names a vacancy in a URL: host without www., path without its last slash, parameters but tracking ones.

    Empty for other schemes, for bad URLs and for portals' front pages; two portals' forms of one requisition become one.
    """
    host = F.regexp_replace(host_of(url), "^www\\.", "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    query = sorted_query(url, tracking=False)
    requisition = F.regexp_extract(path, r"/job/(\d+)(?:/|$)", 1)
    oracle = r"(?i)/CandidateExperience/[^/]+/sites/([^/]+)/(?:requisitions/)?(?:job|preview)/(\d+)(?:/|$)"
    site, number = F.regexp_extract(path, oracle, 1), F.regexp_extract(path, oracle, 2)
    known = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & host.isNotNull() & (host != "")
    return (
        F.when(~F.coalesce(known, F.lit(False)), "")
        .when((host == "jobs.unicef.org") & (requisition != ""), F.concat(host, F.lit("/job/"), requisition))
        .when(host.endswith(".oraclecloud.com") & (number != ""), F.concat(host, F.lit("/sites/"), site, F.lit("/job/"), number))
        .when(F.lower(path).isin(*SHARED_PATHS) & (query == ""), "")
        .otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
    )


def canonical_url(url: Column) -> Column:
    """A URL for storage: lower-case scheme and host, parameters in order, no fragment; null if it is no web address."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    query = sorted_query(url, tracking=True)
    whole = F.concat(scheme, F.lit("://"), F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), F.when(path == "", "/").otherwise(path))
    return F.when(scheme.isin("http", "https"), F.concat(whole, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def stems(title: Column) -> Column:
    """Distinct six-letter stems of a title's words of three letters or more, without noise."""
    words = F.regexp_extract_all(fold(title), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*NOISE)), lambda w: F.substring(w, 1, 6)))


def bs_plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form that agrees with a count: 1, 21, 31; 2 to 4, 22 to 24; the rest."""
    n = F.abs(n)
    return (
        F.when((n % 10 == 1) & (n % 100 != 11), one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)
    )


def slug(text: Column) -> Column:
    """A URL part: folded, all but letters and digits as single dashes, 80 characters at most."""
    dashed = F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.trim(F.substring(dashed, 1, 80), F.lit("-"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def language(text: Column) -> Column:
    """The language with the largest share of marker words, the first of equals; empty if that is too small or the text too short."""
    greek = F.length(F.regexp_replace(text, "[^Ͱ-Ͽ]", ""))
    cyrillic = F.length(F.regexp_replace(text, "[^Ѐ-ӿ]", ""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    codes = F.array(*[F.lit(code) for code in STOPWORDS])

    def hits(found: Column) -> Column:
        among = lambda known: lambda w: w.isin(*known.split())
        return F.array(*[F.size(F.filter(found, among(known))) for known in STOPWORDS.values()])

    def best(n: Column) -> Callable[[Column], Column]:
        most = F.array_max
        return lambda h: F.when(most(h) >= LEAST_SHARE * n, F.element_at(codes, F.array_position(h, most(h)).cast("int"))).otherwise("")

    marked = bound(words, lambda found: F.when(F.size(found) >= LEAST_WORDS, bound(hits(found), best(F.size(found)))).otherwise(""))
    return (
        F.when(text.isNull(), "")
        .when(greek > 50, "el")
        .when(cyrillic > 50, F.when(text.rlike("[ђћџјљњЂЋЏЈЉЊ]"), "bs").otherwise("ru"))
        .otherwise(marked)
    )
