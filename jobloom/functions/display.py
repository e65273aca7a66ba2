"""What a page shows of a job's facts: tags, rows of requirements and of terms, and counted words. Labels are the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import bs_plural

LEVEL_ORDER = ["secondary", "junior_college", "bachelor", "master", "phd"]


def plural(n: Column, language: Column, local: tuple[str, str, str], english: tuple[str, str]) -> Column:
    """The form that agrees with a count in a language: English has two, the local ones three."""
    one, many = english
    return F.when(language.startswith("en"), F.when(F.abs(n) == 1, one).otherwise(many)).otherwise(bs_plural(n, *local))


def tags() -> Column:
    """Short tags, most useful first: level, years (+), two fields, licence where required, way of working.

    Columns: education_level, experience_years, fields, licence, remote.
    """
    stated = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    years = F.when(F.col("experience_years") == 0, "no experience").when(F.col("experience_years") > 0, F.concat(F.col("experience_years").cast("string"), F.lit("+ years")))
    first = F.array(stated("education_level"), years)
    last = F.array(F.when(F.col("licence") == "required", "driving licence"), stated("remote"))
    return F.array_compact(F.concat(first, F.slice(F.coalesce("fields", F.array().cast("array<string>")), 1, 2), last))


def rows_of(pairs: list[tuple[str, Column, Column]]) -> Column:
    """(label, value, quote) of the pairs that have a value, in order."""
    made = [F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.lit(label).alias("label"), value.alias("value"), F.coalesce(quote, F.lit("")).alias("quote"))) for label, value, quote in pairs]
    return F.array_compact(F.array(*made))


def requirement_rows() -> Column:
    """Rows of what a job asks for. Columns: levels, fields, years, required, desirable, licence, citizenship, quotes."""
    quote = lambda k: F.try_element_at("quotes", F.lit(k))
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    higher = F.slice("levels", 2, 9)
    level = F.concat(F.get("levels", F.lit(0)), F.when(F.size(higher) > 0, F.concat(F.lit(" (also "), F.array_join(higher, ", "), F.lit(")"))).otherwise(""))
    years = F.when(F.col("years") == 0, "none needed").otherwise(F.concat(F.col("years").cast("string"), plural(F.col("years"), F.lit("en"), ("", "", ""), (" year", " years"))))
    spoken = F.array_join(F.concat(F.coalesce("required", F.array().cast("array<string>")), F.transform(F.coalesce("desirable", F.array().cast("array<string>")), lambda x: F.concat(x, F.lit(" (asset)")))), ", ")
    return rows_of(
        [
            ("education", level, quote("education")), ("field", joined("fields"), quote("education")), ("experience", years, quote("experience")),
            ("languages", spoken, quote("languages")), ("licence", F.col("licence"), quote("licence")), ("citizenship", F.col("citizenship"), F.lit("")),
        ]
    )


def term_rows() -> Column:
    """Rows of a contract's terms. Columns: grade, duration, salary, work_time, remote, quotes."""
    quote = lambda k: F.try_element_at("quotes", F.lit(k))
    return rows_of([(c, F.col(c), quote(c)) for c in ("grade", "duration", "salary", "work_time", "remote")])
