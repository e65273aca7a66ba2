"""Editors' work: translations, review queue, publication guards and bulk decisions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a translation with their longest text, the lists with their most items, and the longest item.
TEXT_FIELDS, LIST_FIELDS, LONGEST_ITEM = {"title": 400, "summary": 2000, "how_to_apply": 1000}, {"responsibilities": 8, "requirements": 10}, 400


def tidy(text: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, most)


def cleaned(rows: DataFrame) -> DataFrame:
    """rows with the fields of a proposed version in their expected form: single spaces, cut to length, lists without empty items."""
    texts = {name: tidy(F.col(name), most) for name, most in TEXT_FIELDS.items()}
    items = lambda name, n: F.filter(F.transform(F.slice(F.coalesce(F.col(name), F.array().cast("array<string>")), 1, n), lambda x: tidy(x, LONGEST_ITEM)), lambda x: x != "")
    return rows.withColumns(texts | {name: items(name, n) for name, n in LIST_FIELDS.items()})


def translation_errors(rows: DataFrame) -> DataFrame:
    """(job_id, error): why a proposed version cannot be stored, the first reason; null where it can.

    rows: job_id, text, content_hash, disabled, exported_hash, extra (names of further fields), title, summary, how_to_apply,
    responsibilities, requirements. Addresses and links must stand in the advert itself.
    """
    done = cleaned(rows)
    whole = F.concat_ws(" ", *TEXT_FIELDS, *LIST_FIELDS)
    stretches = F.split(F.lower(whole), r"[\s()\[\]<>\"']+")
    is_contact = lambda x: x.startswith("http://") | x.startswith("https://") | F.contains(F.substring_index(x, "@", -1), F.lit(".")) & F.contains(x, F.lit("@"))
    contacts = F.filter(F.transform(stretches, lambda x: F.trim(x, F.lit(".,;:"))), is_contact)
    foreign = F.exists(contacts, lambda c: ~F.contains(F.lower(F.coalesce("text", F.lit(""))), c))
    error = (
        F.when(F.col("disabled"), "translation is disabled")
        .when(~F.col("exported_hash").eqNullSafe(F.col("content_hash")), "text changed after export")
        .when(F.size("extra") > 0, "unknown field")
        .when(F.col("title") == "", "empty title")
        .when(foreign, "contact not in source")
    )
    return done.select("job_id", error.alias("error"))


def pending_translations(jobs: DataFrame) -> DataFrame:
    """Jobs whose current text has no translation, without those excluded from it. jobs: content_hash, translated_hash, disabled."""
    return jobs.where(~F.coalesce("disabled", F.lit(False)) & ~F.col("translated_hash").eqNullSafe(F.col("content_hash")))


def current_title(language_titles: str = "titles", language: str = "en") -> Column:
    """The translated title in a language, if it was made from the job's current text and is not disabled."""
    current = ~F.coalesce("disabled", F.lit(False)) & F.col("translated_hash").eqNullSafe(F.col("content_hash"))
    return F.when(current, F.try_element_at(F.col(language_titles), F.lit(language)))


def lacking(jobs: DataFrame) -> DataFrame:
    """Jobs of which education, experience or field of study is not known."""
    return jobs.where((F.coalesce("education_level", F.lit("")) == "") | F.col("experience_years").isNull() | (F.coalesce(F.size("fields"), F.lit(0)) <= 0))


def by_deadline_state(jobs: DataFrame, state: str, as_of: date) -> DataFrame:
    """Jobs whose deadline is open, past or none; another state filters nothing."""
    kinds = {"open": F.col("deadline") >= F.lit(as_of), "past": F.col("deadline") < F.lit(as_of), "none": F.col("deadline").isNull()}
    return jobs.where(kinds[state]) if state in kinds else jobs


def review_queue(jobs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Jobs in review that are no copies of official records. duplicates: job_id, of official_duplicates()."""
    return jobs.where("status = 'review'").join(duplicates.select("job_id"), "job_id", "left_anti")


def publish_errors(jobs: DataFrame, duplicates: DataFrame, as_of: date) -> DataFrame:
    """jobs with why a manual publication is refused: the first of a disabled source, a passed deadline, a copy of an official record."""
    copies = duplicates.select("job_id", "duplicate_of")
    error = (
        F.when(F.col("status") != "published", F.lit(None).cast("string"))
        .when(~F.col("enabled"), "source is disabled")
        .when(F.coalesce(F.col("deadline") < F.lit(as_of), F.lit(False)), "deadline has passed")
        .when(F.col("duplicate_of").isNotNull(), "copy of an official record")
    )
    return jobs.join(copies, "job_id", "left").withColumn("error", error)


def bulk(jobs: DataFrame, chosen: DataFrame, action: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The jobs after a bulk action, and its audit rows (job_id, action, changed_at); rows it does not change leave no trace.

    close: to closed for a manual reason; renew: reviewed now, if published; disable: the translation is taken off.
    """
    here = F.col("chosen").isNotNull()
    does = here & {"close": F.col("status") != "closed", "renew": F.col("status") == "published", "disable": ~F.coalesce("disabled", F.lit(False))}[action]
    marked = jobs.join(chosen.select("job_id", F.lit(True).alias("chosen")).distinct(), "job_id", "left").withColumn("does", does)
    stamp = F.lit(now).cast("timestamp_ntz")
    new = {
        "close": {"status": F.when(F.col("does"), "closed").otherwise(F.col("status")), "closed_reason": F.when(F.col("does"), "manual").otherwise(F.col("closed_reason"))},
        "renew": {"last_reviewed": F.when(F.col("does"), F.to_date(stamp)).otherwise(F.col("last_reviewed"))},
        "disable": {"disabled": F.col("does") | F.coalesce("disabled", F.lit(False))},
    }[action]
    log = marked.where("does").select("job_id", F.lit(action).alias("action"), stamp.alias("changed_at"))
    return marked.withColumns(new).select(*jobs.columns), log


def resolved_at(status: Column, resolved: Column, now: datetime) -> Column:
    """When a report was settled: kept where it was, now where it is newly settled, none where it is open again."""
    return F.when(status == "open", F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce(resolved, F.lit(now).cast("timestamp_ntz")))
