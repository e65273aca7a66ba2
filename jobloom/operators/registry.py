"""The registry of organizations and sources, and decisions on single listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a name that its initials leave out.
NOT_INITIALS = (
    "u i za of the in and to for bih ambasada embassy konzulat consulate general generalni republic republike republika ured office"
).split()


def merged(inventory: DataFrame, curated: DataFrame, columns: list[str], key: str = "name") -> DataFrame:
    """Both lists as one: curated values count where they are stated, and either list may have names of its own."""
    left, right = inventory.alias("l"), curated.alias("r")
    both = left.join(right, F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    return both.select(F.coalesce(f"r.{key}", f"l.{key}").alias(key), *[F.coalesce(f"r.{c}", f"l.{c}").alias(c) for c in columns], F.col(f"r.{key}").isNotNull().alias("curated"))


#: Fields of an organization that an import replaces, and those of its audit, which it only replaces where it states them.
FACTS = ["name_en", "short_name", "kind", "country", "city", "website", "evidence_url", "verified_at", "notes"]
AUDIT = ["recruitment_status", "recruitment_checked_at", "recruitment_evidence_url", "recruitment_notes"]
#: What an audit may have found.
AUDITS = ("not_found", "integration", "blocked")
ENTRY = "url string, adapter string, status string, enabled boolean, adapter_config string, notes string"
ITEM = f"name string, previous_name string, {', '.join(f'{c} string' for c in FACTS + AUDIT)}, sources array<struct<{', '.join(x.replace(' ', ':') for x in ENTRY.split(', '))}>>"


def read_registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The items of a registry file, a JSON array of organizations or one a line, with `pos`, their order. An absent key and a null one are the same; settings are JSON in its shortest form."""
    items = spark.read.schema(ITEM).option("multiLine", not lines).json(path).withColumn("pos", F.monotonically_increasing_id())
    short = lambda x: F.to_json(F.try_parse_json(x["adapter_config"]))
    return items.withColumn("sources", F.transform("sources", lambda x: x.withField("adapter_config", short(x))))


def refused(items: DataFrame, audits: tuple[str, ...] = AUDITS) -> DataFrame:
    """(name, reason) of items that an import must not take: without a name, or with an audit that is unknown or lacks its day, its address or its notes."""
    stated = F.coalesce("recruitment_status", F.lit("")) != ""
    lacks = [F.coalesce(c, F.lit("")) == "" for c in AUDIT[1:]]
    reason = F.when(F.coalesce("name", F.lit("")) == "", "no name").when(stated & (~F.col("recruitment_status").isin(*audits) | lacks[0] | lacks[1] | lacks[2]), "incomplete audit")
    return items.select("name", reason.alias("reason")).where("reason is not null")


def imported(organizations: DataFrame, sources: DataFrame, items: DataFrame, audits: tuple[str, ...] = AUDITS) -> tuple[DataFrame, DataFrame]:
    """Organizations and sources after an import; nothing is imported if any item is refused.

    organizations: name, FACTS, AUDIT; sources: org (name), url, adapter, adapter_config, notes, status, enabled; items as read_registry gives them.
    An item with previous_name renames that organization, unless its own name is there already. Of items of one name the last counts.
    """
    bad = refused(items, audits).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['reason']}: {r['name']}" for r in bad))
    had = organizations.select(F.col("name").alias("had"))
    fresh = items.join(had, items["name"] == F.col("had"), "left_anti").where("coalesce(previous_name, '') != ''")
    renames = fresh.groupBy("previous_name").agg(F.min_by("name", "pos").alias("renamed"))
    # Two names for one: the first takes it. One name for two: the item that comes first.
    renames = renames.join(organizations.select(F.col("name").alias("previous_name")), "previous_name", "left_semi").groupBy("renamed").agg(F.min("previous_name").alias("previous_name"))
    now = F.coalesce("renamed", "name").alias("name")
    old = organizations.join(renames, F.col("name") == F.col("previous_name"), "left").select(now, *FACTS, *AUDIT)
    last = items.groupBy("name").agg(
        F.max_by(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in FACTS]), "pos").alias("facts"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in AUDIT],
    )
    both = old.alias("l").join(last.alias("r"), "name", "full")
    facts = [F.when(F.col("facts").isNotNull(), F.col(f"facts.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in FACTS]
    after = both.select("name", *facts, *[F.coalesce(f"r.{c}", f"l.{c}", F.lit("")).alias(c) for c in AUDIT])
    held = sources.join(renames, F.col("org") == F.col("previous_name"), "left").withColumn("org", F.coalesce("renamed", "org")).select(*sources.columns)
    entries = items.select(F.col("name").alias("org"), F.col("pos").alias("item"), F.posexplode("sources").alias("k", "e")).select("org", "item", "k", "e.*")
    return after, sources_upserted(held, entries)


def sources_upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources after a registry import. A URL is one source, even if the registry has it under another organization than before.

    old: org, url, adapter, adapter_config, notes, status, enabled; new, the entries: the same, and item and k, their order; null is not stated. A source that is there
    moves to the entry's organization and takes its notes; it is never enabled or given a status. Its adapter and settings change too, but not while it is enabled and
    the entry names another adapter: new settings would mislead the running one. A new source is as its entry says, by default without an adapter and disabled.
    Entries of one URL count one after the other; others stay.
    """
    order = F.struct("item", "k")
    last = lambda c, when=None: F.max_by(c, F.when(F.col(c).isNotNull() & (F.lit(True) if when is None else when), order))
    base = new.where("url is not null").join(old.select("url", F.col("adapter").alias("had"), F.col("enabled").alias("on")), "url", "left")
    first = F.row_number().over(Window.partitionBy("url").orderBy("item", "k")) == 1
    base = base.withColumn("first", first & F.col("on").isNull())
    made = base.groupBy("url").agg(
        F.max_by("org", order).alias("org"),
        F.max_by(F.struct(F.coalesce("adapter", F.lit("none")).alias("adapter"), F.coalesce("adapter_config", F.lit("{}")).alias("adapter_config"), F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("status", F.lit("discovered")).alias("status"), F.coalesce("enabled", F.lit(False)).alias("enabled")), F.when(F.col("first"), order)).alias("made"),
        last("notes", ~F.col("first")).alias("notes"),
        last("adapter", ~F.col("first")).alias("adapter"),
        F.array_sort(F.collect_list(F.when(~F.col("first") & F.col("adapter_config").isNotNull(), F.struct("item", "k", "adapter", "adapter_config")))).alias("settings"),
    )
    both = old.alias("l").join(made.alias("r"), "url", "full")
    had = lambda c: F.coalesce(f"l.{c}", f"made.{c}")
    running = F.coalesce(had("enabled"), F.lit(False))
    # While a source runs, only settings that come with its own adapter, or with none, are for it.
    own = F.filter("settings", lambda e: ~running | e["adapter"].isNull() | (e["adapter"] == had("adapter")))
    return both.select(
        F.coalesce("r.org", "l.org").alias("org"), "url", F.when(running, had("adapter")).otherwise(F.coalesce("r.adapter", had("adapter"))).alias("adapter"),
        F.coalesce(F.try_element_at(own, F.lit(-1))["adapter_config"], had("adapter_config")).alias("adapter_config"), F.coalesce("r.notes", had("notes")).alias("notes"), had("status").alias("status"), running.alias("enabled"),
    )


def with_sources(organizations: DataFrame, sources: DataFrame) -> DataFrame:
    """organizations with an array of their source ids in order; empty for those without."""
    nested = sources.groupBy("org").agg(F.array_sort(F.collect_list("source_id")).alias("sources"))
    return organizations.join(nested, "org", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<long>")))


def open_reports(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """jobs with how many new reports each has; reports may be about no job."""
    n = reports.where("status = 'new' and job_id is not null").groupBy("job_id").agg(F.count(F.lit(1)).alias("open_reports"))
    return jobs.join(n, "job_id", "left").withColumn("open_reports", F.coalesce("open_reports", F.lit(0)))


def decided(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """jobs after editors' decisions: each counts only if the text is still the one that was read; fields edited are protected from then on.

    jobs: job_id, status, hash, protected (array); decisions: job_id, read_hash, new_status, edited (array). outcome: applied, stale, or null.
    """
    both = jobs.join(decisions, "job_id", "left")
    hit = F.col("new_status").isNotNull() & (F.col("hash") == F.col("read_hash"))
    outcome = F.when(hit, "applied").when(F.col("new_status").isNotNull(), "stale")
    edited = F.array_sort(F.array_union("protected", F.coalesce("edited", F.array().cast("array<string>"))))
    return both.select(
        "job_id",
        F.when(hit, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        F.when(hit, edited).otherwise(F.col("protected")).alias("protected"),
        outcome.alias("outcome"),
    )


def changed_fields(old: DataFrame, new: DataFrame, fields: list[str], key: str = "job_id") -> DataFrame:
    """(key, changed): names of the fields that a new extraction changes, without protected ones. old has an array `protected`."""
    both = old.alias("l").join(new.alias("r"), key)
    names = F.array_compact(F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")) & ~F.array_contains("l.protected", f), f) for f in fields]))
    return both.select(key, names.alias("changed")).where(F.size("changed") > 0)


def newest_of_role(blocks: DataFrame) -> DataFrame:
    """The newest block of each role: by date, then place."""
    order = Window.partitionBy("role").orderBy(F.desc("day"), F.desc("place"))
    return blocks.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def first_seen_union(found: DataFrame, known: DataFrame) -> DataFrame:
    """URLs of both lists once each, in the order they first come: found ones first. Both: url, pos."""
    both = found.select("url", F.lit(0).alias("list"), "pos").unionByName(known.select("url", F.lit(1).alias("list"), "pos"))
    return both.groupBy("url").agg(F.min(F.struct("list", "pos")).alias("at")).select("url", "at.list", "at.pos")


def proven_dates(copies: DataFrame, own: DataFrame) -> DataFrame:
    """copies with the publication date of the employer's own record of the same requisition; null unless title, deadline and place bear it out.

    copies: job_id, requisition, title, deadline; own: requisition, title, deadline, published_on, located (whether its place is in the country). Titles are compared
    by their letters and figures; a record without a place that is known to be in the country proves nothing.
    """
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    same = (F.col("c.requisition") == F.col("o.requisition")) & (letters(F.col("c.title")) == letters(F.col("o.title"))) & F.col("c.deadline").eqNullSafe(F.col("o.deadline"))
    joined = copies.alias("c").join(own.where("located").alias("o"), same, "left")
    return joined.groupBy("c.job_id").agg(F.min("o.published_on").alias("published_on"))


def evidence_merged(old: Column, new: Column) -> Column:
    """Two maps as one: what the new one has counts, nulls too; the rest of the old one stays. A null map is an empty one."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x))


def menu_entries(pages: DataFrame) -> DataFrame:
    """(page_id, title, slug, verification): the entries of directory menus that pages carry in their scripts, once a page; all wait for verification.

    A page without entries has one row of nulls, as its structure has changed then. Quotes in the script may be escaped.
    """
    found = F.regexp_extract_all(F.replace("html", F.lit('\\"'), F.lit('"')), F.lit(r'\{"title":"[^"]+","slug":"[^"]+"\}'), F.lit(0))
    each = pages.select("page_id", F.explode_outer(F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))).alias("e"))
    part = lambda name: F.get_json_object("e", f"$.{name}").alias(name)
    return each.select("page_id", part("title"), part("slug"), F.when(F.col("e").isNotNull(), "pending").alias("verification"))


def attributed(rows: DataFrame, organizations: DataFrame) -> DataFrame:
    """rows with the employer that an agency code names, or the code itself. organizations: org_id, short_name, name; the first id counts."""
    named = organizations.groupBy(F.lower("short_name").alias("code")).agg(F.min_by("name", "org_id").alias("employer"))
    return rows.join(named, F.lower("agency") == F.col("code"), "left").drop("code").withColumn("employer", F.coalesce("employer", "agency"))


def capital(text: Column) -> Column:
    """Upper case that keeps one letter for each: a sharp s becomes a capital one and no two letters, what has no capital of one letter stays."""
    letter = lambda c: F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), letter), "")


def monogram(name: Column, short_name: Column) -> Column:
    """The short name, else an acronym in the name, else initials of two words or two letters of one."""
    acronym = F.get(F.filter(F.regexp_extract_all(name, F.lit(r"(?<![\p{L}])[A-ZČĆŠĐŽ]{2,6}(?![\p{L}])"), F.lit(0)), lambda w: w != "BIH"), 0)
    words = F.filter(F.regexp_extract_all(name, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*NOT_INITIALS))
    initials = capital(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))
    one = capital(F.substring(F.get(words, 0), 1, 2))
    return F.when(F.coalesce(short_name, F.lit("")) != "", short_name).otherwise(F.coalesce(acronym, F.when(F.size(words) == 1, one).otherwise(initials)))


def structured(jobs: DataFrame) -> DataFrame:
    """(job_id, data): each job as JSON-LD, with the characters that could end a script written as escapes."""
    posting = F.to_json(
        F.struct(
            F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"), F.col("title"), F.col("first_seen").cast("string").alias("datePosted"),
            F.col("deadline").cast("string").alias("validThrough"), F.struct(F.lit("Organization").alias("@type"), F.col("employer").alias("name")).alias("hiringOrganization"),
        )
    )
    safe = posting
    for c, code in (("<", "\\u003C"), (">", "\\u003E"), ("&", "\\u0026")):
        safe = F.replace(safe, F.lit(c), F.lit(code))
    return jobs.select("job_id", safe.alias("data"))


def seconds_to_next_hour(now: Column) -> Column:
    return F.lit(3600) - F.pmod(F.unix_seconds(now), F.lit(3600))
