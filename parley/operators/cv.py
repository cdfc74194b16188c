"""CV texts: sections, tenure, tracks, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators.history import covered, merge_intervals


def heading(line: Column) -> Column:
    """The section a line is the heading of; null if it is none."""
    bare = F.regexp_replace(T.strip(line), r"^[\s\-–—*•#>0-9.)|]+", "")
    bare = F.lower(T.strip(F.regexp_replace(F.regexp_replace(bare, r"[:\-–—_|=~*\s]+$", ""), r"\s{2,}", " ")))
    core = T.strip(F.get(F.split(bare, r"\s*(?:&|and|/)\s*"), F.lit(0)))
    known = F.create_map(*(F.lit(x) for name, aliases in L.SECTIONS.items() for a in aliases for x in (a, name)))
    fits = (F.length(T.strip(line)) <= 60) & (F.size(T.words(bare)).between(1, 4))
    return F.when(fits, F.coalesce(F.try_element_at(known, bare), F.try_element_at(known, core)))


def lines(cvs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of each text with the section they stand in ('header' before any heading); headings and blank lines go.

    Whole texts are dealt out by key first, to a number of tasks, as reading them takes far longer than their bytes tell: texts of a
    small file are read by all cores, and what follows by key needs no further shuffle.
    """
    spark = cvs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = cvs.select(key, text).repartition(tasks, key).select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("_h", heading(F.col("line"))).withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(w), F.lit("header")))
    return rows.filter(F.col("_h").isNull() & (T.strip(F.col("line")) != "")).select(key, "line_no", T.strip(F.col("line")).alias("line"), "section")


def _month(name: Column) -> Column:
    return F.array_position(T.strs(L.MONTHS), F.lower(F.left(name, F.lit(3)))).cast("int")


_POINT = r"(?:(?:([A-Za-z]{3,9})[\s.,]+)?((?:19|20)\d{2})|(0?[1-9]|1[0-2])[/-]((?:19|20)\d{2}))"
RANGE = rf"(?i){_POINT}\s*(?:-|–|—|to|until|till|→)\s*(?:{_POINT}|(present|current|now|to\s?date|ongoing))"


def month_ranges(rows: DataFrame, key: str, text: str, as_of: tuple[int, int]) -> DataFrame:
    """(key, s, e): inclusive month numbers (year * 12 + month - 1) of all date ranges; ``as_of`` (year, month) is the present.

    A missing start month is January, a missing end month December. Reversed
    ranges are turned; those that start later or span over 45 years go; ends are cut.
    """
    now = as_of[0] * 12 + as_of[1] - 1
    found = rows.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(RANGE), F.lit(0))).alias("r"))
    part = lambda i: F.nullif(F.regexp_extract("r", RANGE, i), F.lit(""))
    number = lambda year, month, default: year.cast("int") * 12 + F.coalesce(month, F.lit(default)) - 1
    month = lambda name, digits: F.coalesce(F.nullif(_month(name), F.lit(0)), digits.cast("int"))
    s = number(F.coalesce(part(2), part(4)), month(part(1), part(3)), 1)
    e = F.when(part(9).isNotNull(), now).otherwise(number(F.coalesce(part(6), part(8)), month(part(5), part(7)), 12))
    out = found.select(key, F.least(s, e).alias("s"), F.greatest(s, e).alias("e"))
    return out.filter((F.col("s") <= now) & (F.col("e") - F.col("s") <= 12 * 45)).select(key, "s", F.least("e", F.lit(now)).alias("e"))


def tenure(rows: DataFrame, key: str, text: str, as_of: tuple[int, int]) -> DataFrame:
    """Months covered by the ranges of each key, parallel ones once, with years and seniority."""
    months = covered(merge_intervals(month_ranges(rows, key, text, as_of), key, "s", "e"), key)
    years = F.round(F.col("covered") / 12, 1)
    return months.select(key, F.col("covered").alias("months"), years.alias("years"), seniority(years).alias("seniority"))


def seniority(years: Column) -> Column:
    return F.when(years.isNull(), "unknown").when(years < 1, "entry").when(years < 3, "junior").when(years < 6, "mid").when(years < 10, "senior").otherwise("principal")


def readiness(technologies: Column, demonstrated: Column, concepts: Column, years: Column, education: Column, certifications: Column, projects: Column, chars: Column) -> Column:
    """0 to 100 from eight capped parts; ``education``: 10 for a higher degree, 8 for a degree, 5 for an entry, else 0."""
    cap = lambda n, each, most: F.least(n * each, F.lit(most))
    detail = F.when(chars > 1800, 4.0).when(chars > 600, 2.0).otherwise(0.0)
    total = (
        cap(technologies, 2.2, 22.0) + cap(demonstrated, 3.0, 18.0) + cap(concepts, 2.2, 14.0) + cap(F.coalesce(years, F.lit(0.0)), 4.0, 20.0) + education
        + cap(certifications, 3.0, 8.0) + cap(projects, 2.0, 8.0) + detail
    )
    return F.least(total, F.lit(100.0))


def tracks(cvs: DataFrame, key: str, have: str, demonstrated: str, signals: dict[str, list[str]], k: int = 4) -> DataFrame:
    """The ``k`` tracks with most matched signals; demonstrated ones count twice in the confidence."""
    each = []
    for i, (name, wanted) in enumerate(signals.items()):
        hit = F.array_intersect(T.strs(wanted), F.col(have))
        weight = F.size(hit) + F.size(F.array_intersect(hit, F.col(demonstrated)))
        sure = F.round(F.least(F.lit(1.0), weight / (len(wanted) * 2) * 2.4), 2)
        each.append(F.struct((-F.size(hit)).alias("order"), (-sure).alias("unsure"), F.lit(i).alias("i"), F.lit(name).alias("track"), F.slice(hit, 1, 8).alias("matched")))
    best = F.slice(F.array_sort(F.filter(F.array(*each), lambda t: t["order"] < 0)), 1, k)
    rows = cvs.select(key, F.posexplode(best).alias("place", "t"))
    return rows.select(key, (F.col("place") + 1).alias("place"), "t.track", (-F.col("t.order")).alias("matches"), (-F.col("t.unsure")).alias("confidence"), "t.matched")


def contacts(text: Column) -> Column:
    """E-mail addresses, phone numbers of 9 to 15 digits, and links, at most five.

    Digits of a phone have one mark or space between them at most, and no letter
    or slash goes on at either end: a number before a date is none.
    """
    mails = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1))
    phones = F.filter(F.regexp_extract_all(text, F.lit(r"((?<![\p{L}\p{N}_/])\+?[0-9](?:(?:[.-]|\s?\(|\)\s?|\s)?[0-9]){8,}(?![\p{L}\p{N}_/]))"), F.lit(1)), lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(9, 15))
    links = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?:https?://|www\.)[^\s,;]+)"), F.lit(1))), 1, 5)
    return F.struct(mails.alias("emails"), phones.alias("phones"), links.alias("links"))


def share_found(*signals: Column) -> Column:
    """Share of the signals that hold, to two places."""
    return F.round(sum((s.cast("int") for s in signals), F.lit(0)) / len(signals), 2)


def zones(rows: DataFrame, key: str) -> DataFrame:
    """(key, skills, experience, projects, summary, whole): the lower-case text of each section, and of all, from ``lines``."""
    text = lambda wanted: F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("line_no", "line")))), lambda r: r["line"]), "\n"))
    each = [text(F.col("section") == s).alias(s) for s in ("skills", "experience", "projects", "summary")]
    return rows.groupBy(key).agg(*each, text(F.lit(True)).alias("whole"))


def skills(texts: DataFrame, key: str) -> DataFrame:
    """(key, technologies, concepts, demonstrated, evidence) of ``zones``: what is named where.

    Evidence lists the sections that name a technology, "other" only if none of
    them does; one that experience or projects name is demonstrated.
    """
    places = ("skills", "experience", "projects", "summary")
    found = []
    for name, pattern in L.TECHNOLOGIES.items():
        at = F.array_compact(F.array(*(F.when(F.regexp_like(z, F.lit(pattern)), z_name) for z_name in places for z in [F.col(z_name)])))
        # the list is bound to a name, so each zone is searched once
        at = F.transform(F.array(at), lambda a: F.when(F.size(a) > 0, a).when(F.regexp_like("whole", F.lit(pattern)), F.array(F.lit("other"))))[0]  # noqa: B023
        found.append(F.struct(F.lit(name).alias("name"), at.alias("at")))
    concepts = F.array_compact(F.array(*(F.when(F.regexp_like("whole", F.lit(p)), n) for n, p in L.SKILLS.items())))
    rows = texts.select(key, F.filter(F.array(*found), lambda t: t["at"].isNotNull()).alias("_f"), concepts.alias("concepts"))
    shown = F.filter("_f", lambda t: F.array_contains(t["at"], "experience") | F.array_contains(t["at"], "projects"))
    names = lambda a: F.transform(a, lambda t: t["name"])
    return rows.select(key, names(F.col("_f")).alias("technologies"), "concepts", names(shown).alias("demonstrated"), F.map_from_entries("_f").alias("evidence"))


def declared_years(text: Column) -> Column:
    """The most years of experience, up to 45, that a text claims; null if it claims none."""
    claim = r"(?i)([0-9]{1,2})\s*\+?\s*(?:years?|yrs?)(?:\s+of)?\s+(?:professional\s+|industry\s+)?experience"
    return F.array_max(F.filter(F.transform(F.regexp_extract_all(text, F.lit(claim), F.lit(1)), lambda n: n.cast("int")), lambda n: n.between(1, 45)))


def total_years(months: Column, declared: Column) -> Column:
    """The larger of what dates show and what is claimed; null if there is neither."""
    return F.greatest(F.when(months > 0, F.round(months / 12, 1)), declared.cast("double"))


def name_of(header: Column, email: Column) -> Column:
    """The first of six header lines that looks like a name, else one made from the e-mail's parts; null if neither will do."""
    tidy = F.transform(F.slice(header, 1, 6), lambda x: F.regexp_replace(x, r"^[ .,|\-]+|[ .,|\-]+$", ""))
    fits = lambda x: (
        ~F.regexp_like(x, F.lit(L.NOT_A_NAME)) & ~F.contains(x, F.lit("@")) & ~F.regexp_like(x, F.lit(r"\d")) & F.size(T.words(x)).between(2, 4)
        & F.forall(T.words(x), lambda w: F.regexp_like(w, F.lit(r"^(?:[A-Z][a-z'\-]+|[A-Z.'\-]{2,})$")))
    )
    plain = F.array_join(F.transform(T.words(F.get(F.filter(tidy, fits), F.lit(0))), lambda w: F.when((F.upper(w) == w) & (F.length(w) > 2), F.initcap(F.lower(w))).otherwise(w)), " ")
    parts = F.filter(F.split(F.substring_index(email, "@", 1), r"[._\-0-9]+"), lambda p: F.length(p) > 1)
    made = F.when(F.size(parts) >= 2, F.array_join(F.transform(F.slice(parts, 1, 3), F.initcap), " "))
    return F.coalesce(F.nullif(plain, F.lit("")), made)


def roles(rows: DataFrame, key: str, as_of: tuple[int, int], k: int = 6) -> DataFrame:
    """(key, place, title, months): the roles of the experience lines, at most ``k``, each title once.

    A line of dates alone belongs to the role above if that has none yet; one
    before any role counts for no role (but for the tenure).
    """
    lines_ = rows.filter("section = 'experience' AND length(line) >= 6").withColumn("_t", F.nullif(F.regexp_extract("line", L.JOB_TITLE, 1), F.lit("")))
    dated = month_ranges(lines_.withColumn("_id", F.struct(key, "line_no")), "_id", "line", as_of)
    months = covered(merge_intervals(dated, "_id", "s", "e"), "_id").select(F.col("_id").alias("_m"), F.col("covered").cast("int").alias("months"))
    lines_ = lines_.join(months, F.struct(key, "line_no") == F.col("_m"), "left").filter("_t IS NOT NULL OR months IS NOT NULL")
    w = Window.partitionBy(key).orderBy("line_no")
    lines_ = lines_.withColumn("_role", F.count("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_role > 0")
    each = lines_.groupBy(key, "_role").agg(F.min_by("_t", "line_no").alias("title"), F.min_by("months", F.when(F.col("months").isNotNull(), F.col("line_no"))).alias("months"))
    each = each.withColumn("title", F.initcap(F.regexp_replace(T.strip(F.col("title")), r"\s{2,}", " ")))
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy(key, F.lower("title")).orderBy("_role"))).filter("_r = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_role"))).filter(F.col("place") <= k).select(key, "place", "title", "months")
