"""Qualifications in CV lines: education with its sequential rules, certifications, projects, employers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T

#: Entries that are kept.
EDUCATION, CERTIFICATIONS, PROJECTS = 4, 6, 5
ENTRY = "struct<label: string, degree: string, field: string, institution: string, year: int>"
STATE = f"struct<skip: boolean, seen: array<string>, out: array<{ENTRY}>>"


def trimmed(text: Column, chars: str) -> Column:
    """Without these characters at the ends; ``chars`` is the inside of a character class."""
    return F.regexp_replace(text, rf"^[{chars}]+|[{chars}]+$", "")


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"\s{2,}", " ")


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def title_case(text: Column) -> Column:
    """A capital wherever a letter follows none."""
    parts = F.split(F.lower(text), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), "")


def key_of(text: Column) -> Column:
    """Letters, digits and underscores, lower-case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def institution(line: Column) -> Column:
    """The institution a line names: the line, or its part between commas, without dates and grades at its end."""
    bare = trimmed(F.regexp_replace(line, L.INSTITUTION_TAIL, ""), r" .,;:|\-")
    part = F.get(F.filter(F.transform(F.split(bare, r"\s*[,|]\s*"), T.strip), lambda p: F.regexp_like(p, F.lit(L.INSTITUTION))), F.lit(0))
    name = trimmed(single_spaced(F.coalesce(part, bare)), r" .,;:|\-")
    name = F.regexp_replace(F.regexp_replace(name, r"(?i)^(at|from|the)\s+", ""), r"\s*[\(\[].*$", "")
    shouted = (F.upper(name) == name) & (F.lower(name) != name)
    return F.when(F.regexp_like(line, F.lit(L.INSTITUTION)) & F.length(name).between(4, 70), F.when(shouted, title_case(name)).otherwise(name))


def degree_name(degree: Column) -> Column:
    """The usual way to write a degree."""
    known = F.create_map(*(F.lit(x) for kv in L.DEGREE_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(degree), r"[. ]", "")), title_case(T.strip(degree)))


def _said(rows: DataFrame) -> DataFrame:
    """What each line says by itself, found once: its institution, degree, field and last year."""
    line = F.col("line")
    years = F.transform(F.regexp_extract_all(line, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    rows = rows.withColumns({"here": institution(line), "degree": first_match(line, L.DEGREE), "field": trimmed(first_match(line, L.FIELD_OF_STUDY), r" .,\-"), "year": F.array_max(years)})
    return rows.withColumn("name", degree_name(F.col("degree")))


def _read(at: Column, after: Column) -> Column:
    """What a line says by itself and with the one after it."""
    line, here, below, degree, name, field = at["line"], at["here"], after["here"], at["degree"], at["name"], at["field"]
    place = F.coalesce(here, below)
    parts = F.array_compact(F.array(name, F.concat(F.lit("in "), field)))
    label = F.when(F.size(parts) == 0, F.coalesce(place, F.left(line, F.lit(70)))).when(place.isNotNull(), F.concat(F.array_join(parts, " "), F.lit(", "), place)).otherwise(F.array_join(parts, " "))
    return F.struct(
        ((F.length(line) >= 5) & (degree.isNotNull() | place.isNotNull())).alias("ok"), (here.isNull() & below.isNotNull() & degree.isNotNull() & (F.length(line) >= 5)).alias("takes"), key_of(label).alias("key"), label.alias("label"),
        name.alias("degree"), field.alias("field"), place.alias("institution"), F.greatest(at["year"], after["year"]).alias("year"),
    )


def education(rows: DataFrame, key: str) -> DataFrame:
    """(key, place, label, degree, field, institution, year): the first four entries of the education lines.

    Lines are taken in order. A degree without an institution takes that of the
    next line, which then isn't an entry of its own; an institution without a
    degree goes to the entry above if that has none. Equal entries count once.
    The entries kept can't change after a fifth one, so the state stays small however many lines there are.
    """
    lines = F.col("lines")
    read = F.transform(lines, lambda x, i: _read(x, F.get(lines, i + 1)))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        entry = F.struct(trimmed(single_spaced(x["label"]), r" .,\-").alias("label"), x["degree"].alias("degree"), x["field"].alias("field"), x["institution"].alias("institution"), x["year"].alias("year")).cast(ENTRY)
        joined = F.struct(
            F.concat(last["label"], F.lit(", "), x["institution"]).alias("label"), last["degree"].alias("degree"), last["field"].alias("field"), x["institution"].alias("institution"), F.coalesce(x["year"], last["year"]).alias("year"),
        ).cast(ENTRY)
        folds = x["degree"].isNull() & x["institution"].isNotNull() & last.isNotNull() & last["institution"].isNull()
        state = lambda skip, seen, out: F.struct(skip.alias("skip"), seen.alias("seen"), out.alias("out")).cast(STATE)
        no = F.lit(False)
        return (
            F.when(acc["skip"] | ~x["ok"] | (F.size(acc["out"]) > EDUCATION), state(no, acc["seen"], acc["out"]))
            .when(F.array_contains(acc["seen"], x["key"]), state(x["takes"], acc["seen"], acc["out"]))
            .when(folds, state(x["takes"], acc["seen"], F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(joined))))
            .otherwise(state(x["takes"], F.array_append(acc["seen"], x["key"]), F.array_append(acc["out"], entry)))
        )

    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<{ENTRY}>").alias("out")).cast(STATE)
    # lines are read once each, before they are taken in order
    said = _said(rows.filter("section = 'education'").select(key, "line_no", "line"))
    held = said.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "here", "degree", "name", "field", "year"))).alias("lines"))
    found = held.select(key, F.aggregate(read, start, step, lambda acc: F.slice(acc["out"], 1, EDUCATION)).alias("e"))
    return found.select(key, F.posexplode("e").alias("at", "e")).select(key, (F.col("at") + 1).alias("place"), "e.*")


def _firsts(found: DataFrame, key: str, k: int) -> DataFrame:
    """(key, place, name) of the first ``k`` different names in order of ``at``."""
    once = found.groupBy(key, "id").agg(F.min(F.struct("at", "name")).alias("m"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("m.at"))
    return once.withColumn("place", place).filter(F.col("place") <= k).select(key, "place", "m.name")


def certifications(rows: DataFrame, key: str) -> DataFrame:
    """(key, place, name): the first six certifications named in certification, education and award lines; in the first of these a line without a known one is one itself."""
    scope = F.coalesce(*(F.when(F.col("section") == s, i) for i, s in enumerate(("certifications", "education", "awards"))))
    named = F.filter(F.transform(F.regexp_extract_all("line", F.lit(L.CERTIFICATION), F.lit(1)), lambda c: trimmed(single_spaced(c), r" .,;:|\-")), lambda c: F.length(c).between(6, 80))
    line = trimmed(F.col("line"), r" .,;:|\-•*")
    plain = (scope == 0) & ~F.regexp_like("line", F.lit(L.CERTIFICATION)) & F.length(line).between(8, 80) & ~F.regexp_like(line, F.lit(r"^(19|20)\d{2}"))
    found = rows.filter(scope.isNotNull()).select(key, scope.alias("s"), "line_no", F.posexplode(F.when(plain, F.array(line)).otherwise(named)).alias("i", "name"))
    return _firsts(found.select(key, "name", key_of(F.col("name")).alias("id"), F.struct("s", "line_no", "i").alias("at")), key, CERTIFICATIONS)


def projects(rows: DataFrame, key: str) -> DataFrame:
    """(key, place, name): the first five project headings, without the list of tools behind them; sentences about duties are none."""
    line = trimmed(F.col("line"), r" .,;:|\-•*–")
    head = T.strip(F.get(F.split(line, r"\s*[–—|:]\s*|\s+-\s+"), F.lit(0)))
    name = F.when(F.length(head).between(4, 70), head).otherwise(F.left(line, F.lit(70)))
    fits = F.length(line).between(6, 90) & ~F.exists(T.strs(L.NOT_A_PROJECT), lambda w: F.startswith(F.lower(line), w))
    found = rows.filter((F.col("section") == "projects") & fits).select(key, name.alias("name"), F.lower(name).alias("id"), F.col("line_no").alias("at"))
    return _firsts(found, key, PROJECTS)


def _organisation_name(text: Column) -> Column:
    name = F.regexp_replace(trimmed(single_spaced(text), r" .,;:|\-"), r"\s*\((19|20)\d{2}.*$", "")
    kept = F.array_join(F.filter(T.words(name), lambda w: ~F.regexp_like(w, F.lit(r"(?i)^(the|a|an|and|at|for|in|of|with|using|to)$"))), " ")
    return F.when(F.length(kept).between(2, 60) & F.regexp_like(kept, F.lit(r"[A-Za-z]{2}")), kept)


def organisation(line: Column, title: Column) -> Column:
    """The employer in a line about a role: what follows "at", else a part that is a name of two to six words."""
    after = first_match(line, r"\bat\s+([A-Z][\w&.'-]*(?:\s+[A-Z(][\w&.'()-]*){0,4})")
    parts = F.transform(F.split(line, r"[|•–—,;]"), T.strip)
    fits = lambda p: (
        (p != "") & (F.lower(p) != F.lower(title)) & ~F.regexp_like(p, F.lit(r"(19|20)\d{2}")) & ~F.regexp_like(p, F.lit(f"^(?:{L.JOB_TITLE})$".replace("(?i)", "").replace("^", "(?i)^", 1)))
        & F.regexp_like(p, F.lit(r"^[A-Z]")) & F.size(T.words(p)).between(2, 6)
    )
    return F.when(after.isNotNull(), _organisation_name(after)).when(title.isNotNull(), _organisation_name(F.get(F.filter(parts, fits), F.lit(0))))
