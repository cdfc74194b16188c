"""Queries of what other services send or keep: responses, positions, greedy matches, qualifications, fitted intents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators import audio as U
from parley.operators import cv as C
from parley.operators import dashboard as D
from parley.operators import intents as I
from parley.operators import matching as M
from parley.operators import normalise as N
from parley.operators import performance as P2
from parley.operators import qualifications as K
from parley.operators import scoring
from parley.operators import sessions as Z
from parley.operators import sounds as W
from parley.operators import transcripts as X
from parley.plans import sessions as P
from parley.plans import sql as Q
from parley.plans.tables import table
from parley.sources import readers as S


def turn_intents_fitted(spark, sf_dir):
    """Intents of all turns; those of middle length by the classifier fitted on the labelled turns."""
    return I.classified(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", I.fit_intents(I.labelled_turns(spark)))


def greedy_matches(spark, sf_dir):
    """How well vectors of even and of odd id find one like them under each label."""
    v = table(spark, sf_dir, "embeddings").withColumn("even", F.col("vec_id") % 2 == 0)
    r = lambda c: F.round(c, 6).alias(c)
    return M.greedy_match(v, "label", "even", "embedding").select(F.col("pair").alias("label"), "n_left", "n_right", r("precision"), r("recall"), r("f1"))


def positional_ids(spark, sf_dir):
    return S.with_positional_id(table(spark, sf_dir, "documents"), "interviews").select("raw_id", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


#: Bodies of responses, by the number of an event: whole, mistyped, with what was extracted only, no object, not JSON.
_SHAPES = [
    '{{"skills": ["{type}", 3, null, "user {user}"], "technologies": [], "extracted_info": {{"technologies": ["t{user}", {{"a": 1}}], "education": ["e"]}}, "yearsTotal": {value}, "seniority": "mid", "readinessScore": {value}, '
    '"contact": {{"name": "n{user}", "email": null, "links": ["l", 5]}}, "readinessBreakdown": {props}, "rawText": "raw", "warnings": ["w"]}}',
    '{{"skills": "{type}", "technologies": {{"x": 1}}, "extracted_info": {{"skills": [1, 2]}}, "yearsTotal": "{value}", "seniority": 4, "readinessScore": "{value}", "contact": [], "readinessBreakdown": [1], "text": "plain", "domains": ["d{user}"], "suggestedTracks": [null]}}',
    '{{"extracted_info": {{"skills": ["{type}"], "projects": ["p"]}}, "yearsTotal": null, "readinessScore": 7.5, "suggestedTracks": ["s", "t"], "extractionConfidence": 0.25, "educationDetail": [{{"a": 1}}], "contact": {{"links": "l", "phone": "+1"}}}}',
    '["{type}"]', '{{"skills": ["{type}"',
]


def _bodies(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    fields = {"type": F.col("event_type"), "user": F.col("user_id").cast("string"), "value": F.col("value").cast("string"), "props": F.col("props")}

    def filled(shape):
        text = F.lit(shape.replace("{{", "\x01").replace("}}", "\x02"))
        for name, value in fields.items():
            text = F.replace(text, F.lit("{" + name + "}"), value)
        return F.translate(text, "\x01\x02", "{}")

    # only the shape of an event is filled
    body = reduce(lambda c, i: c.when(F.col("event_id") % len(_SHAPES) == i, filled(_SHAPES[i])), range(1, len(_SHAPES)), F.when(F.col("event_id") % len(_SHAPES) == 0, filled(_SHAPES[0])))
    return e.select("event_id", body.alias("body"))


_LISTS = ("contact_links", "skills", "technologies", "education", "experience", "certifications", "projects", "demonstrated", "tracks", "sections", "warnings")


def normalised_responses(spark, sf_dir):
    """Responses with a column of the right type for each part, whatever they hold."""
    rows = N.normalised(_bodies(spark, sf_dir), "body")
    lists = [F.array_join(c, "|").alias(c) for c in _LISTS]
    return rows.select("event_id", "ok", "contact_name", "contact_email", "contact_phone", *lists, "years_total", "seniority", "readiness", "breakdown", "education_detail", "experience_detail", "confidence", "raw_text")


def trimmed_resources(spark, sf_dir):
    """Resources kept as JSON lists, read back without what triggers them; lists that can't be read are empty."""
    kind = "array<struct<title: string, url: string, triggers: array<string>>>"
    one = F.format_string('{"title": "t%d", "url": "u", "triggers": ["%s"]}', F.col("user_id"), F.col("event_type"))
    held = F.when(F.col("event_id") % 4 == 0, F.lit("{bad")).when(F.col("event_id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    rows = table(spark, sf_dir, "events").select("event_id", N.without(N.parsed_or_empty(held, kind), "triggers").alias("r"))
    return rows.select("event_id", F.to_json("r").alias("resources"))


_EDUCATION = [
    "B.Sc. (Hons) in Software Engineering", "University of Region %d, 2014 - %y", "M.Sc. in Data Science, Institute %d", "Graduated with honours in the year %y", "Diploma in Networks %d (2016)", "NATIONAL COLLEGE NO %d", "HND",
    "the Academy of Arts %d (2015)", "Bachelor of Arts in Design from City Campus %d, %y", "GPA: 3.5", "MBA",
]
_OTHERS = [
    ("projects", "Project %d - Spark, Kafka"), ("projects", "Developed a store for %d"), ("certifications", "AWS Certified Developer %d"), ("certifications", "Course on testing %d"), ("awards", "Winner, Oracle Certified Professional %d"), ("projects", "Chat App %d | React"),
]


def _qualified(spark, sf_dir):
    """Lines of CVs: each order of a customer is a line about education, and one about something else."""
    o = table(spark, sf_dir, "orders")
    pick = lambda values, k: F.element_at(T.strs(values), (k % len(values) + 1).cast("int"))
    filled = lambda text: F.replace(F.replace(text, F.lit("%d"), (F.col("o_orderkey") % 5).cast("string")), F.lit("%y"), F.year("o_orderdate").cast("string"))
    education = o.select(F.col("o_custkey").alias("cv_id"), F.col("o_orderkey").alias("line_no"), filled(pick(_EDUCATION, F.floor(F.col("o_orderkey") / 3) + F.col("o_custkey"))).alias("line"), F.lit("education").alias("section"))
    k = F.col("o_orderkey")
    other = o.select(F.col("o_custkey").alias("cv_id"), k.alias("line_no"), filled(pick([t for _, t in _OTHERS], k)).alias("line"), pick([s for s, _ in _OTHERS], k).alias("section"))
    return education.unionByName(other)


def cv_education(spark, sf_dir):
    """The first education entries of each CV, degrees and institutions of neighbouring lines joined."""
    return K.education(_qualified(spark, sf_dir), "cv_id")


def cv_certifications(spark, sf_dir):
    return K.certifications(_qualified(spark, sf_dir), "cv_id")


def cv_projects(spark, sf_dir):
    return K.projects(_qualified(spark, sf_dir), "cv_id")


_TITLES = ["Software Engineer at Ceylon Systems %d Ltd", "Data Analyst | Region %d Holdings | 2021-2023", "Senior developer, 2020", "QA Engineer – Blue River Works, Colombo"]


def cv_employers(spark, sf_dir):
    """Title and employer of lines about roles."""
    k = F.col("o_orderkey")
    line = F.replace(F.element_at(T.strs(_TITLES), (k % len(_TITLES) + 1).cast("int")), F.lit("%d"), (k % 7).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")).withColumn("title", K.first_match(F.col("line"), L.JOB_TITLE))
    return rows.select("o_orderkey", "title", K.organisation(F.col("line"), F.col("title")).alias("employer"))


def salient_terms(spark, sf_dir):
    """The term of each turn to ask about; turns are given terms by their number, as the tables have few."""
    named = F.element_at(T.strs(["", " We used Node.js and caches", " the websockets of GraphQL", " myService and Kafka", " a CI-CD line", " INDEXES..."]), ((F.col("turn") + F.col("conv_id")) % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), named).alias("t"))
    return rows.select("conv_id", "turn", scoring.salient_term(F.col("t")).alias("term"))


def conversation_scores(spark, sf_dir):
    """Mean scores of the answers of each conversation, 50 without any."""
    turns = table(spark, sf_dir, "conversations")
    pairs = Z.pair_preceding(turns, "conv_id", "turn", "role", "text")
    rows = pairs.select("conv_id", F.round(scoring.communication(F.col("answer")), 6).alias("communication"), F.round(scoring.technical(F.col("answer")), 6).alias("technical"))
    return D.conversation_scores(rows, "conv_id", ["communication", "technical"], turns)


def next_ordinals(spark, sf_dir):
    return D.next_ordinal(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def first_texts(spark, sf_dir):
    """The first of three columns that isn't blank."""
    k = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, F.col("text")).when(k == 1, "  \n").alias("a"), F.when(k == 1, F.col("lang")).when(k == 2, "").alias("b"), F.when(k < 3, F.col("source")).alias("c"))
    return rows.select("doc_id", F.md5(Z.first_text("a", "b", "c")).alias("digest"))


_SHOWN = ["Python", "Docker", "SQL", "Kafka", "Redis", "GraphQL"]


def _people(spark, sf_dir):
    """CVs of customers: a name, what they know, one role with dates and tools, a project, and years they claim."""
    k = F.col("c_custkey")
    pick = lambda values, at: F.element_at(T.strs(values), (at % len(values) + 1).cast("int"))
    name = pick(["Ann Lee", "BO GRANT", "Curriculum Vitae", "Dee Ohara"], k)
    text = F.concat_ws(
        "\n", name, F.concat(F.lit("mail: "), pick(["eva.stone", "x1", "max_born"], k), F.lit("@mail.example")), F.lit("Summary"), F.when(k % 3 == 0, F.format_string("I have %d+ years of professional experience", k % 60)).otherwise("A person"),
        F.lit("Skills"), F.concat_ws(", ", pick(_SHOWN, k), pick(_SHOWN, k + 1)), F.lit("Work Experience"), F.concat(pick(["Senior Software Engineer", "data analyst", "QA Lead"], k), F.lit(" at Somewhere")), F.lit("Jan 2015 - Dec 2016"),
        F.concat(F.lit("Built things with "), pick(_SHOWN, k + 2)), F.lit("Projects"), F.concat(F.lit("A tool in "), pick(_SHOWN, k)),
    )
    return table(spark, sf_dir, "customer").select(k.alias("cv_id"), text.alias("text"))


def cv_skills(spark, sf_dir):
    """Technologies of each CV and where they are named; those of roles and projects are demonstrated."""
    rows = C.skills(C.zones(C.lines(_people(spark, sf_dir), "cv_id", "text"), "cv_id"), "cv_id")
    names = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return rows.select("cv_id", names("technologies"), names("demonstrated"))


def cv_names(spark, sf_dir):
    lines = C.lines(_people(spark, sf_dir), "cv_id", "text").filter("section = 'header'")
    header = lines.groupBy("cv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]).alias("h"))
    mail = F.get(F.flatten(F.transform("h", lambda x: C.contacts(x)["emails"])), F.lit(0))
    return header.select("cv_id", C.name_of(F.col("h"), mail).alias("name"))


def cv_roles(spark, sf_dir):
    return C.roles(C.lines(_people(spark, sf_dir), "cv_id", "text"), "cv_id", (2024, 6))


def cv_years(spark, sf_dir):
    """Years of each CV: the larger of what its dates show and what it claims."""
    cvs = _people(spark, sf_dir)
    months = C.tenure(C.lines(cvs, "cv_id", "text").filter("section = 'experience'"), "cv_id", "line", (2024, 6)).select("cv_id", "months")
    return cvs.join(months, "cv_id", "left").select("cv_id", C.declared_years(F.col("text")).alias("declared"), C.total_years(F.col("months"), C.declared_years(F.col("text"))).alias("years"))


def performance_classes(spark, sf_dir):
    """The class of each candidate whose feature vector is made from a vector's parts; a tenth have none and go by bands."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("e"))
    sure, fluent = F.col("vec_id") % 100 + F.lit(0.0), F.lit(60.0)
    f = U.feature_vector(F.col("vec_id") % 220, fluent, sure, F.slice("e", 1, 4), F.transform(F.slice("e", 9, 8), lambda x: x * 1000), F.lit(0.2), F.slice("e", 1, 13))
    rows = v.select("vec_id", F.when(F.col("vec_id") % 10 > 0, f).alias("f"), sure.alias("sure"), fluent.alias("fluent"))
    return P2.performance_classes(rows, "f", P2.fit_performance(P2.made_up(spark)), F.col("sure"), F.col("fluent")).select("vec_id", "class", "by")


def composed_transcripts(spark, sf_dir):
    """Turns as transcripts in two languages: letters taken apart are composed, joiners and loops of words go."""
    apart = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\u00e9"), F.lit("e\u0301")), F.lit("\u00e8"), F.lit("e\u0300"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(apart, F.lit(" \u0d9a\u0dca\u200d\u0dbb x\u200d same same same same .")).alias("t"), F.when(F.col("turn") % 2 == 0, "si").otherwise("en").alias("language"))
    return t.select("conv_id", "turn", F.md5(X.clean(F.col("t"), F.col("language"))).alias("clean"), F.md5(X.plain_for_errors(F.col("t"))).alias("plain"))


def sound_features(spark, sf_dir):
    """Features of sounds made from vectors: each part is a tone as loud as the part is large."""
    part = lambda x, k: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: x.cast("double") * F.sin(i * (k + 1) * 0.02))
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.transform("embedding", part)).alias("y"), F.lit(16_000).alias("rate"))
    mean = lambda c: F.round(U.mean(F.col(c)), 5).alias(c)
    rows = W.features(W.prepared(v, "vec_id", "y", "rate"), "id", "samples", "rate")
    return rows.select(F.col("id").alias("vec_id"), F.size("rms").alias("frames"), mean("rms"), mean("zcr"), F.round(F.get("mfcc_mean", F.lit(0)), 3).alias("first"), F.round("silence_ratio", 5).alias("silence"), F.round("duration_seconds", 5).alias("seconds"))


QUERIES = [sound_features, performance_classes, composed_transcripts, salient_terms, conversation_scores, next_ordinals, first_texts, cv_skills, cv_names, cv_roles, cv_years, turn_intents_fitted, greedy_matches, positional_ids, normalised_responses, trimmed_resources, cv_education, cv_certifications, cv_projects, cv_employers]

_J = lambda path: f"json_extract(j, '{path}')"
_IS = lambda path, kind: f"json_type(j, '{path}') = '{kind}'"
_STRINGS = lambda path: f"CASE WHEN {_IS(path, 'ARRAY')} THEN list_transform(list_filter(json_extract(j, '{path}[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') ELSE [] END"
_EITHER = lambda a, b: f"CASE WHEN len({_STRINGS(a)}) > 0 THEN {_STRINGS(a)} ELSE {_STRINGS(b)} END"
_NUMBER = lambda path: f"CASE WHEN json_type(j, '{path}') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN (j->>'{path}')::DOUBLE END"
_STRING = lambda path: f"CASE WHEN {_IS(path, 'VARCHAR')} THEN j->>'{path}' END"
_JSON = lambda path, kind, default: f"CASE WHEN {_IS(path, kind)} THEN {_J(path)}::VARCHAR ELSE '{default}' END"


def _shape(text: str) -> str:
    out = Q.lit(text.replace("{{", "\x01").replace("}}", "\x02"))
    for name, value in (("type", "event_type"), ("user", "user_id::VARCHAR"), ("value", "value::VARCHAR"), ("props", "props")):
        out = f"replace({out}, '{{{name}}}', {value})"
    return out.replace("\x01", "{").replace("\x02", "}")


_LIST_SQL = {"contact_links": _STRINGS("$.contact.links"), **{c: _EITHER(f"$.{c}", f"$.extracted_info.{c}") for c in ("skills", "technologies", "education", "experience", "certifications", "projects")}, "demonstrated": _STRINGS("$.demonstratedTechnologies"),
             "tracks": _EITHER("$.suggestedTracks", "$.domains"), "sections": _STRINGS("$.sectionsFound"), "warnings": _STRINGS("$.warnings")}
_TITLE = lambda x: f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), lambda p: upper(p[1]) || p[2:]), '')"
_TRIM = lambda x, chars: f"regexp_replace({x}, '^[{chars}]+|[{chars}]+$', '', 'g')"
_SPACES = lambda x: f"regexp_replace({x}, '\\s{{2,}}', ' ', 'g')"
_BARE = lambda x: _TRIM(f"regexp_replace({x}, {Q.lit(L.INSTITUTION_TAIL)}, '')", " .,;:|\\-")
_PLACE0 = lambda x: f"coalesce(list_filter(list_transform(regexp_split_to_array({_BARE(x)}, '\\s*[,|]\\s*'), lambda p: trim(p)), lambda p: regexp_matches(p, {Q.lit(L.INSTITUTION)}))[1], {_BARE(x)})"
_PLACE1 = lambda x: f"regexp_replace(regexp_replace({_TRIM(_SPACES(_PLACE0(x)), ' .,;:|\\-')}, '(?i)^(at|from|the)\\s+', ''), '\\s*[\\(\\[].*$', '')"
_PLACE = lambda x, name: f"CASE WHEN regexp_matches({x}, {Q.lit(L.INSTITUTION)}) AND length({name}) BETWEEN 4 AND 70 THEN CASE WHEN upper({name}) = {name} AND lower({name}) <> {name} THEN {_TITLE(name)} ELSE {name} END END"
_FILL = "replace(replace({}, '%d', (o_orderkey % 5)::VARCHAR), '%y', year(o_orderdate)::VARCHAR)"
_DEGREES = "CASE regexp_replace(lower(d), '[. ]', '', 'g') " + " ".join(f"WHEN {Q.lit(k)} THEN {Q.lit(v)}" for k, v in L.DEGREE_NAMES.items()) + f" ELSE {_TITLE('trim(d)')} END"
_OTHER = f"ot AS (SELECT o_custkey AS cv_id, o_orderkey AS line_no, {_FILL.format(Q.arr([t for _, t in _OTHERS]) + f'[o_orderkey % {len(_OTHERS)} + 1]')} AS line, {Q.arr([s for s, _ in _OTHERS])}[o_orderkey % {len(_OTHERS)} + 1] AS section FROM orders)"
_SCHOOL = f"ed AS (SELECT o_custkey AS cv_id, o_orderkey AS line_no, {_FILL.format(Q.arr(_EDUCATION) + f'[(o_orderkey // 3 + o_custkey) % {len(_EDUCATION)} + 1]')} AS line, 'education' AS section FROM orders)"

_PROBE = Q.tup([*L.PROBE_CONCEPTS, *L.PROBE_PRODUCTS])
_SHOW = lambda at: f"{Q.arr(_SHOWN)}[(c_custkey + {at}) % {len(_SHOWN)} + 1]"

ORACLE = {
    "salient_terms": f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') || ['', ' We used Node.js and caches', ' the websockets of GraphQL', ' myService and Kafka', ' a CI-CD line', ' INDEXES...'][(turn + conv_id) % 6 + 1] AS t FROM conversations),
r AS (SELECT conv_id, turn, len({Q.words('t')}) AS n, regexp_extract_all(t, {Q.lit(scoring.TERM)}, 1) AS raws FROM t),
u AS (SELECT conv_id, turn, raw, regexp_replace(lower(raw), '^\\.+|\\.+$', '', 'g') AS low FROM r, unnest(raws) x(raw) WHERE n >= 8),
v AS (SELECT *, low IN {_PROBE} OR regexp_replace(low, 's+$', '') IN {_PROBE} AS known, regexp_matches(raw, '[.-]') AS dotted, regexp_matches(raw, '^.+[A-Z]') AS capital FROM u),
w AS (SELECT conv_id, turn, regexp_replace(raw, '^\\.+|\\.+$', '', 'g') AS term FROM v WHERE low NOT IN {Q.tup(L.PROBE_STOP)} AND length(low) >= 3 AND (known OR dotted OR capital)
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY known::INT * 20 + capital::INT * 8 + dotted::INT * 6 + regexp_matches(raw, '^[A-Z]')::INT * 2 DESC, length(low) DESC, term) = 1)
SELECT conv_id, turn, term FROM conversations LEFT JOIN w USING (conv_id, turn)""",
    "conversation_scores": f"""WITH s AS ({P.ORACLE['answer_scores']}), p AS ({P.ORACLE['turn_pairs_preceding']}), m AS (SELECT conv_id, avg(communication) AS c, avg(technical) AS t, count(*) AS n FROM p JOIN s USING (conv_id, turn) GROUP BY conv_id)
SELECT conv_id, round(coalesce(c, 50), 1) AS communication, round(coalesce(t, 50), 1) AS technical, coalesce(n, 0) AS answers FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN m USING (conv_id)""",
    "next_ordinals": "SELECT l_orderkey, max(l_linenumber) + 1 AS next FROM lineitem GROUP BY 1",
    "first_texts": f"""SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 AND {Q.strip("coalesce(text, '')")} <> '' THEN text WHEN doc_id % 4 = 1 AND trim(lang) <> '' THEN lang WHEN doc_id % 4 < 3 AND trim(source) <> '' THEN source ELSE '' END) AS digest FROM documents""",
    "cv_skills": f"""SELECT c_custkey AS cv_id, array_to_string(list_sort(list_distinct([{_SHOW(0)}, {_SHOW(1)}, {_SHOW(2)}])), ',') AS technologies, array_to_string(list_sort(list_distinct([{_SHOW(0)}, {_SHOW(2)}])), ',') AS demonstrated FROM customer""",
    "cv_names": "SELECT c_custkey AS cv_id, CASE c_custkey % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'BO Grant' WHEN 2 THEN CASE c_custkey % 3 WHEN 0 THEN 'Eva Stone' WHEN 2 THEN 'Max Born' END ELSE 'Dee Ohara' END AS name FROM customer",
    "cv_roles": "SELECT c_custkey AS cv_id, 1::INT AS place, ['Senior Software Engineer', 'Data Analyst', 'Qa Lead'][c_custkey % 3 + 1] AS title, 24::INT AS months FROM customer",
    "cv_years": "WITH d AS (SELECT c_custkey AS cv_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 60 BETWEEN 1 AND 45 THEN (c_custkey % 60)::INT END AS declared FROM customer) SELECT cv_id, declared, greatest(2.0, coalesce(declared, 0))::DOUBLE AS years FROM d",
    "greedy_matches": """WITH v AS (SELECT *, row_number() OVER () AS r, vec_id % 2 = 0 AS e FROM embeddings), p AS (SELECT a.label, a.r AS ar, b.r AS br, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM v a JOIN v b ON a.label IS NOT DISTINCT FROM b.label WHERE a.e AND NOT b.e),
n AS (SELECT label, count(*) FILTER (e) AS n_left, count(*) FILTER (NOT e) AS n_right FROM v GROUP BY label), a AS (SELECT label, avg(m) AS p FROM (SELECT label, ar, max(c) AS m FROM p GROUP BY ALL) GROUP BY label), b AS (SELECT label, avg(m) AS r FROM (SELECT label, br, max(c) AS m FROM p GROUP BY ALL) GROUP BY label)
SELECT n.label, n_left, n_right, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM n LEFT JOIN a ON n.label IS NOT DISTINCT FROM a.label LEFT JOIN b ON n.label IS NOT DISTINCT FROM b.label""",
    "positional_ids": "SELECT printf('interviews-%05d', doc_id) AS raw_id, doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "normalised_responses": f"""WITH b AS (SELECT event_id, [{', '.join(map(_shape, _SHAPES))}][event_id % {len(_SHAPES)} + 1] AS body FROM events), p AS (SELECT event_id, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body::JSON END AS j FROM b)
SELECT event_id, j IS NOT NULL AS ok, {', '.join(f"{_STRING(f'$.contact.{c}')} AS contact_{c}" for c in ('name', 'email', 'phone'))}, {', '.join(f"coalesce(array_to_string({v}, '|'), '') AS {c}" for c, v in _LIST_SQL.items())}, {_NUMBER('$.yearsTotal')} AS years_total,
coalesce({_STRING('$.seniority')}, 'unknown') AS seniority, coalesce(floor({_NUMBER('$.readinessScore')} + 0.5)::BIGINT, 0) AS readiness, {_JSON('$.readinessBreakdown', 'OBJECT', '{}')} AS breakdown, {_JSON('$.educationDetail', 'ARRAY', '[]')} AS education_detail,
{_JSON('$.experienceDetail', 'ARRAY', '[]')} AS experience_detail, coalesce({_NUMBER('$.extractionConfidence')}, 0) AS confidence, coalesce({_STRING('$.rawText')}, {_STRING('$.text')}, '') AS raw_text FROM p""",
    "trimmed_resources": """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN '[]' ELSE '[{"title":"t' || user_id || '","url":"u"}]' END AS resources FROM events""",
    "cv_certifications": f"""WITH {_OTHER}, {_SCHOOL}, al AS (FROM ot UNION ALL FROM ed), sc AS (SELECT *, CASE section WHEN 'certifications' THEN 0 WHEN 'education' THEN 1 WHEN 'awards' THEN 2 END AS s FROM al WHERE section IN ('certifications', 'education', 'awards')),
n AS (SELECT cv_id, s, line_no, CASE WHEN s = 0 AND NOT regexp_matches(line, {Q.lit(L.CERTIFICATION)}) AND length({_TRIM('line', ' .,;:|\\-•*')}) BETWEEN 8 AND 80 THEN [{_TRIM('line', ' .,;:|\\-•*')}]
  ELSE list_filter(list_transform(regexp_extract_all(line, {Q.lit(L.CERTIFICATION)}, 1), lambda c: {_TRIM(_SPACES('c'), ' .,;:|\\-')}), lambda c: length(c) BETWEEN 6 AND 80) END AS names FROM sc),
u AS (SELECT cv_id, s, line_no, i, names[i] AS name FROM n, unnest(range(1, len(names) + 1)) t(i)), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY cv_id, regexp_replace(lower(name), '[^a-z0-9_]+', '', 'g') ORDER BY s, line_no, i) = 1)
SELECT cv_id, (row_number() OVER (PARTITION BY cv_id ORDER BY s, line_no, i))::INT AS place, name FROM f QUALIFY place <= {K.CERTIFICATIONS}""",
    "cv_projects": f"""WITH {_OTHER}, l AS (SELECT cv_id, line_no, {_TRIM('line', ' .,;:|\\-•*–')} AS c FROM ot WHERE section = 'projects'), h AS (SELECT *, trim(regexp_split_to_array(c, '\\s*[–—|:]\\s*|\\s+-\\s+')[1]) AS h FROM l WHERE length(c) BETWEEN 6 AND 90 AND len(list_filter({Q.arr(L.NOT_A_PROJECT)}, lambda w: starts_with(lower(c), w))) = 0),
f AS (SELECT cv_id, line_no, CASE WHEN length(h) BETWEEN 4 AND 70 THEN h ELSE left(c, 70) END AS name FROM h QUALIFY row_number() OVER (PARTITION BY cv_id, lower(name) ORDER BY line_no) = 1)
SELECT cv_id, (row_number() OVER (PARTITION BY cv_id ORDER BY line_no))::INT AS place, name FROM f QUALIFY place <= {K.PROJECTS}""",
    "cv_employers": f"""WITH r AS (SELECT o_orderkey, o_orderkey % 4 AS k, (o_orderkey % 7)::VARCHAR AS d FROM orders)
SELECT o_orderkey, {Q.arr(['Software Engineer', 'Data Analyst', 'Senior developer', 'QA Engineer'])}[k + 1] AS title, ['Ceylon Systems', 'Region ' || d || ' Holdings', NULL, 'Blue River Works'][k + 1] AS employer FROM r""",
    "cv_education": f"""WITH RECURSIVE {_SCHOOL}, nx AS (SELECT cv_id, line, row_number() OVER w AS k, lead(line) OVER w AS nl FROM ed WINDOW w AS (PARTITION BY cv_id ORDER BY line_no)),
pl AS (SELECT *, {_PLACE1('line')} AS h0, {_PLACE1("coalesce(nl, '')")} AS b0, nullif(regexp_extract(line, {Q.lit(L.DEGREE)}, 1), '') AS d, nullif(regexp_extract(line, {Q.lit(L.FIELD_OF_STUDY)}, 1), '') AS f0,
  list_max(list_transform(regexp_extract_all(concat_ws(' ', line, nl), '\\b((?:19|20)\\d{{2}})\\b', 1), lambda y: y::INT)) AS year FROM nx),
pi AS (SELECT *, {_PLACE('line', 'h0')} AS here, {_PLACE('nl', 'b0')} AS below, CASE WHEN d IS NOT NULL THEN {_DEGREES} END AS degree, {_TRIM('f0', ' .,\\-')} AS field FROM pl),
ll AS (SELECT *, coalesce(here, below) AS place, concat_ws(' ', degree, 'in ' || field) AS parts FROM pi),
la AS (SELECT *, CASE WHEN parts = '' THEN coalesce(place, left(line, 70)) WHEN place IS NOT NULL THEN parts || ', ' || place ELSE parts END AS label, length(line) >= 5 AND (degree IS NOT NULL OR place IS NOT NULL) AS ok, coalesce(here IS NULL AND below IS NOT NULL AND degree IS NOT NULL AND length(line) >= 5, false) AS takes FROM ll),
li AS MATERIALIZED (SELECT cv_id, k, label, regexp_replace(lower(label), '[^a-z0-9_]+', '', 'g') AS key, degree, field, place, year, ok, takes FROM la),
st AS (SELECT DISTINCT cv_id, 0::BIGINT AS k, false AS skip, []::VARCHAR[] AS seen, []::STRUCT(label VARCHAR, degree VARCHAR, field VARCHAR, institution VARCHAR, year INT)[] AS o FROM li UNION ALL
  SELECT s.cv_id, l.k, NOT s.skip AND ok AND takes, CASE WHEN adds THEN list_append(s.seen, key) ELSE s.seen END, CASE WHEN adds THEN list_append(s.o, {{'label': {_TRIM(_SPACES('label'), ' .,\\-')}, 'degree': degree, 'field': field, 'institution': place, 'year': year}})
    WHEN folds THEN list_append(s.o[1:len(s.o) - 1], {{'label': s.o[len(s.o)].label || ', ' || place, 'degree': s.o[len(s.o)].degree, 'field': s.o[len(s.o)].field, 'institution': place, 'year': coalesce(year, s.o[len(s.o)].year)}}) ELSE s.o END
  FROM (SELECT *, NOT skip AND ok AND NOT list_contains(seen, key) AND NOT coalesce(degree IS NULL AND place IS NOT NULL AND len(o) > 0 AND o[len(o)].institution IS NULL, false) AS adds,
    NOT skip AND ok AND NOT list_contains(seen, key) AND coalesce(degree IS NULL AND place IS NOT NULL AND len(o) > 0 AND o[len(o)].institution IS NULL, false) AS folds FROM (SELECT cv_id, k + 1 AS k, skip, seen, o FROM st) JOIN li USING (cv_id, k)) s, (SELECT s.k) l(k)),
en AS (SELECT cv_id, arg_max(o, k) AS o FROM st GROUP BY cv_id)
SELECT cv_id, i::INT AS place, o[i].label AS label, o[i].degree AS degree, o[i].field AS field, o[i].institution AS institution, o[i].year AS year FROM en, unnest(range(1, least(len(o), {K.EDUCATION}) + 1)) t(i)""",
}
