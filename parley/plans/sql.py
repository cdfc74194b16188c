"""Pieces of the reference SQL (DuckDB) that several queries share."""

from __future__ import annotations

from parley.functions import lexicons as L


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def tup(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def sub(text: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)}, '{flags}')"


def strip(text: str) -> str:
    return sub(sub(text, r"^\s+", ""), r"\s+$", "")


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def clean(text: str) -> str:
    t = sub(f"coalesce({text}, '')", r"(?s)```.*?```", " ")
    t = sub(t, r"\[([^\]]{1,200})\]\((?:[^)]{1,500})\)", r"\1")
    t = sub(t, r"https?://\S+", "")
    t = sub(t, r"<[^>]{1,200}>", " ")
    for name, char in L.ENTITIES.items():
        t = f"replace({t}, {lit(name)}, {lit(char)})"
    t = sub(t, r"(?m)^#{1,6}\s*", "")
    t = sub(t, r"(?m)^\s*>\s?", "")
    t = sub(t, r"(\*\*|__|\*|_|`)", "")
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = sub(sub(t, "[ \t\xa0]+", " "), r"\n{3,}", "\n\n")
    return strip(f"array_to_string(list_transform(string_split({t}, chr(10)), lambda x: {strip('x')}), chr(10))")


def one_line(text: str) -> str:
    return strip(sub(f"replace({clean(text)}, chr(10), ' ')", "[ \t\xa0]+", " "))


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9+#]+'), lambda w: w NOT IN {tup(L.STOPWORDS)})"


def count_terms(text: str, terms) -> str:
    return f"len(list_filter({arr(terms)}, lambda t: contains({text}, t)))"


def haystack(text: str) -> str:
    return f"' ' || array_to_string(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9+#.\\-]+'), ' ') || ' '"


def spaced(text: str) -> str:
    return "'  ' || " + sub(f"lower(coalesce({text}, ''))", r"[^\p{L}\p{N}_'%]+", "  ") + " || '  '"


def phrase(pattern: str) -> str:
    from parley.functions.text import phrase as p

    return p(pattern)


def count_phrases(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({spaced(text)}, {lit(phrase(pattern))}))"


def has_phrase(text: str, pattern: str) -> str:
    return f"regexp_matches({spaced(text)}, {lit(phrase(pattern))})"


def apart(text: str) -> str:
    return "'  ' || " + sub(f"lower(coalesce({text}, ''))", r"[^\p{L}\p{N}_]+", "  ") + " || '  '"


def count_words(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({apart(text)}, {lit(phrase(pattern))}))"


def has_words(text: str, pattern: str) -> str:
    return f"regexp_matches({apart(text)}, {lit(phrase(pattern))})"


def content_terms(text: str) -> str:
    raw = f"list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z][a-z0-9+#.]{{1,}}'), lambda w: regexp_replace(w, '\\.+$', ''))"
    kept = f"list_filter({raw}, lambda w: length(w) >= 3 AND w NOT IN {tup(L.SCORE_STOP)})"
    cases = " ".join(f"WHEN length(w) > {len(s) + 2} AND w LIKE '%{s}' THEN left(w, length(w) - {len(s)})" for s in ("ing", "ies", "es", "ed", "s"))
    return f"list_transform({kept}, lambda w: CASE {cases} ELSE w END)"


def reject_reason(q: str) -> str:
    """Of a stripped text."""
    letters, ascii_ = f"length({sub(q, '[^\\p{L}]', '')})", f"length({sub(q, '[^\\x00-\\x7F]', '')})"
    return f"""CASE WHEN {q} = '' THEN 'empty' WHEN length({q}) < 15 THEN 'too_short' WHEN length({q}) > 220 THEN 'too_long'
  WHEN len({words(q)}) < 3 THEN 'too_few_words' WHEN len(list_filter({arr(L.OPENERS)}, lambda o: starts_with(lower({q}), o))) = 0 THEN 'not_a_question'
  WHEN {count_terms(f'lower({q})', L.NON_INTERVIEW)} > 0 THEN 'non_interview_content' WHEN {letters} < 0.5 * length({q}) OR {ascii_} < 0.8 * length({q}) THEN 'corrupted' END"""


def domain(text: str) -> str:
    """(score, -index, domain) of the best domain."""
    rows = ", ".join(
        f"{{'score': 3.0::DOUBLE * {count_terms('hay', [f' {t} ' for t in strong])} + 1.0::DOUBLE * {count_terms('hay', [f' {t} ' for t in weak])}, 'rank': {-i}, 'domain': {lit(name)}}}"
        for i, (name, (strong, weak)) in enumerate(L.DOMAIN_TERMS.items())
    )
    return f"list_max([{rows}])"


def difficulty_score(q: str, b: str, raw: str) -> str:
    """Of two haystacks and the question."""
    has = lambda hay, terms: count_terms(hay, [f" {t}" for t in terms])
    deep = has(q, L.DEPTH_ADVANCED)
    return f"""(CASE WHEN {has(q, L.FORM_DESIGN)} > 0 THEN 3 WHEN {has(q, L.FORM_PRACTICAL)} > 0 THEN 2 WHEN {has(q, L.FORM_DEFINITION)} > 0 THEN 1 ELSE 2 END
  + CASE WHEN {deep} > 0 THEN 3 WHEN {has(q, L.DEPTH_BASIC)} > 0 THEN 1 ELSE 2 END)::DOUBLE + 0.5::DOUBLE * least({deep}, 2)
  + CASE WHEN {has(b, L.DEPTH_ADVANCED)} >= 3 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN {has(b, L.DEPTH_ADVANCED)} >= 6 THEN 0.5::DOUBLE ELSE 0 END
  + CASE WHEN length(coalesce({raw}, '')) > 120 THEN 0.5::DOUBLE ELSE 0 END"""
