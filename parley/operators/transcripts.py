"""Transcripts in scripts with joiners: normal form, joiner rules, loops of words, marks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parley.operators.audio import collapse_repeats

# --- fixed values: the Sinhala block, its full stop, and the zero-width joiners ---
SINHALA = "\u0d80-\u0dff"
STOP = "\u0df4"
JOINERS = "\u200d\u200c"


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Composed characters (Unicode NFC); null stays null. A batch of ASCII texts is passed on as it is (Arrow's own normal form leaves letters apart)."""
    if pc.all(pc.string_is_ascii(text), skip_nulls=True).as_py() in (True, None):
        return text
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def joiners(text: Column) -> Column:
    """Zero-width joiners stay only between two letters of the script."""
    return F.regexp_replace(text, f"(?<![{SINHALA}])[{JOINERS}]|[{JOINERS}](?![{SINHALA}])", "")


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def clean(text: Column, language: Column) -> Column:
    """A transcript without artefacts: in Sinhala ('si') composed, joiners by rule, words said three times over twice, marks and spaces in place; else single spaces. Null is empty."""
    t = F.coalesce(text, F.lit(""))
    once = collapse_repeats(joiners(nfc(t)))
    marked = F.regexp_replace(F.regexp_replace(once, rf"\s+([.,!?{STOP}])", "$1"), rf"([.,!?{STOP}])(\S)", "$1 $2")
    return single_spaces(F.when(F.coalesce(language == "si", F.lit(False)), marked).otherwise(t))


def plain_for_errors(text: Column) -> Column:
    """What word errors are counted on: composed, without joiners, single spaces."""
    return single_spaces(F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), f"[{JOINERS}]", ""))
