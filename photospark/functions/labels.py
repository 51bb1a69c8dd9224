"""Disposition codes to class numbers 0..3, or -1 for rows that must not be used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photospark.functions.rules import any_contains
from photospark.functions.scalars import norm_code

# Disposition code -> class number.
KEPLER_CODES = {
    "PC": 0, "KP": 0,
    "EB": 1, "AFP": 1,
    "BEB": 2,
    "NTP": 3, "V": 3, "UNK": 3, "IS": 3,
}
TFOP_CODES = {
    "KP": 0, "CP": 0, "PC": 0, "APC": 0, "VPC": 0,
    "EB": 1, "SB": 1,
    "BEB": 2, "NEB": 2, "BTP": 2,
    "V": 3, "IS": 3, "O": 3, "FA": 3, "FP": 3, "SG": 3,
}
TOI_CODES = {
    "CP": 0, "KP": 0, "PC": 0,
    "EB": 1, "SB": 1, "FP": 1,
    "BEB": 2, "BTP": 2, "NEB": 2,
    "FA": 3, "IS": 3, "V": 3,
}


def _lookup(code: Column, table: dict[str, int]) -> Column:
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(pairs, code)


def map_label_kepler(text: Column) -> Column:
    """Training labels of the Kepler table; unknown text counts as stellar variability."""
    code = norm_code(text)
    wording = (
        F.when(code.contains("PLANET") | (code == "CP"), 0)
        .when(any_contains(code, ["BINARY", "EB"]), 1)
        .when(code.contains("BLEND"), 2)
        .otherwise(3)
    )
    return F.when(text.isNull() | (text == ""), -1).otherwise(F.coalesce(_lookup(code, KEPLER_CODES), wording))


def map_label_tfop(text: Column) -> Column:
    """Follow-up dispositions with fuzzy wording; unknown text gives -1."""
    code = norm_code(text)
    wording = (
        F.when(
            code.contains("PLANET") | code.startswith("P"),
            F.when(code.contains("BACKGROUND"), 2).otherwise(0),
        )
        .when(
            any_contains(code, ["BINARY", "EB"]),
            F.when(any_contains(code, ["BACKGROUND", "NEARBY"]), 2).otherwise(1),
        )
        .when(any_contains(code, ["BLEND", "CONTAM"]), 2)
        .when(any_contains(code, ["VARIABLE", "STELLAR", "FALSE", "INSTRUMENT"]), 3)
        .otherwise(-1)
    )
    return F.when(text.isNull() | (code == ""), -1).otherwise(F.coalesce(_lookup(code, TFOP_CODES), wording))


def map_label_toi(text: Column) -> Column:
    """Short table of the object-of-interest list: false positives are binaries, unknown text gives -1."""
    code = norm_code(text)
    wording = F.when(code.contains("PLANET"), 0).when(any_contains(code, ["EB", "BINARY"]), 1).otherwise(-1)
    return F.when(text.isNull() | (code == ""), -1).otherwise(F.coalesce(_lookup(code, TOI_CODES), wording))


LABEL_MAPS = {"kepler": map_label_kepler, "tfop": map_label_tfop, "toi": map_label_toi}
