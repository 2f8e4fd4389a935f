"""Vehicle identification numbers and diagnostic trouble codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorcade.functions.geo import let

#: Letters and their numbers, weights by position, severities by code or by its first three characters.
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_NUMBERS = "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
SEVERITY = {
    "P02": "HIGH",
    "P03": "HIGH",
    "P04": "MEDIUM",
    "P05": "MEDIUM",
    "P0217": "CRITICAL",
    "P0562": "HIGH",
    "P0301": "HIGH",
    "P0302": "HIGH",
    "P0303": "HIGH",
    "P0304": "HIGH",
    "P0420": "LOW",
}
SYSTEMS = {"P": "POWERTRAIN", "C": "CHASSIS", "B": "BODY", "U": "NETWORK"}
DTC = "^[PCBU][0-3][0-9A-F]{3}$"
CRITICAL_PREFIXES = ("P03", "P02", "C00")


def vin_clean(vin: Column) -> Column:
    return F.upper(F.trim(vin))


def vin_wellformed(vin: Column) -> Column:
    return F.coalesce(vin_clean(vin).rlike("^[A-HJ-NPR-Z0-9]{17}$"), F.lit(False))


def vin_check_digit(vin: Column) -> Column:
    """Check digit of a 17-character VIN: the weighted sum modulo 11, X for 10."""
    digits = F.translate(vin_clean(vin), VIN_LETTERS, VIN_NUMBERS)

    def digit(d: Column) -> Column:
        total = sum((F.substr(d, F.lit(i + 1), F.lit(1)).try_cast("int") * w for i, w in enumerate(VIN_WEIGHTS) if w), F.lit(0))
        return F.substr(F.lit("0123456789X"), total % 11 + 1, F.lit(1))

    return let(digits, digit)


def vin_valid(vin: Column, strict: bool = True) -> Column:
    """Well formed and, if strict, with the right check digit."""
    ok = vin_wellformed(vin)
    return ok & (F.substr(vin_clean(vin), F.lit(9), F.lit(1)) == vin_check_digit(vin)) if strict else ok


def vin_build(prefix16: Column) -> Column:
    """VIN from its 16 other characters: the check digit goes in ninth place."""
    raw = F.concat(F.substr(prefix16, F.lit(1), F.lit(8)), F.lit("0"), F.substr(prefix16, F.lit(9), F.lit(8)))
    return F.concat(F.substr(prefix16, F.lit(1), F.lit(8)), vin_check_digit(raw), F.substr(prefix16, F.lit(9), F.lit(8)))


def dtc_clean(codes: Column) -> Column:
    """Valid codes in upper case, in order, each once."""
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.upper(F.trim(c))), lambda c: c.rlike(DTC)))


def dtc_severity(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), F.try_element_at(known, F.substr(code, F.lit(1), F.lit(3))), F.lit("MEDIUM"))


def dtc_parsed(codes: Column) -> Column:
    """Array of (code, system, generic, severity)."""
    systems = F.create_map(*[F.lit(x) for kv in SYSTEMS.items() for x in kv])

    def one(c: Column) -> Column:
        return F.struct(c.alias("code"), F.try_element_at(systems, F.substr(c, F.lit(1), F.lit(1))).alias("system"), F.substr(c, F.lit(2), F.lit(1)).isin("0", "1").alias("generic"), dtc_severity(c).alias("severity"))

    return F.transform(dtc_clean(codes), one)


def dtc_critical(codes: Column) -> Column:
    """First code that raises an alert at once, or null."""
    return F.get(F.filter(codes, lambda c: F.substr(c, F.lit(1), F.lit(3)).isin(*CRITICAL_PREFIXES)), F.lit(0))
