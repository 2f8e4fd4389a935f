"""Manufacturer mappings: rules as data, compiled on the driver to Column expressions.

A mapping has oem, schema_ver, format (json, signal_list or delimited), vin_field and fields; a field has source,
transform and, by transform, factor, offset, mapping, separator, index, default, required. Nothing is interpreted per
row: a new version of a mapping is a new plan, which a stream picks up at its next micro-batch.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = {"transform": "scale"}
E6 = {"transform": "scale", "factor": 1_000_000}
ON_OFF = {"1": True, "0": False, "true": True, "false": False}
EVENTS = {"HB": "HARSH_BRAKE", "HA": "HARSH_ACCEL", "HC": "HARSH_CORNER", "OS": "OVERSPEED"}


def _fields(**rules) -> dict:
    return {k: {"source": v, "transform": "direct"} if isinstance(v, str) else {"source": v[0], **v[1]} for k, v in rules.items()}


#: Fixed formats of the six supported payloads.
BUILT_IN = [
    {
        "oem": "A", "schema_ver": 1, "format": "json", "vin_field": "vehicleId",
        "fields": _fields(
            ts_event=("timestamp", {"transform": "iso8601_to_ms", "required": True}), seq="msgSeq", lat_e6=("position.latitude", E6), lon_e6=("position.longitude", E6), heading_deg="position.headingDeg",
            speed_kmh="speedKph", odo_km="odometerKm", ignition=("ignition", {"transform": "enum_map", "mapping": ON_OFF | {"ON": True, "OFF": False}}), fuel_pct="fuelLevelPct",
            dtc=("dtcList", {"transform": "direct", "default": []}), evt="event",
        ),
    },
    {
        "oem": "B", "schema_ver": 1, "format": "json", "vin_field": "vin",
        "fields": _fields(
            ts_event=("ts_epoch", {"transform": "epoch_s_to_ms", "required": True}), seq="counter", lat_e6=("gps.lat", E6), lon_e6=("gps.lng", E6), heading_deg="gps.hdg", speed_kmh=("speed_mph", SCALE | {"factor": 1.609344}),
            odo_km=("odo_mi", SCALE | {"factor": 1.609344}), ignition=("ign", {"transform": "enum_map", "mapping": ON_OFF}), fuel_pct=("fuel_frac", SCALE | {"factor": 100.0}),
            dtc=("trouble_codes", {"transform": "split_list", "separator": ";", "default": []}), evt=("evt_code", {"transform": "enum_map", "mapping": EVENTS}),
        ),
    },
    {
        "oem": "C", "schema_ver": 1, "format": "signal_list", "vin_field": "deviceId",
        "fields": _fields(
            ts_event=("tsMs", {"transform": "direct", "required": True}), speed_kmh="SPD", soc_pct=("SOC", SCALE | {"factor": 100.0}), odo_km=("ODO", SCALE | {"factor": 0.001}), lat_e6=("LAT", E6), lon_e6=("LON", E6),
            charge_kw="CHG_KW", evt=("flags", {"transform": "enum_map", "mapping": EVENTS}),
        ),
    },
    {
        "oem": "D", "schema_ver": 1, "format": "delimited", "delimiter": "|", "vin_field": "1",
        "fields": _fields(
            ts_event=("2", {"transform": "direct", "required": True}), lat_e6=("3", SCALE | {"factor": 10}), lon_e6=("4", SCALE | {"factor": 10}), speed_kmh=("5", SCALE | {"factor": 0.1}), odo_km=("6", SCALE | {"factor": 0.1}),
            ignition=("7", {"transform": "enum_map", "mapping": {"1": True, "0": False}}), fuel_pct=("8", SCALE | {"factor": 0.1}), dtc=("9", {"transform": "split_list", "separator": ",", "default": []}),
        ),
    },
    {
        "oem": "E", "schema_ver": 1, "format": "json", "vin_field": "vin",
        "fields": _fields(ts_event=("t", {"transform": "iso8601_to_ms", "required": True}), lat_e6=("lat", E6), lon_e6=("lon", E6), speed_kmh="spd", soc_pct="soc"),
    },
    {
        "oem": "E", "schema_ver": 2, "format": "json", "vin_field": "vin",
        "fields": _fields(
            ts_event=("t", {"transform": "iso8601_to_ms", "required": True}), lon_e6=("loc", {"transform": "array_index", "index": 0, "factor": 1_000_000}), lat_e6=("loc", {"transform": "array_index", "index": 1, "factor": 1_000_000}),
            speed_kmh=("spd_ms", SCALE | {"factor": 3.6}), soc_pct=("batt.soc", SCALE | {"factor": 100.0}), batt_voltage_v="batt.volt", charge_kw=("batt.kw", {"transform": "negative_to_charge_kw"}), charge_state=("batt.kw", {"transform": "negative_to_charge_state"}),
        ),
    },
]
TYPES = {
    "ts_event": "bigint", "seq": "bigint", "lat_e6": "int", "lon_e6": "int", "heading_deg": "int", "speed_kmh": "double", "odo_km": "double", "ignition": "boolean", "fuel_pct": "double", "soc_pct": "double", "batt_voltage_v": "double",
    "charge_state": "string", "charge_kw": "double", "coolant_c": "double", "rpm": "int", "dtc": "array<string>", "evt": "string",
}
FORMATS = ("json", "signal_list", "delimited")
TRANSFORMS = ("direct", "scale", "iso8601_to_ms", "epoch_s_to_ms", "enum_map", "split_list", "array_index", "negative_to_charge_kw", "negative_to_charge_state")


def checked(mapping: dict) -> dict:
    """The mapping, or an error that says what is wrong with it."""
    for k in ("oem", "schema_ver", "format", "vin_field", "fields"):
        if k not in mapping:
            raise ValueError(f"mapping without {k}")
    if mapping["format"] not in FORMATS:
        raise ValueError(f"unknown format {mapping['format']}")
    for name, rule in mapping["fields"].items():
        if name not in TYPES:
            raise ValueError(f"unknown field {name}")
        if "source" not in rule or rule.get("transform", "direct") not in TRANSFORMS:
            raise ValueError(f"field {name}: source or transform is missing or unknown")
    return mapping


def load_mappings(spark: SparkSession, path: str) -> list[dict]:
    """Mappings from JSON files; files that describe the schema or hold samples are skipped."""
    rows = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("f")).collect()
    names = [(r["f"].rsplit("/", 1)[-1], r["value"]) for r in rows]
    return [checked(json.loads(v)) for f, v in sorted(names) if "schema" not in f and "golden" not in f]


class Registry:
    """Active and shadow mappings by (oem, version)."""

    def __init__(self, mappings: list[dict] = BUILT_IN):
        self.active: dict[tuple[str, int], dict] = {}
        self.shadow: dict[tuple[str, int], dict] = {}
        for m in mappings:
            self.register(m)

    def register(self, mapping: dict, shadow: bool = False) -> None:
        m = checked(mapping)
        (self.shadow if shadow else self.active)[m["oem"].upper(), int(m["schema_ver"])] = m

    def versions(self, oem: str) -> list[int]:
        return sorted(v for o, v in self.active if o == oem)

    def lookup(self, oem: str, version: int) -> dict | None:
        """The version itself, else the greatest one."""
        if (oem, version) in self.active:
            return self.active[oem, version]
        known = self.versions(oem)
        return self.active[oem, known[-1]] if known else None

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(o, v, m["format"], s, json.dumps(m, sort_keys=True)) for s, d in (("ACTIVE", self.active), ("SHADOW", self.shadow)) for (o, v), m in sorted(d.items())]
        return spark.createDataFrame(rows, "oem string, schema_ver int, format string, state string, config string")


#: Field of a parsed payload that is null unless the payload isn't JSON.
BROKEN = "_broken"


def _paths(mapping: dict) -> list[str]:
    return sorted({mapping["vin_field"], *(r["source"] for r in mapping["fields"].values())})


def _ddl(paths: list[str]) -> str:
    """Struct type that holds the text at each dotted path."""
    tree: dict[str, list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        tree.setdefault(head, []).extend([rest] if rest else [])
    return "struct<" + ",".join(f"`{k}`:{_ddl(v) if v else 'string'}" for k, v in tree.items()) + ">"


def parsed(mapping: dict, raw: Column) -> Column:
    """The payload parsed once: its parts if delimited, else a struct of the texts that the mapping reads, with the list
    of signals if it has one. Fields take from it what they need; keep it as a column of its own."""
    if mapping["format"] == "delimited":
        import re

        return F.split(raw, re.escape(mapping["delimiter"]))
    ddl = _ddl(_paths(mapping))
    if mapping["format"] == "signal_list":
        ddl = ddl[:-1] + ",signals:array<struct<n:string,v:string>>>"
    return F.from_json(raw, ddl[:-1] + f",{BROKEN}:string>", {"columnNameOfCorruptRecord": BROKEN})


def _source(parts: Column, mapping: dict, path: str) -> Column:
    """Raw text of a field: a path into JSON, a signal by name, or a place in a delimited line; empty is null."""
    if mapping["format"] == "delimited":
        return F.nullif(F.trim(F.get(parts, F.lit(int(path)))), F.lit(""))
    direct = parts
    for name in path.split("."):
        direct = direct[name]
    if mapping["format"] == "json":
        return direct
    named = F.get(F.filter(parts["signals"], lambda x: x["n"] == path), F.lit(0))["v"]
    return F.coalesce(direct, named)


def _round_int(x: Column) -> Column:
    return F.floor(x + 0.5)


def _value(name: str, rule: dict, text: Column) -> Column:
    kind = rule.get("transform", "direct")
    number = text.try_cast("double")
    scaled = lambda x: x * float(rule.get("factor", 1.0)) + float(rule.get("offset", 0.0))
    typed = lambda x: _round_int(x).cast("int") if name.endswith("_e6") else x
    if kind == "scale":
        return typed(scaled(number))
    if kind == "iso8601_to_ms":
        return F.unix_millis(F.try_to_timestamp(text))
    if kind == "epoch_s_to_ms":
        return _round_int(number * 1000).cast("bigint")
    if kind == "enum_map":
        key = F.when(text.startswith("["), F.get(F.from_json(text, "array<string>"), F.lit(0))).otherwise(text)
        pairs = [F.lit(x) for kv in rule["mapping"].items() for x in kv]
        return F.try_element_at(F.create_map(*pairs), key)
    if kind == "split_list":
        import re

        parts = F.transform(F.split(text, re.escape(rule["separator"])), lambda x: F.trim(x))
        return F.filter(parts, lambda x: x != "")
    if kind == "array_index":
        return typed(scaled(F.get(F.from_json(text, "array<double>"), F.lit(int(rule["index"])))))
    if kind == "negative_to_charge_kw":
        return F.greatest(-number, F.lit(0.0))
    if kind == "negative_to_charge_state":
        return F.when(number < 0, "CHARGING").when(number.isNotNull(), "NONE")
    if TYPES[name] == "array<string>":
        return F.from_json(text, "array<string>")
    return text


def compiled(mapping: dict, parts: Column) -> tuple[Column, Column]:
    """(struct of vin and all canonical fields, whether a required field is missing) of a parsed payload. Required is tested
    before defaults."""
    missing, cols = F.lit(False), [F.upper(F.trim(_source(parts, mapping, mapping["vin_field"]))).alias("vin")]
    for name, kind in TYPES.items():
        rule = mapping["fields"].get(name)
        if rule is None:
            cols.append(F.lit(None).cast(kind).alias(name))
            continue
        value = _value(name, rule, _source(parts, mapping, rule["source"]))
        value = value if kind == "array<string>" else value.try_cast(kind)
        if rule.get("required"):
            missing = missing | value.isNull()
        if "default" in rule:
            default = F.array(*[F.lit(x) for x in rule["default"]]).cast(kind) if isinstance(rule["default"], list) else F.lit(rule["default"]).cast(kind)
            value = F.coalesce(value, default)
        cols.append(value.alias(name))
    return F.struct(*cols), missing
