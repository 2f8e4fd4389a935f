"""Raw payloads to canonical events, with a reason for each that can't be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorcade.config import CLOCK_SKEW, VIN_WARN
from motorcade.functions import codes, ids
from motorcade.operators.mapping import BROKEN, TYPES, Registry, compiled, parsed

AHEAD_MS, BEHIND_MS = 10 * 60 * 1000, 7 * 24 * 3600 * 1000
#: The smallest positive double.
LEAST_KW = 5e-324


def split_ndjson(df: DataFrame, col: str = "body", most: int = 500) -> DataFrame:
    """One row per non-blank line of a request body, with its number; bodies of more lines than `most` are refused (no rows)."""
    lines = F.filter(F.split(F.col(col), "\r?\n"), lambda x: F.trim(x) != "")
    return df.where(F.size(lines) <= most).select("*", F.posexplode(lines).alias("line", "raw")).drop(col)


def extract_key(raw: Column) -> Column:
    """Vehicle key of a raw payload: second place of a delimited line, else the first of three JSON keys, else a content hash."""
    json_key = lambda k: F.nullif(F.regexp_extract(raw, f'"{k}"\\s*:\\s*"([^"]+)"', 1), F.lit(""))
    line = F.when(raw.rlike(r"^D[12]\|"), F.get(F.split(raw, r"\|"), F.lit(1)))
    return F.coalesce(line, json_key("vin"), json_key("vehicleId"), json_key("deviceId"), F.hex(F.xxhash64(raw)))


def detected(df: DataFrame) -> DataFrame:
    """oem in upper case, or D for delimited lines; schema_ver from the payload's v, else as given, else 1."""
    version = F.get_json_object("raw", "$.v").try_cast("int")
    delimited = F.col("raw").startswith("D1|")
    oem = F.when(delimited, "D").otherwise(F.nullif(F.upper(F.trim("oem")), F.lit("")))
    ver = F.when(delimited, 1).otherwise(F.coalesce(version, F.col("schema_ver"), F.lit(1)))
    return df.withColumn("oem", oem).withColumn("schema_ver", ver)


def normalize(df: DataFrame, registry: DataFrame, mappings: Registry | None = None, strict_vin: bool = False) -> DataFrame:
    """raw, oem, schema_ver and recv_ms to canonical columns and reason_code (null if accepted). The first failing check
    names the reason: MALFORMED, UNKNOWN_OEM, MAPPING_ERROR for a missing field, INVALID_VIN, UNKNOWN_VEHICLE.

    registry (vin, vehicle_pid, tenant_id, ...) is joined on VIN; Spark broadcasts it only below its size threshold."""
    mappings = mappings or Registry()
    df = detected(df)
    raw, known = F.col("raw"), F.lit(False)
    kind = "struct<vin:string," + ",".join(f"{n}:{t}" for n, t in TYPES.items()) + ">"
    fields, missing, parts, lines = F.lit(None).cast(kind), F.lit(False), {}, {}
    for oem in sorted({o for o, _ in mappings.active}):
        versions = mappings.versions(oem)
        is_oem = F.col("oem") == oem
        known = known | is_oem
        for v in versions:
            here = is_oem & ((F.col("schema_ver") == v) if v != versions[-1] else ~F.col("schema_ver").isin(versions[:-1]))
            mapping, name = mappings.lookup(oem, v), f"_p_{oem}_{v}"
            parts[name] = F.when(here, parsed(mapping, raw))
            lines[name] = mapping["format"] == "delimited"
            struct, lacks = compiled(mapping, F.col(name))
            fields = F.when(here, struct.cast(kind)).otherwise(fields)
            missing = F.when(here, lacks).otherwise(missing)
    # known formats were parsed already; any other payload is parsed only to tell whether it is JSON
    whole = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(True) if is_line else F.col(n)[BROKEN].isNull()) for n, is_line in lines.items()], F.try_parse_json(raw).isNotNull())
    is_json = F.when(F.col("oem") == "D", raw.contains("|")).otherwise(whole & F.ltrim(raw).startswith("{"))
    df = df.withColumns(parts)
    df = df.withColumn("_json", F.coalesce(is_json, F.lit(False))).withColumn("_known", F.coalesce(known, F.lit(False))).withColumn("_f", fields).withColumn("_missing", missing).drop(*parts)
    df = df.select("*", "_f.*").drop("_f")
    owners = registry.select(F.upper("vin").alias("_vin"), "vehicle_pid", "tenant_id").dropDuplicates(["_vin"])
    df = df.join(owners, F.col("vin") == F.col("_vin"), "left")
    reason = (
        F.when(~F.col("_json"), "MALFORMED")
        .when(F.col("oem").isNull() | ~F.col("_known"), "UNKNOWN_OEM")
        .when(F.col("vin").isNull() | ~codes.vin_valid(F.col("vin"), strict_vin), "INVALID_VIN")
        .when(F.col("vehicle_pid").isNull(), "UNKNOWN_VEHICLE")
        .when(F.coalesce("_missing", F.lit(True)), "MAPPING_ERROR")
    )
    skewed = (F.col("ts_event") > F.col("recv_ms") + AHEAD_MS) | (F.col("ts_event") < F.col("recv_ms") - BEHIND_MS)
    quality = F.when(~codes.vin_valid(F.col("vin")), VIN_WARN).otherwise(0) + F.when(skewed, CLOCK_SKEW).otherwise(0)
    df = df.withColumn("reason_code", reason).withColumn("quality", quality).withColumn("dtc", codes.dtc_clean(F.col("dtc")))
    df = df.withColumn("event_id", ids.event_id(F.col("vehicle_pid"), F.col("ts_event"), F.col("seq"), raw))
    return df.drop("_json", "_known", "_missing", "_vin")


def accepted(df: DataFrame) -> DataFrame:
    return df.where("reason_code is null").drop("reason_code", "raw")


def rejected(df: DataFrame) -> DataFrame:
    """Dead letters: the payload, why, and where it came from."""
    return df.where("reason_code is not null").select("oem", "schema_ver", "recv_ms", "raw", "reason_code")


def shadow_differences(df: DataFrame, active: dict, shadow: dict) -> DataFrame:
    """Per field, how many payloads the shadow mapping reads otherwise than the active one."""
    df = df.select(parsed(active, F.col("raw")).alias("_a"), parsed(shadow, F.col("raw")).alias("_b"))
    a, _ = compiled(active, F.col("_a"))
    b, _ = compiled(shadow, F.col("_b"))
    diff = [F.count_if(~F.col("a")[n].eqNullSafe(F.col("b")[n])).alias(n) for n in TYPES]
    got = df.select(F.array(a, b).alias("x")).select(F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b")).agg(*diff)
    return got.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("differences")) for n in TYPES])).alias("x")).select("x.*")


def encode(telemetry: DataFrame, oem: str, version: int = 1) -> Column:
    """Raw payload of a format from canonical columns: the inverse of its mapping, for round trips."""
    deg = lambda c: F.col(c) / 1e6
    iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    on = F.col("ignition")
    s = F.struct
    if oem == "A":
        return F.to_json(s(F.col("vin").alias("vehicleId"), iso.alias("timestamp"), s(deg("lat_e6").alias("latitude"), deg("lon_e6").alias("longitude"), F.col("heading_deg").alias("headingDeg")).alias("position"), F.col("speed_kmh").alias("speedKph"), F.when(on, "ON").otherwise("OFF").alias("ignition"), F.col("soc_pct").alias("fuelLevelPct"), F.col("dtc").alias("dtcList"), F.col("seq").alias("msgSeq")))
    if oem == "B":
        return F.to_json(s(F.col("vin"), (F.col("ts_ms") / 1000.0).alias("ts_epoch"), s(deg("lat_e6").alias("lat"), deg("lon_e6").alias("lng"), F.col("heading_deg").alias("hdg")).alias("gps"), (F.col("speed_kmh") / 1.609344).alias("speed_mph"), on.cast("int").alias("ign"), (F.col("soc_pct") / 100.0).alias("fuel_frac"), F.array_join("dtc", ";").alias("trouble_codes"), F.col("seq").alias("counter")))
    if oem == "C":
        signal = lambda n, v: s(F.lit(n).alias("n"), v.cast("double").alias("v"))
        return F.to_json(s(F.col("vin").alias("deviceId"), F.col("ts_ms").alias("tsMs"), F.array(signal("SPD", F.col("speed_kmh")), signal("SOC", F.col("soc_pct") / 100.0), signal("LAT", deg("lat_e6")), signal("LON", deg("lon_e6")), signal("CHG_KW", F.col("charge_kw"))).alias("signals")))
    if oem == "D":
        whole = lambda x: F.floor(x + 0.5).cast("bigint").cast("string")
        return F.concat_ws("|", F.lit("D1"), "vin", F.col("ts_ms").cast("string"), whole(F.col("lat_e6") / 10), whole(F.col("lon_e6") / 10), whole(F.col("speed_kmh") * 10), F.lit("0"), on.cast("int").cast("string"), whole(F.col("soc_pct") * 10), F.array_join("dtc", ","))
    if version == 1:
        return F.to_json(s(F.lit(1).alias("v"), F.col("vin"), iso.alias("t"), deg("lat_e6").alias("lat"), deg("lon_e6").alias("lon"), F.col("speed_kmh").alias("spd"), F.col("soc_pct").alias("soc")))
    # power below zero is all that tells of charging, so charging without power is written as the least there is
    kw = F.when(F.col("charge_state") == "CHARGING", -F.col("charge_kw") - LEAST_KW).otherwise(0.0)
    return F.to_json(s(F.lit(2).alias("v"), F.col("vin"), iso.alias("t"), F.array(deg("lon_e6"), deg("lat_e6")).alias("loc"), (F.col("speed_kmh") / 3.6).alias("spd_ms"), s((F.col("soc_pct") / 100.0).alias("soc"), kw.alias("kw")).alias("batt")))
