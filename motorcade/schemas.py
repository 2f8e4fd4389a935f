"""Schemas, as DDL, of canonical telemetry and of the facts derived from it."""

CANONICAL = (
    "event_id string, vehicle_pid string, tenant_id int, oem string, schema_ver int, ts_event timestamp, ts_ingest timestamp, seq bigint, "
    "lat_e6 int, lon_e6 int, heading_deg int, speed_kmh float, odo_km double, ignition boolean, fuel_pct float, soc_pct float, "
    "batt_voltage_v float, charge_state string, charge_kw float, coolant_c float, rpm int, dtc array<string>, evt string, quality int"
)
RAW = "oem string, schema_ver int, recv_ms bigint, raw string"
REGISTRY = "vin string, vehicle_pid string, tenant_id int, fleet_id int, powertrain string"
TRIP = "trip_id string, vehicle_pid string, tenant_id int, start_ms bigint, end_ms bigint, start_lat_e6 int, start_lon_e6 int, start_geohash7 string, end_lat_e6 int, end_lon_e6 int, end_geohash7 string, distance_km double, duration_s int, idle_s int, fuel_l double, cost double, co2_kg double, status string"
SAFETY = "event_id string, vehicle_pid string, tenant_id int, ts_ms bigint, event_type string, severity double, speed_kmh double, accel_ms2 double, weight double"
