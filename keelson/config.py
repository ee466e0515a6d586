"""Vessel schemas and the small lookup tables the operators join against.

Everything here is fixed-size: the tables have at most a few dozen rows, so the DataFrames built
from them are safe to broadcast whatever the size of the sensor data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """A fixed small table that lives in the plan itself, so the optimizer knows its true size."""
    schema = T.StructType.fromDDL(ddl)
    names = schema.fieldNames()
    data = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(data, schema)


@dataclass(frozen=True)
class VesselConfig:
    """How one vessel's raw export maps onto the canonical sensor schema."""

    vessel_id: str
    vessel_name: str
    imo: str = "unknown"
    folder_hint: str = ""
    column_map: dict = field(default_factory=dict)
    derived: dict = field(default_factory=dict)          # name -> SQL expression
    feature_cols: tuple = ()
    feature_groups: dict = field(default_factory=dict)
    sentinels: dict = field(default_factory=dict)        # name -> value meaning "missing"
    timestamp_col: str = "Date"
    date_format: str | None = None                       # Spark datetime pattern, None = detect
    expected_interval_s: int = 14
    physical_limits: dict = field(default_factory=dict)  # name -> (lo, hi), None = open
    fuel_power_slope: float = 4.7
    fuel_power_offset_low: float = -4500.0
    fuel_power_offset_high: float = 3500.0


DRAFT_AND_TRIM = {
    "Avg_draft_m": "(DRAFTAFT + DRAFTFWD) / 2",
    "Trim_m": "DRAFTAFT - DRAFTFWD",
}

# ---------------------------------------------------------------------------------------------
# Vessel schemas (ids, path hints, raw column names, limits).
# ---------------------------------------------------------------------------------------------

STENALINE = VesselConfig(
    vessel_id="stenaline", vessel_name="Stenaline (MMSI 9235517)", imo="9235517", folder_hint="stenaline",
    column_map={
        "sensor_time": "Date",
        "SOG": "GPSSpeed_kn",
        "LAT": "GPS_LAT",
        "LONG": "GPS_LON",
        "PropulsionPowerTotal": "Main_Engine_Power_kW",
        "FuelMassFlowMETotal": "Fuel_Consumption_rate",
        "DraftAftDynamic": "DRAFTAFT",
        "DraftFwdDynamic": "DRAFTFWD",
        "AWS": "RelWindSpeed_kn",
        "AWA": "RelWindAngle_deg",
    },
    derived=DRAFT_AND_TRIM,
    feature_cols=("GPSSpeed_kn", "Main_Engine_Power_kW", "Fuel_Consumption_rate", "DRAFTAFT", "DRAFTFWD",
                  "RelWindSpeed_kn", "GPS_LAT", "GPS_LON"),
    feature_groups={
        "engine_propulsion": ("Main_Engine_Power_kW", "Fuel_Consumption_rate"),
        "navigation": ("GPSSpeed_kn", "GPS_LAT", "GPS_LON"),
        "draft": ("DRAFTAFT", "DRAFTFWD"),
        "weather": ("RelWindSpeed_kn",),
        "trip": (),
    },
    physical_limits={
        "GPSSpeed_kn": (0.0, 30.0),
        "Main_Engine_Power_kW": (0.0, 30000.0),
        "Fuel_Consumption_rate": (0.0, 6000.0),
        "DRAFTAFT": (0.0, 15.0),
        "DRAFTFWD": (0.0, 15.0),
    },
    fuel_power_slope=4.3, fuel_power_offset_low=-4500.0, fuel_power_offset_high=4000.0,
)

STENATEKNIK = VesselConfig(
    vessel_id="stenateknik", vessel_name="Stenateknik (MMSI 9685475)", imo="9685475",
    folder_hint="stenateknik",
    column_map={
        "sensor_time": "Date",
        "Ship Speed GPS (knot)": "GPSSpeed_kn",
        "Ship Speed Log (knot)": "SpeedLog_kn",
        "Latitude (deg)": "GPS_LAT",
        "Longitude (deg)": "GPS_LON",
        "ME Shaft Power (kW)": "Main_Engine_Power_kW",
        "ME Shaft Speed (rpm)": "Speed_rpm",
        "ME Shaft Torque (kNm)": "ME_Shaft_Torque_kNm",
        "ME Shaft Thrust (kN)": "ME_Shaft_Thrust_kN",
        "ME Fuel Mass Net (kg/hr)": "Fuel_Consumption_rate",
        "Draft Aft (m)": "DRAFTAFT",
        "Draft Fwd (m)": "DRAFTFWD",
        "Draft Mid Port (m)": "Draft_Mid_Port_m",
        "Draft Mid Stbd (m)": "Draft_Mid_Stbd_m",
        "Depth of Water (m)": "Depth_of_Water_m",
        "Wind Speed Rel. (knot)": "RelWindSpeed_kn",
        "Wind Dir. Rel. (deg)": "RelWindAngle_deg",
        "Ship Course (deg)": "Ship_Course_deg",
        "GE #1 El. Output (kW)": "GE1_Power_kW",
        "GE #2 El. Output (kW)": "GE2_Power_kW",
        "GE #3 El. Output (kW)": "GE3_Power_kW",
        "GE #4 El. Output (kW)": "GE4_Power_kW",
    },
    derived=DRAFT_AND_TRIM,
    feature_cols=("GPSSpeed_kn", "SpeedLog_kn", "Main_Engine_Power_kW", "Speed_rpm", "Fuel_Consumption_rate",
                  "DRAFTAFT", "DRAFTFWD", "RelWindSpeed_kn", "GPS_LAT", "GPS_LON"),
    feature_groups={
        "engine_propulsion": ("Main_Engine_Power_kW", "Speed_rpm", "Fuel_Consumption_rate"),
        "navigation": ("GPSSpeed_kn", "SpeedLog_kn", "GPS_LAT", "GPS_LON"),
        "draft": ("DRAFTAFT", "DRAFTFWD"),
        "weather": ("RelWindSpeed_kn",),
        "trip": (),
    },
    physical_limits={
        "GPSSpeed_kn": (0.0, 25.0),
        "Main_Engine_Power_kW": (0.0, 10000.0),
        "Fuel_Consumption_rate": (0.0, 1500.0),
        "DRAFTAFT": (0.0, 20.0),
        "DRAFTFWD": (0.0, 20.0),
        "ME_Shaft_Torque_kNm": (-1000.0, 1000.0),
    },
    fuel_power_slope=5.3, fuel_power_offset_low=-3500.0, fuel_power_offset_high=3500.0,
)

GRIMALDI = VesselConfig(
    vessel_id="grimaldi", vessel_name="Grimaldi – EUROCARGO GENOVA", folder_hint="grimaldi",
    column_map={
        "Time stamp": "Date",
        "LATITUDE": "GPS_LAT",
        "LONGITUDE": "GPS_LON",
        "SPEED OVER GROUND [kn]": "GPSSpeed_kn",
        "SPEED THROUGH WATER [kn]": "SpeedLog_kn",
        "COURSE OVER GROUND [ ° ]": "Ship_Course_deg",
        "HEADING  [ ° ]": "Heading_deg",
        "DISPLACEMENT  [m]": "Displacement_m",
        "DRAFTAFT[m]": "DRAFTAFT",
        "DRAFTFOR[m]": "DRAFTFWD",
        "SHAFT POWER[kW]": "Main_Engine_Power_kW",
        "PROPELLER PITCH [%]": "Propeller_Pitch_pct",
        "SHAFT TORQUE [kNm]": "ME_Shaft_Torque_kNm",
        "SHAFT SPEED [rpm]": "Speed_rpm",
        "ME FLOWMETER FLOW RATE [mt/h]": "Fuel_Consumption_rate",
        "ME FLOWMETER DENSITY [kg/m3]": "Fuel_Density_kg_m3",
        "Flow Temp [°C]": "Fuel_Flow_Temp_C",
        "ME FLOW TOTAL [mt]": "Fuel_Flow_Total_mt",
        "DG1_POWER [kW]": "DG1_Power_kW",
        "DG2_POWER [kW]": "DG2_Power_kW",
        "DG3_POWER [kW]": "DG3_Power_kW",
        "DG4_POWER [kW]": "DG4_Power_kW",
        "WIND SPEED_1": "RelWindSpeed_kn",
        "WIND DIR_1": "RelWindAngle_deg",
        "SEA FORCE": "Sea_Force",
        "SEA DIRECTION": "Sea_Direction_deg",
        "AIR TEMP FORECAST [°C]": "Air_Temp_C",
        "SWELL HEIGHT [m]": "Swell_Height_m",
        "SWELL PERIOD [sec]": "Swell_Period_s",
        "SWELL DIRECTION [°]": "Swell_Direction_deg",
        "WAVE HEIGHT [m]": "Wave_Height_m",
        "WAVE PERIOD [sec]": "Wave_Period_s",
        "WAVE DIRECTION [°]": "Wave_Direction_deg",
        "CURRENT SPEED [kn]": "Current_Speed_kn",
        "CURRENT DIRECTION [°]": "Current_Direction_deg",
        "PRESSURE [mb]": "Pressure_mb",
        "VISIBILITY [m]": "Visibility_m",
        "HUMIDITY [%]": "Humidity_pct",
        "NAUTICAL MILES": "Nautical_Miles",
    },
    derived=DRAFT_AND_TRIM,
    feature_cols=("GPSSpeed_kn", "SpeedLog_kn", "Main_Engine_Power_kW", "Speed_rpm", "Fuel_Consumption_rate",
                  "DRAFTAFT", "DRAFTFWD", "RelWindSpeed_kn", "Wave_Height_m", "Current_Speed_kn",
                  "GPS_LAT", "GPS_LON"),
    feature_groups={
        "engine_propulsion": ("Main_Engine_Power_kW", "Speed_rpm", "Fuel_Consumption_rate"),
        "navigation": ("GPSSpeed_kn", "SpeedLog_kn", "GPS_LAT", "GPS_LON"),
        "draft": ("DRAFTAFT", "DRAFTFWD"),
        "weather": ("RelWindSpeed_kn", "Wave_Height_m", "Current_Speed_kn"),
        "trip": ("Nautical_Miles",),
    },
    expected_interval_s=120,
)

DEFAULT = VesselConfig(
    vessel_id="default", vessel_name="Unknown / Legacy (data1.csv schema)",
    feature_cols=("GPSSpeed_kn", "Main_Engine_Power_kW", "Speed_rpm", "Fuel_Consumption_t_per_day",
                  "Avg_draft_m", "Trim_m", "TrueWindSpeed_kn", "RelWindSpeed_kn"),
    feature_groups={
        "engine_propulsion": ("Main_Engine_Power_kW", "Speed_rpm", "Fuel_Consumption_t_per_day"),
        "navigation": ("GPSSpeed_kn", "GPS_LAT", "GPS_LON"),
        "draft": ("DRAFTAFT", "DRAFTFWD", "Avg_draft_m", "Trim_m"),
        "weather": ("TrueWindSpeed_kn", "RelWindSpeed_kn"),
        "trip": (),
    },
    sentinels={"DRAFTFWD": -9999.0, "DRAFTAFT": -9999.0},
)

VESSELS = (STENALINE, STENATEKNIK, GRIMALDI)     # order matters: first hint that matches wins

NUMERIC_COLS = ("GPSSpeed_kn", "GPS_LAT", "GPS_LON", "Main_Engine_Power_kW", "Speed_rpm",
                "Fuel_Consumption_t_per_day", "DRAFTAFT", "DRAFTFWD", "Avg_draft_m", "Trim_m",
                "TrueWindSpeed_kn", "RelWindSpeed_kn")

PRIORITY_SENSORS = ("RelWindAngle_deg", "RelWindSpeed_kn", "TrueWindSpeed_kn", "DRAFTAFT", "DRAFTFWD",
                    "Avg_draft_m", "Fuel_Consumption_rate", "Fuel_Consumption_t_per_day",
                    "Main_Engine_Power_kW", "GPSSpeed_kn", "AWA", "AWS", "DraftAftDynamic",
                    "DraftFwdDynamic", "FuelMassFlowMETotal", "PropulsionPowerTotal", "SOG")

ZERO_MEANS_IDLE = ("Main_Engine_Power_kW", "Fuel_Consumption_rate", "GPSSpeed_kn", "Speed_rpm",
                   "Fuel_Consumption_t_per_day")

# Signals whose negative readings the metadata patch removes outright.
STRICTLY_NON_NEGATIVE = ("Main_Engine_Power_kW", "Fuel_Consumption_rate", "GPSSpeed_kn", "DRAFTAFT",
                         "DRAFTFWD", "RelWindSpeed_kn", "Speed_rpm")

# name -> (SQL predicate, columns it needs)
CONSTRAINT_CHECKS = {
    "Negative engine power (< 0 kW)": ("Main_Engine_Power_kW < 0", ("Main_Engine_Power_kW",)),
    "Extreme trim (|Trim_m| > 5 m)": ("abs(Trim_m) > 5", ("Trim_m",)),
    "Invalid DRAFTFWD sentinel (-9999)": ("DRAFTFWD = -9999", ("DRAFTFWD",)),
    "Invalid Avg_draft_m (<= 0 m)": ("Avg_draft_m <= 0", ("Avg_draft_m",)),
}

FEATURE_GROUPS = {
    "engine_propulsion": ("Main_Engine_Power_kW", "Speed_rpm", "ME_Shaft_Torque_kNm", "ME_Shaft_Thrust_kN",
                          "Propeller_Pitch_pct", "Fuel_Consumption_rate", "Fuel_Consumption_t_per_day",
                          "DG1_Power_kW", "DG2_Power_kW", "DG3_Power_kW", "DG4_Power_kW",
                          "GE1_Power_kW", "GE2_Power_kW", "GE3_Power_kW", "GE4_Power_kW"),
    "navigation": ("GPSSpeed_kn", "SpeedLog_kn", "GPS_LAT", "GPS_LON", "Ship_Course_deg", "Heading_deg"),
    "draft": ("DRAFTAFT", "DRAFTFWD", "Avg_draft_m", "Trim_m", "Draft_Mid_Port_m", "Draft_Mid_Stbd_m",
              "Depth_of_Water_m", "Displacement_m"),
    "weather": ("RelWindSpeed_kn", "RelWindAngle_deg", "TrueWindSpeed_kn", "Wave_Height_m", "Wave_Period_s",
                "Wave_Direction_deg", "Swell_Height_m", "Swell_Period_s", "Swell_Direction_deg",
                "Sea_Force", "Sea_Direction_deg", "Current_Speed_kn", "Current_Direction_deg",
                "Air_Temp_C", "Pressure_mb", "Humidity_pct", "Visibility_m"),
    "trip": ("Nautical_Miles",),
}

_COMPASS = "Expected: 0–360°. Values outside this range indicate sensor wrap-around or encoding error."
_DRAFT = ("Expected: slow variation, clustered around normal loading condition. Look for: unrealistic "
          "values, sudden jumps, large fore-aft difference, drift over months.")

# signal, label, unit, phys_lo, phys_hi, negative_is_anomaly, aliases, expectation
SIGNAL_PROFILES = (
    ("Main_Engine_Power_kW", "Propulsion Power", "kW", 0.0, 45000.0, True, ("PropulsionPowerTotal",),
     "Expected: bimodal — low band at port/idle, high band in transit. "
     "Look for: negative values, impossible maxima, flat-lines, sudden jumps."),
    ("Fuel_Consumption_rate", "Fuel Mass Flow", "kg/h", 0.0, 12000.0, True,
     ("FuelMassFlowMETotal", "Fuel_Consumption_t_per_day"),
     "Expected: strongly related to power; separate bands by phase. Look for: negatives, zeros during "
     "sailing, noisy spikes, flat-line, mismatch with power."),
    ("GPSSpeed_kn", "Speed over Ground", "kn", 0.0, 30.0, True, ("SOG",),
     "Expected: repeated route profile; stable cruising band in transit; lower near port. "
     "Look for: zeros/near-zeros, sudden jumps, unstable oscillations."),
    ("DRAFTAFT", "Draft Aft", "m", 3.0, 10.0, True, ("DraftAftDynamic",), _DRAFT),
    ("DRAFTFWD", "Draft Fwd", "m", 3.0, 10.0, True, ("DraftFwdDynamic",), _DRAFT),
    ("RelWindSpeed_kn", "Apparent Wind Speed", "kn", 0.0, 60.0, True, ("AWS",),
     "Expected: route-direction effects; different patterns on opposite legs. "
     "Look for: impossible values, repeated values, sensor wrap-around."),
    ("RelWindAngle_deg", "Apparent Wind Angle", "°", -180.0, 360.0, False, ("AWA",),
     "Expected: clusters around specific headings/legs; different on each leg. "
     "Look for: impossible angles, repeated values, wrap-around (0/360 jump)."),
    ("Avg_draft_m", "Average Draft", "m", 3.0, 10.0, True, (),
     "Mean of DraftAft and DraftFwd. Drift or sudden jumps reflect sensor behaviour."),
    ("Trim_m", "Trim", "m", -5.0, 5.0, False, (),
     "Expected: ±1–2 m normal trim variation. Look for: values outside ±5 m (extreme trim)."),
    ("TrueWindSpeed_kn", "True Wind Speed", "kn", 0.0, 60.0, True, (),
     "Validate against RelWindSpeed. Negative or impossible values are faults."),
    ("Speed_rpm", "Shaft Speed", "rpm", 0.0, 160.0, True, ("ME Shaft Speed (rpm)",),
     "Expected: strong correlation with propulsion power. "
     "Look for: negative values, sudden drops/spikes, constant-value flat-lines."),
    ("ME_Shaft_Torque_kNm", "Shaft Torque", "kNm", 0.0, 2000.0, True, (),
     "Expected: proportional to shaft power / speed. Spikes or negatives indicate sensor fault."),
    ("Ship_Course_deg", "Course Over Ground", "°", 0.0, 360.0, False, (), _COMPASS),
    ("Heading_deg", "Heading", "°", 0.0, 360.0, False, (), _COMPASS),
    ("Current_Direction_deg", "Current Direction", "°", 0.0, 360.0, False, (), _COMPASS),
    ("Swell_Direction_deg", "Swell Direction", "°", 0.0, 360.0, False, (), _COMPASS),
    ("Wave_Direction_deg", "Wave Direction", "°", 0.0, 360.0, False, (), _COMPASS),
)

# signal, description, port notes
SIGNAL_ROLES = (
    ("AE Emerg DO Mode ()",
     "Operating mode or status of the auxiliary engine emergency diesel-oil system.",
     "Mode value may change during port operations when emergency generator is tested."),
    ("AE Emerg Mass In (kg/hr)",
     "Fuel mass flow into the emergency auxiliary-engine diesel-oil circuit; how much fuel is being "
     "supplied into that line/system.",
     "Near-zero when emergency AE is not running."),
    ("AE Emerg Mass Net (kg/hr)",
     "Net fuel consumption in the emergency auxiliary-engine diesel-oil circuit.",
     "Near-zero when emergency AE is not running."),
    ("AE Emerg Mass Ret (kg/hr)",
     "Fuel mass flow returning from the emergency auxiliary-engine diesel-oil circuit.",
     "Near-zero when emergency AE is not running."),
    ("GPSSpeed_kn", "Vessel speed over ground measured by GPS, in knots.",
     "Values < 0.5 kn indicate port or anchorage. Bimodal distribution: at-rest and cruising peaks."),
    ("SpeedLog_kn", "Vessel speed through water measured by hull logs, in knots.",
     "Near-zero at berth; may differ from GPS speed in strong currents."),
    ("GPS_LAT", "GPS latitude of vessel position, in decimal degrees.",
     "Stable (frozen) when vessel is at berth."),
    ("GPS_LON", "GPS longitude of vessel position, in decimal degrees.",
     "Stable (frozen) when vessel is at berth."),
    ("Ship_Course_deg", "True course of the vessel, in degrees (0–360).",
     "Arbitrary at berth — vessel may swing on mooring lines."),
    ("Main_Engine_Power_kW", "Main engine shaft power output in kilowatts.",
     "Should be near zero at berth. Negative values are sensor anomalies."),
    ("Speed_rpm", "Main engine / propeller shaft rotational speed in RPM.",
     "Near-zero at berth; low non-zero values indicate maneuvering."),
    ("ME_Shaft_Torque_kNm", "Shaft torque at main engine output flange in kNm.",
     "Should be near zero at berth."),
    ("ME_Shaft_Thrust_kN", "Propeller thrust force in kilonewtons.", "Near-zero at berth."),
    ("Fuel_Consumption_rate", "Main engine net fuel consumption rate in kg/hr.",
     "Low but non-zero at berth (hotel/auxiliary load). True zero possible at cold stop."),
    ("Fuel_Consumption_t_per_day", "Total vessel fuel consumption rate in metric tonnes per day.",
     "Low at berth (auxiliary engines only)."),
    ("DRAFTAFT", "Aft (stern) draft depth in metres; measures how deep the stern sits in water.",
     "Changes slowly during cargo loading/unloading. Stable during voyages."),
    ("DRAFTFWD", "Forward (bow) draft depth in metres; measures how deep the bow sits in water.",
     "Changes slowly during cargo operations. Sentinel value −9999 indicates sensor fault."),
    ("Draft_Mid_Port_m", "Mid-ship port-side draft in metres.",
     "Stable at sea; changes during cargo operations in port."),
    ("Draft_Mid_Stbd_m", "Mid-ship starboard-side draft in metres.",
     "Stable at sea; changes during cargo operations in port."),
    ("Avg_draft_m", "Average of aft and forward draft in metres; proxy for vessel displacement.",
     "Non-positive values indicate draft sensor fault (sentinel −9999 inherited from DRAFTFWD)."),
    ("Trim_m", "Vessel trim = aft draft minus forward draft, in metres. Positive = stern-heavy.",
     "Values outside ±5 m are physical anomalies."),
    ("Depth_of_Water_m", "Water depth below keel in metres.",
     "Low values expected during port approach and harbour manoeuvring."),
    ("RelWindSpeed_kn", "Apparent (relative) wind speed measured on board in knots.",
     "Can be non-zero at berth (= true wind when stationary). Very high values may indicate sensor issues."),
    ("RelWindAngle_deg", "Apparent wind direction relative to vessel bow, in degrees (0–360).",
     "Equals true wind angle when vessel is stationary at berth."),
    ("TrueWindSpeed_kn",
     "True (meteorological) wind speed derived from apparent wind and vessel motion, in knots.",
     "Should equal apparent wind speed when vessel is stationary at berth."),
)

# signal, label, ok_lo, ok_hi, hint, note_ok, note_warn, note_hint
UNIT_CHECKS = (
    ("GPS_LAT", "Latitude", 30.0, 75.0, "radian", "Degrees — plausible North-Sea range",
     "Values outside expected 30–75 °N — check route or units",
     "Values look like radians; multiply by 180/π"),
    ("GPS_LON", "Longitude", -15.0, 35.0, "radian", "Degrees — plausible North-Sea / Baltic range",
     "Values outside expected -15–35 °E", "Values look like radians; multiply by 180/π"),
    ("GPSSpeed_kn", "Speed over Ground", 0.0, 25.0, "ms", "Knots — plausible (0–25 kn)",
     "95th-pct > 25 kn is suspicious for a ferry",
     "Median < 6 and max < 15 — may be m/s; multiply by 1.944"),
    ("Main_Engine_Power_kW", "Propulsion Power", 0.0, 45000.0, "watt", "kW — plausible (0–45 MW)",
     "Values outside 0–45 000 kW", "Values > 100 000 → likely W; divide by 1 000 for kW"),
    ("Fuel_Consumption_rate", "Fuel Mass Flow", 0.0, 12000.0, "",
     "kg/h — plausible (0–12 000 kg/h at full power)",
     "Check units: <10 → t/h? >200 000 → kg/s? Expected range 0–12 000 kg/h", ""),
    ("Fuel_Consumption_t_per_day", "Fuel Consumption (t/day)", 0.0, 100.0, "",
     "t/day — plausible (0–100 t/day)", "Values outside 0–100 t/day — check units", ""),
    ("Avg_draft_m", "Avg Draft", 3.0, 10.0, "mm", "Metres — plausible (3–10 m)",
     "Values outside 3–10 m ferry range", "Values > 100 → likely mm; divide by 1 000"),
    ("DRAFTAFT", "Draft Aft", 3.0, 10.0, "mm", "Metres — plausible", "Values outside 3–10 m",
     "Values > 100 → likely mm; divide by 1 000"),
    ("DRAFTFWD", "Draft Fwd", 3.0, 10.0, "mm", "Metres — plausible", "Values outside 3–10 m",
     "Values > 100 → likely mm; divide by 1 000"),
)

# ------------------------------------------------------------------------- end of fixed values

#: The fuel signal under either of its names.
FUEL_COLUMNS = ("Fuel_Consumption_rate", "Fuel_Consumption_t_per_day")


def detect_vessel(path: str) -> VesselConfig:
    """Config whose hint occurs in the path (case-insensitive); DEFAULT when none does."""
    low = str(path).lower()
    return next((v for v in VESSELS if v.folder_hint in low), DEFAULT)


def feature_columns(path: str | None = None) -> list[str]:
    return list((detect_vessel(path) if path else DEFAULT).feature_cols or DEFAULT.feature_cols)


def group_of(signal: str, config: VesselConfig | None = None) -> str:
    """Vessel groups first, then the default groups, then 'other'."""
    for groups in ((config.feature_groups if config else {}), FEATURE_GROUPS):
        for name, signals in groups.items():
            if signal in signals:
                return name
    return "other"


def feature_group_table(spark: SparkSession, signals, config: VesselConfig | None = None) -> DataFrame:
    return local_table(spark, [(s, group_of(s, config)) for s in signals],
                                 "signal string, feature_group string")


def signal_profile_table(spark: SparkSession) -> DataFrame:
    """One row per name a profile answers to; `is_alias` rows only apply where no exact name does."""
    rows = []
    for signal, label, unit, lo, hi, neg, aliases, expect in SIGNAL_PROFILES:
        rows += [(name, name != signal, label, unit, lo, hi, neg, expect) for name in (signal, *aliases)]
    return local_table(spark, 
        rows, "signal string, is_alias boolean, label string, unit string, phys_lo double, "
              "phys_hi double, negative_is_anomaly boolean, expect string")


def physical_limits(config: VesselConfig | None = None) -> dict:
    """signal -> (lo, hi): the global profile limits, each bound overridden by the vessel's own."""
    limits = {}
    for signal, _, _, lo, hi, _, aliases, _ in SIGNAL_PROFILES:
        for name in aliases:
            limits.setdefault(name, (lo, hi))
    limits.update({p[0]: (p[3], p[4]) for p in SIGNAL_PROFILES})
    for signal, (lo, hi) in (config.physical_limits if config else {}).items():
        base = limits.get(signal, (None, None))
        limits[signal] = (base[0] if lo is None else lo, base[1] if hi is None else hi)
    return limits


def physical_limit_table(spark: SparkSession, config: VesselConfig | None = None) -> DataFrame:
    return local_table(spark, [(s, lo, hi) for s, (lo, hi) in physical_limits(config).items()],
                       "signal string, phys_lo double, phys_hi double")


def signal_role_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(SIGNAL_ROLES),
                                 "signal string, description string, port_notes string")


def unit_check_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, 
        list(UNIT_CHECKS), "signal string, label string, ok_lo double, ok_hi double, hint string, "
                           "note_ok string, note_warn string, note_hint string")
