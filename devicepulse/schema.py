"""Telemetry schema, domains, thresholds and texts. Constants only."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "Device_ID"
LABEL = "Failed"
CATEGORICAL_FEATURES = ["Device_Type"]
NUMERIC_FEATURES = [
    "CPU_Usage",
    "Memory_Usage",
    "Temperature",
    "Uptime",
    "Interface_Errors",
    "Packet_Loss",
    "Bandwidth_Usage",
    "Log_Errors",
]
FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES
COUNTERS = ["Interface_Errors", "Log_Errors"]
MEASUREMENTS = [c for c in NUMERIC_FEATURES if c not in COUNTERS]

TELEMETRY = T.StructType(
    [T.StructField(KEY, T.StringType()), T.StructField("Device_Type", T.StringType())]
    + [
        T.StructField(c, T.LongType() if c in COUNTERS else T.DoubleType())
        for c in NUMERIC_FEATURES
    ]
    + [T.StructField(LABEL, T.IntegerType())]
)

# The risk formula (weight, scale) and its failure threshold.
RISK_WEIGHTS = {
    "CPU_Usage": (0.25, 100.0),
    "Memory_Usage": (0.20, 100.0),
    "Temperature": (0.20, 90.0),
    "Interface_Errors": (0.10, 100.0),
    "Packet_Loss": (0.10, 10.0),
    "Bandwidth_Usage": (0.10, 100.0),
    "Log_Errors": (0.05, 30.0),
}
FAILURE_THRESHOLD = 0.65

# Probability bands and the colour shown for each.
LOW_BELOW = 0.30
HIGH_FROM = 0.70
BANDS_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ("risk", "risk_color", "status_text", "action_text")
    ]
)
BANDS = [
    ("LOW", "#00e676", f"probability below {LOW_BELOW}", "none"),
    ("MEDIUM", "#ffb300", f"probability from {LOW_BELOW}, below {HIGH_FROM}", "monitor"),
    ("HIGH", "#ff1744", f"probability from {HIGH_FROM}", "service"),
]

# Advisory rules (key, column, limit), in reporting order; a rule
# fires strictly above its limit.
ADVISORY_RULES = [
    ("cpu", "CPU_Usage", 85.0),
    ("mem", "Memory_Usage", 90.0),
    ("temp", "Temperature", 75.0),
    ("iface", "Interface_Errors", 100.0),
    ("loss", "Packet_Loss", 3.0),
    ("log", "Log_Errors", 15.0),
    ("uptime", "Uptime", 365.0),
]
NO_ADVISORY = "none"
ADVISORY_TEXTS = {key: f"{column} above {limit:g}" for key, column, limit in ADVISORY_RULES}
ADVISORY_TEXTS[NO_ADVISORY] = "no reading above its limit"

# Accepted input ranges (inclusive; None is open) and device types.
INPUT_RANGES = {
    "CPU_Usage": (0, 100),
    "Memory_Usage": (0, 100),
    "Temperature": (0, 150),
    "Uptime": (0, None),
    "Interface_Errors": (0, None),
    "Packet_Loss": (0, 100),
    "Bandwidth_Usage": (0, 100),
    "Log_Errors": (0, None),
}
DEVICE_TYPES = ["Router", "Switch"]

# What a missing request key stands for, what a blank form field
# stands for, and the built-in what-if scenarios.
REQUEST_DEFAULTS = {"Device_Type": "Router", **{c: 0 for c in NUMERIC_FEATURES}}
SCENARIO_ROWS = [
    ("cli_demo", "Router", 92.0, 94.0, 78.0, 20.0, 156, 8.2, 95.0, 20),
    ("ui_default", "Router", 50.0, 60.0, 45.0, 100.0, 10, 0.5, 40.0, 2),
    ("healthy-router", "Router", 22.0, 35.0, 38.0, 120.0, 3, 0.05, 45.0, 1),
    ("healthy-switch", "Switch", 15.0, 28.0, 34.0, 245.0, 1, 0.0, 30.0, 0),
    ("high-cpu", "Router", 96.5, 82.0, 65.0, 42.0, 18, 0.9, 94.0, 4),
    ("thermal-alert", "Router", 62.0, 55.0, 87.5, 195.0, 12, 0.4, 68.0, 5),
    ("packet-loss", "Router", 45.0, 48.0, 41.0, 320.0, 210, 8.5, 92.5, 11),
    ("critical-failure", "Switch", 95.0, 94.0, 85.0, 410.0, 412, 9.8, 97.0, 28),
    ("api_defaults", "Router", 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0),
]
FORM_DEFAULTS = dict(zip(FEATURES, SCENARIO_ROWS[0][1:]))
SCENARIOS_SCHEMA = T.StructType(
    [T.StructField("scenario", T.StringType())]
    + [TELEMETRY[c] for c in FEATURES]
)
