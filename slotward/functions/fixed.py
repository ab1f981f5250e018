"""Names, ranks and limits that results depend on."""

# Hardware components, in the order the features use.
COMPONENTS = ["cpu", "memory", "fans", "storage", "temperature", "power"]

# Component order inside the raw exports and the gold table.
EXPORT_COMPONENTS = ["fans", "cpu", "memory", "storage", "temperature", "power"]

# Raw export columns.
RAW_COLUMNS = {
    "ping": ["id", "vm_name", "vm_ip", "status", "timestamp"],
    "hpe": ["id", "ip_address", "fans", "cpu", "memory", "storage", "temperature", "power",
            "recorded_at", "server_name", "current_problems"],
    "dell": ["id", "ip_address", "status", "issues_detected", "comments", "timestamp",
             "overall_status", "fans", "cpu", "memory", "storage", "temperature", "power",
             "server_name", "current_problems"],
}

# Raw name -> canonical name, per source.
CANONICAL_NAMES = {
    "ping": {"vm_name": "machine_name", "vm_ip": "ip_address", "timestamp": "event_time"},
    "hpe": {"server_name": "machine_name", "recorded_at": "event_time"},
    "dell": {"server_name": "machine_name", "timestamp": "event_time"},
}

# Canonical columns kept per source.
CANONICAL_COLUMNS = {
    "ping": ["machine_name", "ip_address", "event_time", "status"],
    "hpe": ["machine_name", "ip_address", "event_time"] + EXPORT_COMPONENTS + ["current_problems"],
    "dell": ["machine_name", "ip_address", "event_time", "status", "overall_status"]
            + EXPORT_COMPONENTS + ["issues_detected"],
}

KEY = ["machine_name", "ip_address", "monitoring_slot"]

# The 28 gold columns in order.
GOLD_COLUMNS = [
    "observation_id", "machine_name", "ip_address", "monitoring_slot",
    "has_ping", "has_hpe", "has_dell", "telemetry_source",
    "event_time_ping", "ping_status",
    "event_time_hpe", "hpe_fans", "hpe_cpu", "hpe_memory", "hpe_storage", "hpe_temperature",
    "hpe_power", "hpe_current_problems",
    "event_time_dell", "dell_status", "dell_overall_status", "dell_fans", "dell_cpu",
    "dell_memory", "dell_storage", "dell_temperature", "dell_power", "dell_issues_detected",
]

# Severity ranks of component states.
SEVERITY_RANKS = {"OK": 0, "Degraded": 1, "Warning": 2, "NOT OK": 2, "Critical": 3}

# The ranks used when two vendors are weighed against each other; other states score 0.
DOMINANCE_RANKS = {"OK": 0, "Degraded": 1, "Warning": 2, "Critical": 3}

# Ping encoding.
PING_CODES = {"Reachable": 0, "Unreachable": 1}

# Component states the pre-merge audit accepts without a warning.
ACCEPTED_STATES = ["OK", "Warning", "Critical"]

# Labels of the rank levels in reports.
RANK_LABELS = {0: "OK", 1: "Degraded", 2: "NOT OK", 3: "Critical"}
NO_SENSOR = "No Sensor"

# Telemetry source tags.
SOURCE_TAGS = {
    (True, True): "Ping + HPE + Dell",
    (False, True): "Ping + Dell",
    (True, False): "Ping + HPE",
    (False, False): "Ping Only",
}

# Evidence source names.
EVIDENCE_SOURCES = {
    "ping": "Ping Status Monitoring",
    "dell": "Dell iDRAC Health",
    "hpe": "HPE iLO Health",
}

SLOT_HOURS = [2, 6, 10, 14, 18, 22]
SLOTS_PER_DAY = 6
STALE_AFTER_HOURS = 8.0

WORST_COLUMNS = [f"hardware_{c}_worst_status" for c in COMPONENTS]
COUNT_COLUMNS = ["critical_component_count", "not_ok_component_count", "degraded_component_count"]
LAG_COLUMNS = ["ping_status_binary_lag1", "ping_status_binary_lag2"]
RATE_COLUMNS = ["ping_timeout_rate_3slot", "ping_timeout_rate_6slot"]

# Features considered by the screening, in order.
CANDIDATE_FEATURES = (
    ["has_ping", "has_hpe", "has_dell", "ping_status_binary"] + WORST_COLUMNS + COUNT_COLUMNS
    + ["has_active_problem"] + LAG_COLUMNS + RATE_COLUMNS + ["problems_active_sum_6slot"]
)

# Detector features (constant has_ping dropped) and classifier features.
DETECTOR_FEATURES = [c for c in CANDIDATE_FEATURES if c != "has_ping"]
VENDOR_FLAGS = ["has_hpe", "has_dell"]
CLASSIFIER_FEATURES = [
    c for c in DETECTOR_FEATURES if c not in VENDOR_FLAGS + ["has_active_problem"]
]

# Features whose class means are compared.
LIFT_FEATURES = ["problems_active_sum_6slot", "ping_timeout_rate_3slot",
                 "critical_component_count", "not_ok_component_count", "ping_status_binary"]

TARGETS = ["target_failure_3slot", "target_failure_6slot", "target_network_alert_3slot",
           "target_hardware_failure_3slot"]

# Imputation of model inputs.
HARDWARE_FILL = -1
LAG_FILL = 0

# Detector settings.
CONTAMINATION = 0.02
CONTAMINATION_GRID = [0.01, 0.02, 0.03, 0.05]
FOREST_TREES = 100
FOREST_SAMPLE = 256
ONE_CLASS_NU = 0.02
DENSITY_EPS = 4.5
DENSITY_MIN_ROWS = 15
BOTTLENECK = 3

# Deployed risk tiers (lower bound inclusive, upper exclusive) and F1 cut-offs.
RISK_POLICY = {
    "3slot": {
        "lookahead_window": "12 Hours (3 monitoring slots)",
        "optimal_f1": 0.775,
        "tiers": [
            ("NORMAL", 0.0, 0.55, "Server stable; no action required."),
            ("WARNING", 0.55, 0.775,
             "Subtle degradation detected above baseline; schedule preventative diagnostic "
             "checks within 24 hours."),
            ("CRITICAL", 0.775, 1.0,
             "Imminent crash risk (<12h, exceeds optimal F1 cutoff). Dispatch high-priority "
             "SRE remediation ticket immediately."),
        ],
    },
    "6slot": {
        "lookahead_window": "24 Hours (6 monitoring slots)",
        "optimal_f1": 0.564,
        "tiers": [
            ("NORMAL", 0.0, 0.52, "Server stable; no action required."),
            ("WARNING", 0.52, 0.564,
             "Long-range deterioration trend detected. Plan proactive workload migration "
             "within 24 hours."),
            ("CRITICAL", 0.564, 1.0,
             "High probability of complete hardware/network failure within 24 hours "
             "(exceeds optimal F1 cutoff)."),
        ],
    },
}

# Column roles and the keep decision of the data dictionary.
IDENTIFIER_COLUMNS = ["id", "vm_name", "vm_ip", "server_name", "ip_address"]
TIME_COLUMNS = ["timestamp", "recorded_at"]
STATE_COLUMNS = ["status", "overall_status"] + EXPORT_COMPONENTS
TEXT_COLUMNS = ["issues_detected", "comments", "current_problems"]
ROLE_DECISIONS = {
    "Identifier": "Keep for joins/grouping, not direct ML feature",
    "Time": "Derive monitoring_slot and time features",
    "Categorical feature": "Use after encoding/severity mapping",
    "Text feature": "Use for issue flags or text extraction",
    "Review": "Inspect before using",
}

# Text formats tried for raw timestamps.
DAY_FIRST = "d/M/yyyy H:mm"
MONTH_FIRST = "M/d/yyyy H:mm"
ISO = "yyyy-MM-dd HH:mm:ss"
