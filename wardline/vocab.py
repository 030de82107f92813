"""Vocabulary and constants.

FIXED VALUES: the entries below must equal the reference application's
values for results to agree (channel names and order, thresholds, bounds,
enums, message texts). They are stated once here, in natural order.
"""

# --- fixed values -----------------------------------------------------------
VITAL_CHANNELS = ("HR", "O2Sat", "Temp", "SBP", "MAP", "DBP", "Resp", "EtCO2")
LAB_CHANNELS = (
    "BaseExcess", "HCO3", "FiO2", "pH", "PaCO2", "SaO2", "AST", "BUN",
    "Alkalinephos", "Calcium", "Chloride", "Creatinine", "Bilirubin_direct",
    "Glucose", "Lactate", "Magnesium", "Phosphate", "Potassium",
    "Bilirubin_total", "TroponinI", "Hct", "Hgb", "PTT", "WBC",
    "Fibrinogen", "Platelets",
)
CLINICAL_CHANNELS = VITAL_CHANNELS + LAB_CHANNELS
DEMOGRAPHIC_FEATURES = ("Age", "Gender", "Unit1", "Unit2", "HospAdmTime")
TIME_COLUMN = "ICULOS"
LABEL_COLUMN = "SepsisLabel"
PATIENT_ID_COLUMN = "patient_id"
ALL_COLUMNS = (PATIENT_ID_COLUMN, TIME_COLUMN) + CLINICAL_CHANNELS + DEMOGRAPHIC_FEATURES + (LABEL_COLUMN,)

RISK_LEVELS = ("Low", "Medium", "High", "Critical")
RISK_RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
CRITICAL_PROBABILITY = 0.5
MEDIUM_PROBABILITY = 0.10
FALLBACK_THRESHOLD = 0.20656414330005646
ALERT_TRIGGER_LEVELS = ("High", "Critical")
ALERT_COOLDOWN_MINUTES = 30

VITALS_SOURCES = ("physionet_sim", "mimic_replay", "iot_sensor")
PATIENT_SOURCE_DATASETS = ("physionet_2019", "mimic_iv_demo", "live")
CODED_DATASET = "mimic_iv_demo"
PATIENT_STATUSES = ("active", "discharged", "deceased")

MAX_PAYLOAD_BYTES = 4096
STREAM_WINDOW_SIZE = 8
MODEL_VERSION = "hybrid_cnn_bilstm_transformer_v1"

# (channel, low bound, high bound, unit, label); None = no bound on that side.
VITAL_RANGES = (
    ("HR", 60.0, 100.0, "bpm", "Heart rate"),
    ("O2Sat", 92.0, None, "%", "Oxygen saturation"),
    ("Temp", 36.0, 38.3, "°C", "Temperature"),
    ("SBP", 90.0, None, "mmHg", "Systolic BP"),
    ("MAP", 65.0, None, "mmHg", "MAP"),
    ("Resp", None, 22.0, "breaths/min", "Respiratory rate"),
)
MAX_FINDINGS = 3
FALLBACK_REASON = "driven by a multi-channel pattern (see SHAP explanation)"

FOCAL_ALPHA = 0.25
FOCAL_GAMMA = 2.0
FOCAL_EPSILON = 1e-7

VITALS_TOPIC_FILTER_REGEX = r"^icu/[^/]+/vitals$"
REJECT_TOO_LARGE = "payload exceeds 4096 bytes"
REJECT_NOT_JSON = "payload is not valid JSON"
REJECT_NO_PATIENT = "missing required field: patient_id"
REJECT_NO_TIMESTAMP = "missing required field: timestamp"
REJECT_BAD_SOURCE = "source must be one of ['iot_sensor', 'mimic_replay', 'physionet_sim']"
REJECT_CHANNELS_NOT_OBJECT = "channels must be an object"
INGEST_ACTOR = "ingestion_service"
FAHRENHEIT_LABEL = "Temperature Fahrenheit"

# Candidate dictionary labels per channel (matched case-insensitively; the
# item with the most events wins, ties to the lowest item id).
CHART_LABEL_CANDIDATES = {
    "HR": ["Heart Rate"],
    "O2Sat": ["O2 saturation pulseoxymetry"],
    "Temp": ["Temperature Celsius", "Temperature Fahrenheit"],
    "SBP": ["Non Invasive Blood Pressure systolic", "Arterial Blood Pressure systolic"],
    "MAP": ["Non Invasive Blood Pressure mean", "Arterial Blood Pressure mean"],
    "DBP": ["Non Invasive Blood Pressure diastolic", "Arterial Blood Pressure diastolic"],
    "Resp": ["Respiratory Rate"],
    "EtCO2": ["EtCO2", "End Tidal CO2"],
    "SaO2": ["Arterial O2 Saturation"],
}
LAB_LABEL_CANDIDATES = {
    "BaseExcess": ["Base Excess"],
    "HCO3": ["Bicarbonate"],
    "FiO2": ["Inspired O2 Fraction", "Oxygen"],
    "pH": ["pH"],
    "PaCO2": ["pCO2"],
    "AST": ["Asparate Aminotransferase (AST)"],
    "BUN": ["Urea Nitrogen"],
    "Alkalinephos": ["Alkaline Phosphatase"],
    "Calcium": ["Calcium, Total"],
    "Chloride": ["Chloride"],
    "Creatinine": ["Creatinine"],
    "Bilirubin_direct": ["Bilirubin, Direct"],
    "Glucose": ["Glucose"],
    "Lactate": ["Lactate"],
    "Magnesium": ["Magnesium"],
    "Phosphate": ["Phosphate"],
    "Potassium": ["Potassium"],
    "Bilirubin_total": ["Bilirubin, Total"],
    "TroponinI": ["Troponin I"],
    "Hct": ["Hematocrit"],
    "Hgb": ["Hemoglobin"],
    "PTT": ["PTT"],
    "WBC": ["White Blood Cells"],
    "Fibrinogen": ["Fibrinogen, Functional", "Fibrinogen"],
    "Platelets": ["Platelet Count"],
}
CHART_SOURCE_KIND = "chartevents"   # d_items.linksto value for chart items
LAB_FLUID = "Blood"                 # d_labitems.fluid value for lab items
# --- end of fixed values ----------------------------------------------------
