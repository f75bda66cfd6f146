"""Rules and id layout of the clinical event model, as plain data.

Fixed values: they name codes, sites and ids of the event format and of the token
contract, and must be exactly these for right results.
"""

CATEGORIES = ("SPECIAL", "MEASUREMENT", "DIAGNOSIS", "PROCEDURE", "MEDICATION", "STRUCTURAL", "OTHER")

# --- routing ---
MEASUREMENT_ALIASES = ("BLOOD PRESSURE",)
DEMOGRAPHIC_ALIASES = ("BMI (KG/M2)", "WEIGHT (LBS)", "HEIGHT (INCHES)")
RARE_CRITICAL = ("CARDIAC ARREST", "CODE BLUE", "CPR", "DEFIB", "ROSC", "SEPSIS BUNDLE", "MASSIVE TRANSFUSION", "REINTUBATION", "SEPTIC SHOCK", "STROKE ALERT")
MODELLED_PREFIXES = ("LAB", "VITAL", "MEAS", "OMR", "MEDICATION", "INFUSION_START", "INFUSION_END", "PROCEDURE", "DIAGNOSIS", "ICD", "CPT", "HCPCS")
MEASUREMENT_PREFIXES = ("LAB", "VITAL", "MEAS", "SUBJECT_FLUID_OUTPUT", "SUBJECT_WEIGHT_AT_INFUSION", "OMR")
MEDICATION_STARTS = ("RXNORM", "NDC", "MEDICATION", "INFUSION")
PROCEDURE_STARTS = ("ICD10PCS", "ICD9PROC", "CPT", "PROCEDURE", "HCPCS")
DIAGNOSIS_STARTS = ("ICD10CM", "ICD9CM", "DIAGNOSIS", "ICD")
STRUCTURAL_PREFIXES = ("MEDS_BIRTH", "MEDS_DEATH", "HOSPITAL_ADMISSION", "HOSPITAL_DISCHARGE", "ICU_ADMISSION", "ICU_DISCHARGE", "TRANSFER_TO", "ED_REGISTRATION", "ED_OUT")
OBSERVATION_PREFIXES = (*MEASUREMENT_PREFIXES, "BLOOD PRESSURE")

# --- places ---
ICU_PLACES = ("//ICU//", "MICU", "SICU", "TSICU", "CCU", "CSRU", "CVICU", "CICU", "NSICU", "PICU", "NICU", "INTENSIVE CARE UNIT", "MEDICAL ICU", "SURGICAL ICU", "TRAUMA ICU", "TRAUMA SICU", "CARDIAC ICU", "CARDIAC CARE UNIT", "CORONARY CARE UNIT", "CARDIAC SURGERY RECOVERY UNIT", "NEURO ICU", "NEUROLOGIC ICU")
OR_PLACES = ("OPERATING ROOM", "//OR//")
PERIOP_PLACES = ("PACU", "POST ANESTHESIA CARE UNIT", "POST-ANESTHESIA CARE UNIT", "RECOVERY ROOM", "PRE-OP", "PRE OP", "PREOP", "POST-OP", "POST OP", "POSTOP")
ED_PLACES = ("//ED//", "EMERGENCY DEPARTMENT", "EMERGENCY ROOM")
ICU_SITES = (
    ("MICU", ("MICU", "MEDICAL ICU")), ("SICU", ("SICU", "SURGICAL ICU")), ("TSICU", ("TSICU", "TRAUMA ICU", "TRAUMA SICU")),
    ("CCU", ("CCU", "CARDIAC CARE UNIT", "CORONARY CARE UNIT", "CICU")), ("CVICU", ("CVICU", "CARDIAC ICU")),
    ("CSRU", ("CSRU", "CARDIAC SURGERY RECOVERY UNIT")), ("NSICU", ("NSICU", "NEURO ICU", "NEUROLOGIC ICU")), ("PICU", ("PICU",)), ("NICU", ("NICU",)),
)
INPATIENT_SITES = (
    ("PACU", ("PACU", "POST ANESTHESIA CARE UNIT", "POST ANESTHESIA CARE UNIT", "RECOVERY ROOM")),
    ("PREOP", ("PRE OP", "PREOP", "PRE OP HOLDING")), ("POSTOP", ("POST OP", "POSTOP")),
)

# --- structural codebook ---
STRUCTURAL_LABELS = {
    "ADMISSION": "STRUCT_START_ADM", "DISCHARGE": "STRUCT_END_ADM", "CAREUNIT_CHANGE": "STRUCT_CAREUNIT_CHANGE",
    "STRUCT_START_OR": "STRUCT_START_OR", "STRUCT_END_OR": "STRUCT_END_OR",
    "224385": "STRUCT_START_MECH", "227194": "STRUCT_END_MECH", "NIV_START": "STRUCT_START_NIV", "NIV_END": "STRUCT_END_NIV",
    "HFNC_START": "STRUCT_START_HFNC", "HFNC_END": "STRUCT_END_HFNC",
    "221906": "STRUCT_START_SHOCK", "221289": "STRUCT_START_SHOCK", "221749": "STRUCT_START_SHOCK", "VASO_OFF": "STRUCT_END_SHOCK",
    "225802": "STRUCT_START_RRT", "225441": "STRUCT_START_RRT", "225803": "STRUCT_END_RRT", "CRRT_START": "STRUCT_START_CRRT", "CRRT_END": "STRUCT_END_CRRT",
    "CODE_STATUS_CHANGE": "STRUCT_CODE_STATUS_CHANGE",
}
BOUNDARY_LABELS = ("STRUCT_START_ADM", "STRUCT_CAREUNIT_CHANGE", "STRUCT_START_OR", "STRUCT_END_OR", "STRUCT_END_ADM")
#: prefixes that bound a window where no code book is used
LEGACY_BOUNDARIES = ("MEDS_DEATH", "ADMISSION", "DISCHARGE", "CAREUNIT_CHANGE", "HOSPITAL_ADMISSION", "HOSPITAL_DISCHARGE", "ICU_ADMISSION", "ICU_DISCHARGE", "TRANSFER_TO", "ED_REGISTRATION", "ED_OUT")
TRANSITIONS = {
    "MEDS_BIRTH": "suppress", "MEDS_DEATH": "close_current", "ADMISSION": "open_next", "DISCHARGE": "close_current", "CAREUNIT_CHANGE": "close_open",
    "STRUCT_START_ADM": "open_next", "STRUCT_END_ADM": "close_current", "STRUCT_CAREUNIT_CHANGE": "close_open", "STRUCT_START_OR": "open_next", "STRUCT_END_OR": "close_current",
    "HOSPITAL_ADMISSION": "open_next", "HOSPITAL_DISCHARGE": "close_current", "ICU_ADMISSION": "open_next", "ICU_DISCHARGE": "close_current",
    "TRANSFER_TO": "close_open", "ED_REGISTRATION": "open_next", "ED_OUT": "close_current",
}
ACTIVE = ("open_next", "close_current", "close_open")
WINDOW_TYPES = {"UNK": 0, "ED_ADMISSION": 1, "INPATIENT": 2, "ICU": 3, "OR": 4, "POST_DISCHARGE": 5}
TYPE_OF_CODE = {"ED_REGISTRATION": "ED_ADMISSION", "ADMISSION": "INPATIENT", "HOSPITAL_ADMISSION": "INPATIENT", "CAREUNIT_CHANGE": "INPATIENT", "TRANSFER_TO": "INPATIENT", "ICU_ADMISSION": "ICU", "STRUCT_START_OR": "OR"}
#: the code book as one; ``only``: codes that are nothing but structural, ``keep``: those of them that keep their own tokens
RULES = {"labels": STRUCTURAL_LABELS, "transitions": TRANSITIONS, "types": TYPE_OF_CODE, "boundaries": BOUNDARY_LABELS, "only": (), "keep": ()}
ADMISSION_LIKE = ("TRANSFER_TO", "HOSPITAL_ADMISSION", "ADMISSION", "ICU_ADMISSION", "ED_REGISTRATION", "STRUCT_START_ADM", "STRUCT_CAREUNIT_CHANGE", "STRUCT_START_OR")
DISCHARGE_LIKE = ("HOSPITAL_DISCHARGE", "DISCHARGE", "ICU_DISCHARGE", "ED_OUT", "STRUCT_END_ADM", "STRUCT_END_OR")

# --- segmentation, chunks, trajectories (hours; tokens) ---
BUNDLE_GAP_H, BUNDLE_GAP_IDX, CHAIN_GAP_H, CHAIN_TOKENS = 0.5, 2, 6.0, 16
CHUNK_MAX, CHUNK_FRACTION, CHUNK_MIN, CHUNK_TAIL = 128, 0.8, 32, 16
WINDOW_CAP, CHUNK_CAP = 64, 8
CUTOFF_H = 744.0
CLINICAL = ("MEASUREMENT", "DIAGNOSIS", "PROCEDURE", "MEDICATION")
TYPE_TOKEN, END_TOKEN, CONTINUE_TOKEN = 10, 17, 18

# --- medication parsing ---
ACTION_SUFFIXES = ("ADMINISTERED", "NOT ADMINISTERED", "NOT GIVEN", "NOT GIVEN PER SLIDING SCALE", "CONFIRMED", "FLUSHED", "NOT FLUSHED", "STARTED", "STOPPED", "HELD", "REFUSED", "PAUSED", "RESUMED")

# --- id layout: family, offset, residual offset or 0 ---
FAMILY_OFFSETS = {
    "special": 0, "diagnosis": 1_000_000, "diagnosis_residual": 1_160_000, "procedure": 1_200_000, "procedure_residual": 1_360_000,
    "medication": 1_400_000, "med_route": 1_600_000, "med_form": 1_620_000, "med_freq": 1_640_000, "med_unit": 1_660_000,
    "med_dosage": 1_680_000, "med_rate": 1_700_000, "med_duration": 1_720_000, "medication_residual": 1_800_000,
    "measurement_code": 2_000_000, "measurement_value": 2_100_000, "structural": 2_200_000, "observation_code": 2_300_000, "observation_value": 2_320_000,
}
RESIDUAL_BUCKETS = 39_999
#: name: bins, smallest, largest, log scale
NUMERIC_BINS = {"dosage": (4, 1.0, 400.0, True), "rate": (4, 1.0, 200.0, True), "duration_hours": (4, 0.5, 72.0, True)}
#: demographic token ids
DEMOGRAPHIC_AGE = (18, 40, 65, 80)
DEMOGRAPHIC_BMI = (18.5, 25, 30, 35, 40)

# --- further fixed values: reserved observation values, process ids, lanes, word lists ---
OBSERVATION_VALUES = {"UNK": 1, "N/A": 2, "NA": 2, "NONE": 3, "NULL": 3, "": 4}
OBSERVATION_VALUE_LANE = 80_000
PROCESS_ACTIONS = {"START": 1, "END": 2, "STOP": 3}
PROCESS_DOMAINS = {"MEDICATION": 1, "PROCEDURE": 2, "INFUSION": 3}
PROCESS_ACTION_OFFSET, PROCESS_ENTITY_OFFSET, ENTITY_LANE = 2_400_000, 2_420_000, 900_000
LANES = ("logits_struct", "logits_rvq", "logits_meas", "logits_medtok")
#: block: lane
BLOCK_LANES = {
    "special": "logits_struct", "structural": "logits_struct", "measurement_value": "logits_rvq", "measurement_code": "logits_meas", "observation_code": "logits_meas", "observation_value": "logits_meas",
    "diagnosis": "logits_medtok", "diagnosis_residual": "logits_medtok", "procedure": "logits_medtok", "procedure_residual": "logits_medtok", "medication": "logits_medtok", "medication_residual": "logits_medtok",
}
BLOCK_CATEGORIES = {"special": 0, "measurement": 1, "observation": 1, "diagnosis": 2, "procedure": 3, "medication": 4, "structural": 5}
MARKER_PARTS = ("MED_MARKER::START", "MED_MARKER::END", "MED_MARKER::STOP", "//START//", "//END//", "//STOP//", "INFUSION_START", "INFUSION_END")
DOSE_FORM_WORDS = ("IV", "IVPB", "PO", "IM", "SC", "SQ", "SUBCUT", "SUBCUTANEOUS", "ORAL", "INJECTION", "INJECTABLE", "SOLUTION", "SOLN", "TABLET", "TABLETS", "CAPSULE", "CAPSULES", "SUSPENSION", "SYRUP", "ELIXIR", "VIAL", "BAG", "DRIP", "PUSH", "BOLUS", "FLUSH", "CONCENTRATE", "IMMEDIATE", "RELEASE", "EXTENDED", "ER", "XR", "SR", "DR")
RARE_KEYWORDS = ("CARDIAC ARREST", "CODE BLUE", "CPR", "DEFIB", "ROSC", "SEPSIS", "SEPTIC SHOCK", "MASSIVE TRANSFUSION", "STROKE", "HEMORRH", "INTUB", "REINTUBATION", "ECMO", "CRRT", "DIALYSIS", "RRT")
CRITICAL_KEYWORDS = ("CPR", "CARDIAC ARREST", "CODE BLUE", "SEPSIS", "SEPTIC", "SHOCK", "VASOPRESS", "INTUB", "VENT", "ECMO", "CRRT", "DIALYSIS", "RRT", "RAPID RESPONSE", "RESUS", "STROKE", "HEMORRH", "BLEED", "TRANSFUS", "ARREST")
SURFACE_PATHS = {
    "structural_transition_overlay": "STRUCTURAL path (window/boundary/overlay tokens)", "measurement_numeric_dense": "MEASUREMENT path (code2id + cVAE/RVQ value tokens)",
    "measurement_numeric_sparse": "MEASUREMENT path or promote to STRUCTURAL if transitional", "measurement_non_numeric_or_invalid": "DROP/STRUCTURAL review (not RVQ)",
    "medtok_semantic_core": "MEDTOK path (diag/proc/med canonicalization/vocab)", "medication_attributes_or_admin": "Medication attr stream or DROP/meta",
    "medication_numeric_or_attributes": "Medication numeric/attr side-channel", "admin_or_low_value_meta": "DROP/meta unless downstream task requires", "other_unclassified": "Manual review",
}
#: system: spellings of a code of it, in order
SYSTEM_SPELLINGS = {"RXNORM": ("{}", "RXNORM//{}"), "SNOMED": ("{}", "SNOMED//{}", "SNOMED/{}"), "NDC": ("NDC//{}", "{}"), "CPT4": ("CPT//{}", "{}"), "HCPCS": ("HCPCS//{}", "{}"), "ICD10PCS": ("ICD10PCS//{}", "{}"), "ICD9PROC": ("ICD9PROC//{}", "{}"), "ICD9_PROC": ("ICD9PROC//{}", "{}")}
