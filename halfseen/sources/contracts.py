"""Required columns of the named input tables; supersets are always allowed."""

# Table -> required columns.
CLINICAL = {
    "record_list": ("subject_id", "study_id", "file_name", "ecg_time"),
    "machine_measurements": ("subject_id", "study_id", "ecg_time", "rr_interval", "p_onset", "p_end", "qrs_onset", "qrs_end", "t_end",
                             "p_axis", "qrs_axis", "t_axis", *(f"report_{i}" for i in range(18))),
    "patients": ("subject_id", "gender", "anchor_age", "anchor_year", "anchor_year_group", "dod"),
    "admissions": ("subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "admission_type", "admission_location"),
    "transfers": ("subject_id", "hadm_id", "transfer_id", "eventtype", "careunit", "intime", "outtime"),
    "services": ("subject_id", "hadm_id", "transfertime", "prev_service", "curr_service"),
    "diagnoses_icd": ("subject_id", "hadm_id", "seq_num", "icd_code", "icd_version"),
    "labevents": ("subject_id", "hadm_id", "specimen_id", "itemid", "charttime", "value", "valuenum"),
    "d_labitems": ("itemid", "label", "fluid", "category"),
    "edstays": ("subject_id", "hadm_id", "stay_id", "intime", "outtime", "gender", "race", "arrival_transport", "disposition"),
    "triage": ("subject_id", "stay_id", "temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "acuity", "chiefcomplaint"),
    "echo_record_list": ("subject_id", "study_id", "dicom_filepath"),
    "echo_study_list": ("subject_id", "study_id", "study_datetime"),
    "discharge": ("note_id", "subject_id", "hadm_id", "note_type", "note_seq", "charttime", "storetime", "text"),
    "records_w_diag_icd10": ("file_name", "study_id", "subject_id", "ecg_time", "all_diag_all"),
}

# Table -> accepted places below the data folder, the published layout first.
LAYOUTS = {
    "record_list": ("mimic-iv-ecg/1.0/record_list.csv", "record_list.csv"),
    "machine_measurements": ("mimic-iv-ecg/1.0/machine_measurements.csv", "machine_measurements.csv"),
    "patients": ("mimic-iv/3.1/hosp/patients.csv.gz", "hosp/patients.csv.gz"),
    "admissions": ("mimic-iv/3.1/hosp/admissions.csv.gz", "hosp/admissions.csv.gz"),
    "transfers": ("mimic-iv/3.1/hosp/transfers.csv.gz", "hosp/transfers.csv.gz"),
    "services": ("mimic-iv/3.1/hosp/services.csv.gz", "hosp/services.csv.gz"),
    "diagnoses_icd": ("mimic-iv/3.1/hosp/diagnoses_icd.csv.gz", "hosp/diagnoses_icd.csv.gz"),
    "labevents": ("mimic-iv/3.1/hosp/labevents.csv.gz", "hosp/labevents.csv.gz"),
    "d_labitems": ("mimic-iv/3.1/hosp/d_labitems.csv.gz", "hosp/d_labitems.csv.gz"),
    "edstays": ("mimic-iv-ed/2.2/ed/edstays.csv.gz", "ed/edstays.csv.gz"),
    "triage": ("mimic-iv-ed/2.2/ed/triage.csv.gz", "ed/triage.csv.gz"),
    "echo_record_list": ("mimic-iv-echo/0.1/echo-record-list.csv", "echo-record-list.csv"),
    "echo_study_list": ("mimic-iv-echo/0.1/echo-study-list.csv", "echo-study-list.csv"),
    "discharge": ("mimic-iv-note/2.2/note/discharge.csv.gz", "note/discharge.csv.gz"),
    "records_w_diag_icd10": ("mimic-iv-ecg-ext-icd/1.0.1/records_w_diag_icd10.csv", "records_w_diag_icd10.csv"),
}

# Columns read as timestamps where a table has them.
DATETIMES = ("ecg_time", "study_datetime", "admittime", "dischtime", "deathtime", "intime", "outtime", "transfertime", "charttime",
             "storetime", "dod")

#: Tables whose cells hold line breaks: only these give up splitting a file.
MULTILINE = ("discharge",)

# Name patterns of files that may hold measurements, and what makes one count.
MEASUREMENT_FILES = ("*measur*", "*report*", "*param*", "*.csv", "*.csv.gz")
TELLING_MEASUREMENTS = ("lvef", "ivsd", "lvwt")

# Measurement -> accepted column names, first match wins.
MEASUREMENT_ALIASES = {
    "lvef": ("lvef", "ef", "lv_ef", "ejection_fraction", "lvef_pct", "lvef_percent", "ef_percent"),
    "ivsd": ("ivsd", "ivs", "ivs_d", "septal_thickness", "interventricular_septum", "ivsd_cm"),
    "lvpwd": ("lvpwd", "lvpw", "lvpw_d", "posterior_wall_thickness", "posterior_wall", "lvpwd_cm"),
    "lvwt": ("lvwt", "lv_wall_thickness", "wall_thickness", "max_wall_thickness"),
    "as_grade": ("as_grade", "aortic_stenosis", "aortic_stenosis_grade", "as_severity", "aortic_stenosis_severity"),
    "ar_grade": ("ar_grade", "aortic_regurgitation", "aortic_regurgitation_grade", "ar_severity",
                 "aortic_insufficiency"),
    "mr_grade": ("mr_grade", "mitral_regurgitation", "mitral_regurgitation_grade", "mr_severity"),
    "tr_grade": ("tr_grade", "tricuspid_regurgitation", "tricuspid_regurgitation_grade", "tr_severity"),
    "pr_grade": ("pr_grade", "pulmonic_regurgitation", "pulmonary_regurgitation", "pulmonary_regurgitation_grade",
                 "pr_severity"),
    "rv_function_grade": ("rv_function", "rv_systolic_function", "rv_dysfunction", "rv_function_grade",
                          "rv_systolic_dysfunction"),
    "pericardial_effusion_grade": ("pericardial_effusion", "pericardial_effusion_grade", "effusion"),
    "pasp": ("pasp", "rvsp", "pa_systolic_pressure", "pasp_mmhg", "rvsp_mmhg"),
    "tr_vmax": ("tr_vmax", "tr_max_velocity", "tr_velocity", "tr_peak_velocity", "trv_max"),
}
