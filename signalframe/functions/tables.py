"""Fixed lookup tables: dataset registry, channel vocabulary, label dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DATASET_COLUMNS = (
    "dataset_id", "modality", "task", "sampling_rate", "num_channels", "montage", "has_coordinates",
    "reference_type", "derivation_type", "emg_region", "num_classes", "requires_agreement",
)
DATASET_SCHEMA = (
    "dataset_id string, modality string, task string, sampling_rate double, num_channels int, montage string, "
    "has_coordinates boolean, reference_type string, derivation_type string, emg_region string, "
    "num_classes int, requires_agreement boolean"
)

# Known corpora.
_19 = "standard_1020_19"
_LEAD = "ecg_12lead"
DATASETS = [
    ("tueg", "eeg", "pretrain", 256.0, None, _19, True, "unknown", "monopolar", "unknown", None, True),
    ("siena", "eeg", "pretrain", 512.0, None, _19, True, "unknown", "monopolar", "unknown", None, False),
    ("tuab", "eeg", "classification", 256.0, None, _19, True, "unknown", "monopolar", "unknown", 2, True),
    ("tuar", "eeg", "multilabel", 256.0, None, _19, True, "unknown", "monopolar", "unknown", 5, True),
    ("tusl", "eeg", "classification", 256.0, None, _19, True, "unknown", "monopolar", "unknown", 4, True),
    ("bci_iv_2a", "eeg", "classification", 250.0, 22, "standard_1010_61", True, "unknown", "monopolar", "unknown", 4, False),
    ("seizeit2", "eeg", "classification", 256.0, None, _19, True, "unknown", "monopolar", "unknown", 2, True),
    ("mpdb", "eeg", "classification", 256.0, None, _19, True, "unknown", "monopolar", "unknown", 3, False),
    ("mimic_iv_ecg", "ecg", "pretrain", 500.0, 12, None, False, "unknown", _LEAD, "unknown", None, False),
    ("ptbxl", "ecg", "classification", 500.0, 12, None, False, "unknown", _LEAD, "unknown", 5, False),
    ("cpsc2018", "ecg", "multilabel", 500.0, 12, None, False, "unknown", _LEAD, "unknown", 9, False),
    ("shaoxing", "ecg", "multilabel", 500.0, 12, None, False, "unknown", _LEAD, "unknown", 4, False),
    ("ninapro_db6", "semg", "pretrain", 2000.0, 14, None, False, "unknown", "monopolar", "limb", None, False),
    ("epn612", "semg", "classification", 200.0, 8, None, False, "unknown", "monopolar", "limb", 6, False),
    ("synthetic_eeg", "eeg", "pretrain", 256.0, None, _19, True, "unknown", "monopolar", "unknown", None, False),
    ("synthetic_ecg", "ecg", "pretrain", 500.0, 12, None, False, "unknown", _LEAD, "unknown", None, False),
    ("synthetic_semg", "semg", "pretrain", 1000.0, 8, None, False, "unknown", "monopolar", "limb", None, False),
]

# Modalities and body regions.
MODALITIES = ("eeg", "ecg", "semg")
EMG_REGIONS = ("limb", "facial", "trunk", "unknown")

# Channel ids are positions in this list and are append-only.
PAD_ID, UNK_ID = 0, 1
CHANNEL_VOCABULARY = [
    "<pad>", "<unk>", "Fpz-Cz", "Pz-Oz", "Fp1-F7", "F7-T3", "T3-T5", "T5-O1", "Fp2-F8", "F8-T4",
    "T4-T6", "T6-O2", "Fp1-F3", "F3-C3", "C3-P3", "P3-O1", "Fp2-F4", "F4-C4", "C4-P4", "P4-O2",
    "Fz-Cz", "Cz-Pz", "Fp1", "Fpz", "Fp2", "AF7", "AF3", "AFz", "AF4", "AF8",
    "F7", "F5", "F3", "F1", "Fz", "F2", "F4", "F6", "F8", "FT7",
    "FC5", "FC3", "FC1", "FCz", "FC2", "FC4", "FC6", "FT8", "T7", "C5",
    "C3", "C1", "Cz", "C2", "C4", "C6", "T8", "TP7", "CP5", "CP3",
    "CP1", "CPz", "CP2", "CP4", "CP6", "TP8", "P9", "P7", "P5", "P3",
    "P1", "Pz", "P2", "P4", "P6", "P8", "P10", "PO7", "PO3", "POz",
    "PO4", "PO8", "O1", "Oz", "O2", "Iz",
]

# Diagnosis superclasses in rising priority.
SUPERCLASS_PRIORITY = {"NORM": 0, "MI": 1, "STTC": 2, "CD": 3, "HYP": 4}

# Nine-class diagnosis codes (SNOMED CT).
NINE_CLASS_CODES = {
    "SNR": ["426783006"],
    "AF": ["164889003"],
    "IAVB": ["270492004"],
    "LBBB": ["733534002", "164909002"],
    "RBBB": ["713427006", "59118001"],
    "PAC": ["284470004"],
    "PVC": ["427172004", "164884008", "17338001"],
    "STD": ["429622005"],
    "STE": ["164931005"],
}

# Four-class rhythm codes and acronyms.
FOUR_CLASS_CODES = {
    "SB": ["426177001"],
    "AFIB": ["164889003", "164890007"],
    "GSVT": ["426761007", "713422000", "233896004", "233897008", "195101003"],
    "SR": ["427084000", "426783006", "427393009"],
}
FOUR_CLASS_ACRONYMS = {
    "SB": ["SB"],
    "AFIB": ["AFIB", "AF", "AFL"],
    "GSVT": ["SVT", "AT", "AVNRT", "AVRT", "SAAWR"],
    "SR": ["SR", "SI", "ST"],
}

# Gestures, sleep stages, exercise label offsets.
GESTURES = {"noGesture": 0, "waveIn": 1, "waveOut": 2, "pinch": 3, "open": 4, "fist": 5, "notProvided": 6}
INVALID_GESTURE = 6
SLEEP_STAGES = {
    "Sleep stage W": 0, "Sleep stage 1": 1, "Sleep stage 2": 2,
    "Sleep stage 3": 3, "Sleep stage 4": 3, "Sleep stage R": 4,
}

# EEG bands in Hz, half open.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}


def datasets(spark: SparkSession, modality: str | None = None) -> DataFrame:
    rows = [r for r in DATASETS if modality is None or r[1] == modality]
    return spark.createDataFrame(rows, DATASET_SCHEMA)


def dictionary(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    """``(code, class_id)`` with classes numbered in mapping order."""
    rows = [(code, i) for i, codes in enumerate(mapping.values()) for code in codes]
    return spark.createDataFrame(rows, "code string, class_id int")


def label_table(spark: SparkSession, mapping: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "name string, label int")


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(CHANNEL_VOCABULARY)], "channel string, channel_id int")
