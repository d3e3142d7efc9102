"""Codes, classes, limits and table schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the annotation codes.
BEAT_CODES = (1, 4, 5, 8, 9, 13)
Q_CODES, V_CODES, SV_CODES = (13,), (5,), (4, 8, 9)
NON_BEAT_CODES = (0, 14, 16, 22, 28)
# Rhythm note prefixes in the order in which they are tested, and the display order of the classes.
RHYTHM_PREFIXES = (("(AFIB", "AFib"), ("(AFL", "AFlutter"), ("(N", "NSR"))
RHYTHM_CLASSES = ("NSR", "AFib", "AFlutter")
# Limits of intervals between beats, in seconds.
RR_RANGE, RR_LIVE, RR_BEAT_MAX = (0.24, 2.0), (0.3, 2.0), 3.0
PNN_SECONDS, ENTROPY_BINS = 0.05, 16
# Quality of windows.
MIN_BEATS, MIN_COVERED, MIN_PURITY = 30, 0.5, 0.7
# The live monitor: window, hop, counts that switch the alarm, score, and counts of the ectopy alert.
LIVE_WINDOW_S, LIVE_HOP_S, ALARM_ON, ALARM_OFF, ALARM_SCORE = 60, 15, 3, 2, 0.90
ECTOPY_LAST, ECTOPY_ON, ECTOPY_OFF = 10, 5, 2
LIVE_MIN_RR, LIVE_MIN_COVERAGE, REFRACTORY_S = 29, 0.5, 0.2
# Names of the directory's rhythms, with the one that stands for none.
DIRECTORY_RHYTHMS = ("Normal sinus rhythm", "Sinus bradycardia", "Atrial bigeminy", "Atrial fibrillation", "Atrial flutter", "Supraventricular tachyarrhythmia", "Pre-excitation", "Nodal rhythm", "Paced rhythm", "Idioventricular rhythm", "Ventricular bigeminy", "Ventricular trigeminy", "Ventricular tachycardia", "Ventricular flutter", "Second-degree heart block", "Unspecified")

# Kinds of beats (N, S, V, F, P paced, W flutter wave) between which a rate can be measured, for the rhythms in which not all can; and
# the rhythms whose first interval counts from the beat before their mark.
RHYTHM_FITS = {"N": "NP", "SBR": "NP", "BII": "NP", "B22": "NP", "B3": "NP", "SAB": "NP", "PREX": "NP", "AB": "NSP", "NOD": "NSP", "EAR": "S", "SVTA": "S", "P": "P", "IVR": "VFW", "VT": "VFW", "VFL": "W"}
RATE_FROM_MARK = ("SVTA", "VT")

ANNOTATIONS = "patient_id string, segment int, ann_idx int, sample long, code int, notes array<string>"
BEATS = "patient_id string, segment int, sample long, code int"
SPANS = "patient_id string, segment int, start_sample long, end_sample long, rhythm string"
HEADER = "record_id string, nsig int, fs double, n_samples long, signals array<struct<file: string, fmt: int, gain: double, baseline: int, adc_res: int, adc_zero: int, init: int, checksum: int, block: int, lead: string>>, age int, sex string, meds string, notes array<string>"


def rhythm_of(note: Column) -> Column:
    """Class of a rhythm note by prefix; null for any other note."""
    out = None
    for prefix, name in RHYTHM_PREFIXES:
        test = note.startswith(prefix)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def is_beat(code: Column) -> Column:
    return code.isin(*BEAT_CODES)


def is_rr_beat(code: Column) -> Column:
    """Beats between which intervals are taken: all but the unclassifiable."""
    return code.isin(*[c for c in BEAT_CODES if c not in Q_CODES])


def class_id(rhythm: Column) -> Column:
    out = F.when(rhythm == RHYTHM_CLASSES[0], 0)
    for i, name in enumerate(RHYTHM_CLASSES[1:], 1):
        out = out.when(rhythm == name, i)
    return out
