"""The live monitor's state as plain data, and the steps that move it: the same for streams and tables."""

from __future__ import annotations

import copy
import math
from array import array
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby, pairwise

import numpy as np

from cardiolake.functions.dsp import bandpass_whole, detect_beats, mean_and_std
from cardiolake.schema import ALARM_OFF, ALARM_ON, ALARM_SCORE, ECTOPY_LAST, ECTOPY_OFF, ECTOPY_ON, ENTROPY_BINS, LIVE_HOP_S, LIVE_MIN_COVERAGE, LIVE_MIN_RR, LIVE_WINDOW_S, REFRACTORY_S, RR_LIVE, RR_RANGE

TREND = 20


@dataclass
class Alarm:
    run: int = 0
    clear: int = 0
    on: bool = False
    last_good: int | None = None

    def step(self, at: int, score: float | None, hop: int) -> bool:
        """One evaluation; a missing score holds the state, a long gap between good ones restarts the counts. True where the flag turns."""
        if score is None:
            return False
        if self.last_good is not None and at - self.last_good > 2 * hop:
            self.run = self.clear = 0
        self.last_good = at
        if score >= ALARM_SCORE:
            self.run, self.clear = self.run + 1, 0
        else:
            self.run, self.clear = 0, self.clear + 1
        before = self.on
        if not self.on and self.run >= ALARM_ON:
            self.on = True
        elif self.on and self.clear >= ALARM_OFF:
            self.on = False
        return self.on != before


@dataclass
class Monitor:
    """What is kept of one device between batches."""

    clock: int = 0
    buffer: array = field(default_factory=lambda: array("d"))
    beats: list[int] = field(default_factory=list)
    leadoff: list[int] = field(default_factory=list)
    last_rhythm: int = 0
    labels: list[int] = field(default_factory=list)
    ectopy: bool = False
    trend: list[float | None] = field(default_factory=list)
    alarm: Alarm = field(default_factory=Alarm)
    fs_fatal: bool = False
    fs_warned: bool = False
    first_at: float | None = None
    next_rate_check: int = 0


#: Seconds of samples between checks of the sampling rate.
RATE_CHECK_S = 60


def rhythm_features(beats: np.ndarray, fs: float) -> dict:
    """Counters and features of one window of beat places."""
    rr = np.diff(np.asarray(beats, dtype=np.int64)) / fs
    ok = (rr >= RR_RANGE[0]) & (rr <= RR_RANGE[1])
    good = rr[ok]
    d = np.diff(rr)[ok[1:] & ok[:-1]] if len(rr) > 1 else np.zeros(0)
    out = {"n_rr_used": len(good), "n_rr_rejected": int((~ok).sum()), "n_drr_used": len(d), "mean_rr": None, "hr": None, "hrv_sdnn": None, "rmssd": None, "pnn50": None, "cv_rr": None, "rr_entropy": None}
    if len(good):
        out["mean_rr"], _ = mean_and_std(good)
        out["hr"] = 60.0 / out["mean_rr"]
    if len(good) > 1:
        _, out["hrv_sdnn"] = mean_and_std(good, 1)
        out["cv_rr"] = out["hrv_sdnn"] / out["mean_rr"]
        low, high = RR_RANGE
        p = np.bincount(np.maximum(np.minimum(((good - low) / (high - low) * ENTROPY_BINS).astype(int), ENTROPY_BINS - 1), 0)) / len(good)
        p = p[p > 0]
        out["rr_entropy"] = abs(float((p * np.log2(p)).sum()))
    if len(d):
        out["rmssd"] = math.sqrt(np.add.reduce(d * d) / len(d))
        out["pnn50"] = np.count_nonzero(np.abs(d) > 0.05) / len(d)
    return out


def default_score(f: dict) -> float:
    """Irregularity as a stand-in score between 0 and 1: variation and entropy through a logistic curve."""
    return 1 / (1 + math.exp(-(40 * (f["cv_rr"] - 0.10) + 1.5 * (f["rr_entropy"] - 1.5))))


def evaluate(state: Monitor, fs: float, score=default_score) -> dict:
    """One rhythm evaluation: status by the gates in order, features, score."""
    f = rhythm_features(np.array(state.beats), fs)
    coverage = (f["n_rr_used"] * f["mean_rr"] / LIVE_WINDOW_S) if f["mean_rr"] else 0.0
    if state.clock < LIVE_WINDOW_S * fs:
        status = "warmup"
    elif state.leadoff:
        status = "leadoff"
    elif f["n_rr_used"] < LIVE_MIN_RR or f["n_drr_used"] < 1 or coverage < LIVE_MIN_COVERAGE:
        status = "low_quality"
    elif any(f[k] is None or not math.isfinite(f[k]) for k in ("mean_rr", "hr", "hrv_sdnn", "rmssd", "pnn50", "cv_rr", "rr_entropy")):
        status = "not_finite"
    else:
        status = "ok"
    return f | {"status": status, "coverage": coverage, "leadoff": len(state.leadoff), "af_score": score(f) if status == "ok" else None}


def check_rate(state: Monitor, at: float, fs: float) -> list[dict]:
    """Once a minute of samples: the measured rate against the expected one, by the arrival time (seconds) of the last sample.

    Far off, the rhythm is scored no more, for good; beats go on. Near enough to be warned of, it is said once.
    """
    if state.first_at is None:
        state.first_at, state.next_rate_check = at, state.clock + int(RATE_CHECK_S * fs)
    if state.fs_fatal or state.clock < state.next_rate_check:
        return []
    state.next_rate_check = state.clock + int(RATE_CHECK_S * fs)
    rate, verdict = rate_check(state.clock, at - state.first_at, fs)
    if verdict == "ok" or verdict == "warn" and state.fs_warned:
        return []
    state.fs_warned, state.fs_fatal = True, verdict == "fatal"
    return [{"kind": "alert", "sample_pos": state.clock, "status": f"fs_{verdict}", "hr": None, "coverage": rate / fs}]


def push_all(state: Monitor, lines, fs: float, score=default_score) -> list[dict]:
    """The rows of lines and their arrival times (seconds, or None); a line that fails is a row of kind 'error', and the next one goes on.

    Lines of samples without times that follow each other are pushed as one block; if that fails, one by one.
    """
    rows: list[dict] = []
    for together, group in groupby(lines, key=lambda x: x[1] is None and isinstance(x[0], str) and x[0].replace("\n", "").isdigit()):
        own = list(group)
        if together and len(own) > 1:
            before = copy.deepcopy(state)
            try:
                rows += push(state, "\n".join(line for line, _ in own), fs, score)
                continue
            except Exception:
                vars(state).update(vars(before))
        for line, at in own:
            try:
                rows += push(state, line, fs, score)
                if at is not None:
                    rows += check_rate(state, float(at), fs)
            except Exception as fault:  # one faulty chunk or model must not end a device's stream
                state.buffer = state.buffer[-int(fs) :]
                rows.append({"kind": "error", "sample_pos": state.clock, "status": f"{type(fault).__name__}: {fault}"[:200]})
    return rows


@lru_cache(maxsize=16)
def _places(digits: int) -> tuple[np.ndarray, float]:
    """What each digit of a number counts, and what they all count if each one is the sign 0 itself."""
    powers = 10.0 ** np.arange(digits - 1, -1, -1)
    return powers, ord("0") * float(powers.sum())


def block_samples(block: str) -> np.ndarray | None:
    """The samples of a block of lines; None if a line isn't of digits alone. Lines of one length are read at once."""
    digits = block.replace("\n", "")
    if not (digits.isascii() and digits.isdigit()):
        return None
    width = block.index("\n") + 1
    n, rest = divmod(len(block) + 1, width)
    if not rest and 1 < width <= 16 and len(digits) == n * (width - 1) and block[width - 1 :: width] == "\n" * (n - 1):
        powers, zeros = _places(width - 1)
        return np.frombuffer(digits.encode(), np.uint8).reshape(n, width - 1) @ powers - zeros
    lines = block.split("\n")
    return np.array([float(int(x)) for x in lines]) if all(lines) else None


def push(state: Monitor, line: str, fs: float, score=default_score) -> list[dict]:
    """One line from the device, or a block of lines as one read brings them; the rows that it brings about.

    A sample moves the clock; a lead-off mark or anything else does not. Five seconds make a chunk; behind it two
    seconds stay if its intervals could be used, one if not. Beats join the history before that is decided.
    """
    if "\n" in line:
        samples = block_samples(line)
        if samples is None:
            return [row for x in line.split("\n") for row in push(state, x, fs, score)]
        rows = []
        while len(samples):
            own = samples[: int(5 * fs) - len(state.buffer)]
            state.buffer.frombytes(own.tobytes())
            state.clock += len(own)
            samples = samples[len(own) :]
            rows += _chunk(state, fs, score)
        return rows
    if line == "!":
        state.leadoff.append(state.clock)
        return []
    if not (line.isascii() and line.isdigit()):
        return []
    state.clock += 1
    state.buffer.append(float(int(line)))
    return _chunk(state, fs, score)


def _chunk(state: Monitor, fs: float, score) -> list[dict]:
    """The rows of the buffer once it is full."""
    if len(state.buffer) < int(5 * fs):
        return []
    rows: list[dict] = []
    found = detect_beats(bandpass_whole(np.array(state.buffer), fs), fs).tolist()
    first = state.clock - len(state.buffer)
    for p in found:
        at = first + p
        if not state.beats or at - state.beats[-1] >= REFRACTORY_S * fs:
            state.beats.append(at)
    oldest = state.clock - LIVE_WINDOW_S * fs
    state.beats = [b for b in state.beats if b >= oldest]
    state.leadoff = [b for b in state.leadoff if b >= oldest]
    if state.clock - state.last_rhythm >= LIVE_HOP_S * fs and not state.fs_fatal:
        state.last_rhythm = state.clock
        verdict = evaluate(state, fs, score)
        turned = state.alarm.step(state.clock, verdict["af_score"], int(LIVE_HOP_S * fs))
        state.trend = [*state.trend, verdict["af_score"]][-TREND:]
        rows.append({"kind": "rhythm", "sample_pos": state.clock, "alarm": state.alarm.on, "af_run": state.alarm.run, **verdict})
        if turned:
            rows.append({"kind": "alert", "sample_pos": state.clock, "alarm": state.alarm.on, "status": "af"})
    good = [rr for rr in ((b - a) / fs for a, b in pairwise(found)) if RR_LIVE[0] < rr < RR_LIVE[1]]
    if good:
        _, spread = mean_and_std(np.array(good[-5:]))
        abnormal = int(len(good) > 1 and spread > 0.12)
        state.labels = [*state.labels, abnormal][-ECTOPY_LAST:]
        rows.append({"kind": "beat", "sample_pos": state.clock, "mean_rr": good[-1], "hr": 60.0 / good[-1], "hrv_sdnn": spread, "status": "Abnormal" if abnormal else "Normal"})
        before = state.ectopy
        state.ectopy = sum(state.labels) >= ECTOPY_ON if not before else sum(state.labels) > ECTOPY_OFF
        if state.ectopy != before:
            rows.append({"kind": "alert", "sample_pos": state.clock, "alarm": state.ectopy, "status": "ectopy"})
        state.buffer = state.buffer[-int(2 * fs) :]
    else:
        state.buffer = state.buffer[-int(1 * fs) :]
    return rows


def rate_check(samples: int, seconds: float, fs: float, warn: float = 0.05, fatal: float = 0.15) -> tuple[float, str]:
    """The measured sampling rate, and whether it is near enough to the expected one."""
    rate = samples / seconds if seconds > 0 else 0.0
    off = abs(rate - fs) / fs
    return rate, "fatal" if off > fatal else "warn" if off > warn else "ok"
