"""Directory statistics against plain loops."""

import random
from collections import defaultdict

from cardiolake.operators import directory
from cardiolake.schema import RATE_FROM_MARK, RHYTHM_FITS


def plain_rates(rows, fs):
    """The counter played through, row by row."""
    out = defaultdict(list)
    rhythm, counter, last = "", -1, [0, 0, 0, 0]
    for sample, mark, group, noise in rows:
        if group is not None:
            last = [*last[1:], sample]
            counter += 1
            if rhythm in RHYTHM_FITS and group not in RHYTHM_FITS[rhythm]:
                counter = -1
            if counter >= 3 and last[3] > last[0]:
                out[rhythm].append(last[3] - last[0])
        elif mark is not None:
            rhythm, counter = mark, 0 if mark in RATE_FROM_MARK else -1
        if noise:
            counter = -1
    return {k: (180 * fs / max(v), 180 * fs / min(v), len(v)) for k, v in out.items()}


def test_rates_by_the_counter(spark):
    rng = random.Random(4)
    records = {r: [] for r in "abcdefgh"}
    for name, rows in records.items():
        at = 0
        if name == "b":
            rows.append((0, "VT", None, None))
        for _ in range(300):
            at += rng.choice((0, 40, 80, 90, 100))
            x = rng.random()
            kind = "VVVF" if rows and name == "b" else "NNNNNNNSVFPW"
            rows.append((at, rng.choice([*RHYTHM_FITS, "AFIB", ""]), None, None) if x < 0.08 else (at, None, None, True) if x < 0.1 else (at, None, rng.choice(kind), None))
    # a beat that doesn't fit needs four fitting ones behind it
    records["i"] = [(0, "N", None, None)] + [(100 * k, None, "V" if k == 3 else "N", None) for k in range(8)]
    flat = [(r, i, *row) for r, rows in records.items() for i, row in enumerate(rows)]
    frame = spark.createDataFrame(flat, "record string, i int, sample long, rhythm string, group string, noise boolean")
    got = defaultdict(dict)
    for r in directory.rhythm_rates(frame, ("record",), ("sample", "i"), 100.0, noise="noise").collect():
        got[r["record"]][r["in_force"]] = (r["rate_min"], r["rate_max"], r["sums"])
    assert got == {r: plain_rates(rows, 100.0) for r, rows in records.items()}
    assert got["i"] == {"N": (60.0, 60.0, 1)}


def test_st_t_pairs_by_a_plain_loop(spark):
    rng, records = random.Random(9), {}
    for r in "abcdef":
        at, rows = 0, []
        for _ in range(120):
            at += rng.choice((0, 10, 25))
            kind, sign, signal = rng.choice(("ST", "T")), rng.choice(("+", "-", "++", "--", "BP")), rng.choice(("", "0", "1", "12"))
            rows.append((at, rng.choice((f"({kind}{signal}{sign}", f"{kind}{signal}{sign})", f"A{kind}{signal}{sign}{rng.choice(('', '0', '150', '90'))}", "ST", "(N"))))
        records[r] = rows
    want = {}
    for r, rows in records.items():
        opened, episodes, extreme = {}, defaultdict(list), defaultdict(int)
        for at, note in rows:
            body = note.strip("()A")
            if not body.startswith(("ST", "T")) or body == "ST" or note == "(N":
                continue
            kind = "ST" if body.startswith("ST") else "T"
            rest = body[len(kind) :]
            digits = "".join(c for c in rest[:2] if c.isdigit()) if rest[:1].isdigit() else ""
            rest = rest[len(digits) :]
            sign = next(s for s in ("++", "--", "BP", "+", "-") if rest.startswith(s))
            key = kind, int(digits or 0), sign
            if kind == "ST" and len(sign) > 1:
                continue
            if note[0] == "A":
                if sign != "BP" and rest[len(sign) :]:
                    extreme[kind, key[1], sign[0]] = max(extreme[kind, key[1], sign[0]], int(rest[len(sign) :]))
            elif note[0] == "(":
                opened[key] = at
            else:
                episodes[key].append(at - opened.pop(key, 0))
        for key, at in opened.items():
            if at > 0:
                episodes[key].append(5_000 - at)
        for (kind, signal, sign), spans in episodes.items():
            want[r, kind, signal, sign] = len(spans), sum(spans) / 100.0, extreme.get((kind, signal, sign[0])) or None
    flat = [(r, i, at, note, 5_000) for r, rows in records.items() for i, (at, note) in enumerate(rows)]
    frame = spark.createDataFrame(flat, "record string, i int, sample long, note string, record_end long")
    got = {(r["record"], r["type"], r["signal"], r["sign"]): (r["episodes"], r["seconds"], r["extreme"]) for r in directory.st_t_summary(frame, ("record",), ("sample", "i"), 100.0).collect()}
    assert got == want
