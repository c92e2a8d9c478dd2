"""Encoded attributes hidden at the end of string values.

Every even place of a value is read as an element header at once, in arrays. A place points to where its element would
end; pointers are followed by doubling, so that all runs of elements that reach the value's end are known after as many
steps as the length has binary digits. The values of a batch lie in one buffer, each with an end of its own, and are followed together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from radiolith.functions.values import KNOWN_VRS, LONG_FORM_VRS

# The representations that are scanned, and bytes below 0x20 that some of them may hold.
SCANNABLE = ("AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT")
CONTROLS = {**dict.fromkeys(("LT", "ST", "UT"), (9, 10, 12, 13, 27)), **dict.fromkeys(("LO", "SH", "UC", "PN"), (27,))}
WINDOW = 1 << 20
ITEM_GROUP, UNDEFINED = 0xFFFE, 0xFFFFFFFF

_code = lambda vr: vr.encode()[0] << 8 | vr.encode()[1]
_SHORT, _LONG = (np.isin(np.arange(1 << 16), [_code(v) for v in vrs]) for vrs in ([v for v in KNOWN_VRS if v not in LONG_FORM_VRS], LONG_FORM_VRS))  # by code


def headers(data: np.ndarray, encoding: str, at: np.ndarray | None = None, n: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(end, tag)`` of the element that would begin at each even place with 8 bytes or more left; end 0 if none could, tag -1 for item marks.

    Or at the places ``at``, each with its own end of data ``n``.
    """
    if at is None:
        n, at = len(data), np.arange(0, len(data) - 7, 2)
    wide = np.concatenate([data, np.zeros(12, dtype=np.uint8)]).astype(np.int64)
    weights = (8, 0) if encoding == "explicit-be" else (0, 8)
    half = lambda skip: wide[at + skip] << weights[0] | wide[at + skip + 1] << weights[1]
    full = lambda skip: half(skip) << 2 * weights[0] | half(skip + 2) << 2 * weights[1]
    tag = half(0) << 16 | half(2)
    if encoding == "implicit-le":
        fine, size, length = tag != 0, 8, full(4)
    else:
        vr = wide[at + 4] << 8 | wide[at + 5]
        long = _LONG[vr]
        fine = (tag != 0) & (_SHORT[vr] | (long & (half(6) == 0) & (at + 12 <= n)))
        size, length = np.where(long, 12, 8), np.where(long, full(8), half(6))
    end = at + size + length
    end = np.where(fine & (length != UNDEFINED) & (length % 2 == 0) & (end <= n), end, 0)
    mark = tag >> 16 == ITEM_GROUP
    return np.where(mark, at + 8, end), np.where(mark, -1, tag)


def find_embedded(value: bytes, vr: str, encoding: str, acts: Callable[[str], bool]) -> tuple[list[str], int] | None:
    """``(tags that a rule acts on, number of elements)`` of a run of elements that reaches the value's end exactly.

    The run begins at an even offset within the last MiB, holds an element that ``acts`` names, and from its start on a
    byte that the representation may not hold.
    """
    data = np.frombuffer(value[-WINDOW:], dtype=np.uint8)
    if vr not in SCANNABLE or len(data) < 8 or len(data) % 2:
        return None
    odd = ((data < 0x20) & ~np.isin(data, CONTROLS.get(vr, ()))) | (data == 0x7F)
    if not odd.any():
        return None
    end, tag = headers(data, encoding)
    last, dead = len(data) // 2, len(data) // 2 + 1  # where a run is complete, and where one breaks off
    to = np.full(dead + 1, dead)
    to[: len(end)] = np.where(end > 0, end // 2, dead)
    to[last] = last
    names = {t: acts(f"{t:08X}") for t in np.unique(tag[(end > 0) & (tag >= 0)]).tolist()}
    hit = np.zeros(dead + 1, dtype=bool)
    hit[: len(tag)] = np.isin(tag, [t for t, acted in names.items() if acted]) & (end > 0)
    leap, met = to, hit
    for _ in range(last.bit_length()):
        met, leap = met | met[leap], leap[leap]
    starts = np.flatnonzero((leap == last) & met)
    if not len(starts) or not odd[2 * starts[0] :].any():
        return None
    at, tags, count = int(starts[0]), [], 0
    while at < last:
        if tag[at] >= 0:
            count += 1
            tags += [f"{tag[at]:08X}"] * names[int(tag[at])]
        at = int(to[at])
    return tags, count


#: Bytes of values that are followed together: arrays of these stay in a processor's cache.
CHUNK = 1 << 16


def find_in_batch(values: list[bytes | None], vrs: list[str], encodings: list[str], acts: Callable[[str], bool]) -> np.ndarray:
    """For each value whether ``find_embedded`` finds a run in it."""
    out = np.zeros(len(values), dtype=bool)
    groups: dict[tuple[str, tuple[int, ...]], list[int]] = {}
    for i, (value, vr) in enumerate(zip(values, vrs, strict=True)):
        # an even window of an odd value is as long as the window
        if value is not None and vr in SCANNABLE and len(value) >= 8 and min(len(value), WINDOW) % 2 == 0:
            groups.setdefault((encodings[i], CONTROLS.get(vr, ())), []).append(i)
    for (encoding, controls), rows in groups.items():
        held, size = [], 0
        for i in rows:
            held.append(i)
            size += min(len(values[i]), WINDOW)
            if size >= CHUNK:
                out[held] = _followed([values[k] for k in held], encoding, controls, acts)
                held, size = [], 0
        if held:
            out[held] = _followed([values[k] for k in held], encoding, controls, acts)
    return out


def _followed(values: list[bytes], encoding: str, controls: tuple[int, ...], acts: Callable[[str], bool]) -> np.ndarray:
    """Whether each of the values, all of even length, ends in a run that counts."""
    values = [v[-WINDOW:] for v in values]
    data = np.frombuffer(b"".join(values), dtype=np.uint8)
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    ends = np.cumsum(lengths)
    byte = np.arange(256)
    odd = (((byte < 0x20) & ~np.isin(byte, controls)) | (byte == 0x7F))[data]
    seen = np.concatenate([[0], np.cumsum(odd)])
    places = len(data) // 2
    owner = np.repeat(np.arange(len(values)), lengths // 2)
    limit = ends[owner]
    at = 2 * np.arange(places)
    # values without a byte that they may not hold have no run, and a place too near the end no header
    able = np.flatnonzero((at + 8 <= limit) & (seen[limit] > seen[limit - lengths[owner]]))
    end, tag = headers(data, encoding, at[able], limit[able])
    dead = places + len(values)
    to = np.full(dead + 1, dead)
    done = end == limit[able]
    to[able] = np.where(end == 0, dead, np.where(done, places + owner[able], np.minimum(end, len(data) - 1) // 2))
    to[places:] = np.arange(places, dead + 1)
    names = np.array([t for t in np.unique(tag[(end > 0) & (tag >= 0)]).tolist() if acts(f"{t:08X}")], dtype=np.int64)
    met = np.zeros(dead + 1, dtype=bool)
    met[able] = np.isin(tag, names) & (end > 0)
    leap = to
    for _ in range(int(lengths.max(initial=2) // 2).bit_length()):
        met, leap = met | met[leap], leap[leap]
    starts = np.flatnonzero((leap[:places] == places + owner) & met[:places])
    out = np.zeros(len(values), dtype=bool)
    first, index = np.unique(owner[starts], return_index=True)
    out[first] = seen[ends[first]] > seen[2 * starts[index]]
    return out
