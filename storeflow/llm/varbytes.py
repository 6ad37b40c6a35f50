"""Byte-aligned variable-length integers with separate control bytes.

Four values share a control byte (two bits each: bytes of the value minus
one); their bytes follow in a stream of their own.  Decoding looks the
lengths of a control byte up in a table and gathers whole blocks at once.
Each document's values begin with a fresh control byte, so documents can be
cut out and joined without recoding.
"""

from __future__ import annotations

import numpy as np

# Control byte -> lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def _slots(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First slot of each document and which slots hold a value."""
    groups = -(-counts // 4)
    first = 4 * (np.cumsum(groups) - groups)
    used = np.ones(4 * int(groups.sum()), bool)
    ends, limits = first + counts, first + 4 * groups
    for k in range(3):
        used[(ends + k)[ends + k < limits]] = False
    return first, used


def encode(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` of documents in a row (``counts`` each) -> control bytes
    and data bytes."""
    counts = counts.astype(np.int64)
    values = values.astype(np.uint32)
    size = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    _, used = _slots(counts)
    code = np.zeros(len(used), np.uint8)
    code[used] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    ends = np.cumsum(size)
    at = ends - size
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        sel = size > k
        if k and not sel.any():
            break
        data[at[sel] + k] = (values[sel] >> np.uint32(8 * k)).astype(np.uint8)
    return control, data


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of all documents in a row."""
    _, used = _slots(counts.astype(np.int64))
    size = LENGTHS[control].ravel()[used]
    ends = np.cumsum(size)
    if (int(ends[-1]) if len(ends) else 0) != len(data):
        raise ValueError("control and data bytes disagree")
    at = ends - size
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        sel = np.flatnonzero(size > k)
        if not len(sel):
            break
        out[sel] |= data[at[sel] + k].astype(np.uint32) << np.uint32(8 * k)
    return out
