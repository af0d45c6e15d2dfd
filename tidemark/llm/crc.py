"""Running CRC-32 of whole byte strings, and the CRC of any part of them from two of its prefixes.

A CRC register is linear over GF(2): the register after ``A B`` is that of ``A``, moved on over ``len(B)`` zero bytes,
xor that of ``B``. So the CRC of ``B`` follows from the running registers at its two ends. Moving on over n zero bytes is
a linear map of 32 bits; one table for each base-256 digit of n holds it for every byte of a register.
"""

from __future__ import annotations

import functools

import numpy as np

FULL = np.uint32(0xFFFFFFFF)
#: Reversed generator polynomial of CRC-32 (fixed value).
POLYNOMIAL = np.uint32(0xEDB88320)
ROW = 64


@functools.cache
def byte_table() -> np.ndarray:
    """Register after one byte, from zero."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (POLYNOMIAL * (t & np.uint32(1)))
    return t


def _zero(register: np.ndarray) -> np.ndarray:
    return byte_table()[register & np.uint32(255)] ^ (register >> np.uint32(8))


def _through(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    """A linear map given by its values on every byte of a register."""
    out = table[0][register & np.uint32(255)]
    for i in range(1, 4):
        out = out ^ table[i][(register >> np.uint32(8 * i)) & np.uint32(255)]
    return out


@functools.cache
def _moves(level: int) -> np.ndarray:
    """(256, 4, 256): the move over ``d * 256 ** level`` zero bytes for each digit d."""
    same = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    out = np.empty((256, 4, 256), np.uint32)
    out[0] = same
    step = None if level == 0 else _through(_moves(level - 1)[255], _through(_moves(level - 1)[1], same))
    for d in range(1, 256):
        out[d] = _zero(out[d - 1]) if step is None else _through(step, out[d - 1])
    return out


def moved(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers moved on over ``n`` zero bytes each."""
    register = np.array(np.broadcast_to(register, n.shape), np.uint32)
    level = 0
    while n.size and int(n.max()) >> (8 * level):
        digit = (n >> (8 * level)) & 255
        at = np.flatnonzero(digit)
        table, d, r = _moves(level), digit[at], register[at]
        out = table[d, 0, r & np.uint32(255)]
        for i in range(1, 4):
            out ^= table[d, i, (r >> np.uint32(8 * i)) & np.uint32(255)]
        register[at] = out
        level += 1
    return register


def running(data: np.ndarray, carry: int = 0) -> np.ndarray:
    """Registers before the first and after every byte of ``data``, begun with ``carry``.

    Rows of 64 bytes run side by side from zero; what each row's beginning carries in is the running register of the
    rows before, found the same way over rows of rows.
    """
    n = len(data)
    rows = max(1, -(-n // ROW))
    grid = np.zeros(rows * ROW, np.uint8)
    grid[:n] = data
    columns = np.ascontiguousarray(grid.reshape(rows, ROW).T)
    local, table = np.empty((rows, ROW), np.uint32), byte_table()
    register = np.zeros(rows, np.uint32)
    for i in range(ROW):
        register = table[(register & np.uint32(255)) ^ columns[i]] ^ (register >> np.uint32(8))
        local[:, i] = register
    into = _carried(local[:, -1], carry)
    out = np.empty(n + 1, np.uint32)
    out[0] = carry
    for i in range(ROW):
        local[:, i] ^= _through(_moves(0)[i + 1], into)
    out[1:] = local.reshape(-1)[:n]
    return out


def _carried(ends: np.ndarray, carry: int, width: int = ROW) -> np.ndarray:
    """Registers at the beginnings of consecutive pieces of ``width`` bytes whose registers from zero are ``ends``."""
    before = np.empty(len(ends), np.uint32)
    before[0] = carry
    before[1:] = ends[:-1]
    span = 1
    while span < len(before):  # prefix sums under the move, doubled
        late = before[span:] ^ moved(before[:-span], np.full(len(before) - span, span * width, np.int64))
        before[span:] = late
        span *= 2
    return before


def part(before: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes between two running registers, ``length`` apart."""
    return after ^ moved(before ^ FULL, length) ^ FULL
