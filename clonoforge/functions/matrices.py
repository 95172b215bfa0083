"""Residue substitution matrices."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from clonoforge.functions.columns import RESIDUES

# The public BLOSUM62 scores, lower triangle, residues in the order of RESIDUES.
BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""

# The public BLOSUM62 pair frequencies, lower triangle.
PAIR_FREQUENCIES = """
A 0.0215
R 0.0023 0.0178
N 0.0019 0.0020 0.0141
D 0.0022 0.0016 0.0037 0.0213
C 0.0016 0.0004 0.0004 0.0004 0.0119
Q 0.0019 0.0025 0.0015 0.0016 0.0003 0.0073
E 0.0030 0.0027 0.0022 0.0049 0.0004 0.0035 0.0161
G 0.0058 0.0017 0.0029 0.0025 0.0008 0.0014 0.0019 0.0378
H 0.0011 0.0012 0.0014 0.0010 0.0002 0.0010 0.0014 0.0010 0.0093
I 0.0032 0.0012 0.0010 0.0012 0.0011 0.0009 0.0012 0.0014 0.0006 0.0184
L 0.0044 0.0024 0.0014 0.0015 0.0016 0.0016 0.0020 0.0021 0.0010 0.0114 0.0371
K 0.0033 0.0062 0.0024 0.0024 0.0005 0.0031 0.0041 0.0025 0.0012 0.0016 0.0025 0.0161
M 0.0013 0.0008 0.0005 0.0005 0.0004 0.0007 0.0007 0.0007 0.0004 0.0025 0.0049 0.0009 0.0040
F 0.0016 0.0009 0.0008 0.0008 0.0005 0.0005 0.0009 0.0012 0.0008 0.0030 0.0054 0.0009 0.0012 0.0183
P 0.0022 0.0010 0.0009 0.0012 0.0004 0.0008 0.0014 0.0014 0.0005 0.0010 0.0014 0.0016 0.0004 0.0005 0.0191
S 0.0063 0.0023 0.0031 0.0028 0.0010 0.0019 0.0030 0.0038 0.0011 0.0017 0.0024 0.0031 0.0009 0.0012 0.0017 0.0126
T 0.0037 0.0018 0.0022 0.0019 0.0009 0.0014 0.0020 0.0022 0.0007 0.0027 0.0033 0.0023 0.0010 0.0012 0.0014 0.0047 0.0125
W 0.0004 0.0003 0.0002 0.0002 0.0001 0.0002 0.0003 0.0004 0.0002 0.0004 0.0007 0.0003 0.0002 0.0008 0.0001 0.0003 0.0003 0.0065
Y 0.0013 0.0009 0.0007 0.0006 0.0003 0.0007 0.0009 0.0008 0.0015 0.0014 0.0022 0.0010 0.0006 0.0042 0.0005 0.0010 0.0009 0.0009 0.0102
V 0.0051 0.0016 0.0012 0.0013 0.0014 0.0012 0.0017 0.0018 0.0006 0.0120 0.0095 0.0019 0.0023 0.0026 0.0012 0.0024 0.0036 0.0004 0.0015 0.0196
"""

#: Exponent of the similarity kernel.
KERNEL_EXPONENT = 0.11387


def from_triangle(text: str) -> np.ndarray:
    """A symmetric matrix from lines of a residue and the values up to the diagonal."""
    out = np.zeros((len(RESIDUES), len(RESIDUES)))
    for i, line in enumerate(text.split("\n")[1:-1]):
        residue, *values = line.split()
        if residue != RESIDUES[i] or len(values) != i + 1:
            raise ValueError(f"line {i + 1} of the matrix")
        out[i, : i + 1] = out[: i + 1, i] = [float(v) for v in values]
    return out


def from_lines(lines: Iterable[str]) -> np.ndarray:
    """A full, possibly asymmetric matrix from a table whose header and first column name residues.

    For chain-specific matrices, which are parameters and not part of the library.
    """
    rows = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    names = rows[0] if len(rows[0]) == len(RESIDUES) else rows[0][1:]
    out = np.zeros((len(RESIDUES), len(RESIDUES)))
    for row in rows[1:]:
        for name, value in zip(names, row[1:], strict=True):
            out[RESIDUES.index(row[0]), RESIDUES.index(name)] = float(value)
    return out


@lru_cache
def blosum62() -> np.ndarray:
    return from_triangle(BLOSUM62)


def mismatch_distances(scores: np.ndarray, most: int = 4) -> np.ndarray:
    """0 for equal residues, else `most` less the score and at most `most`."""
    out = np.minimum(most, most - scores)
    np.fill_diagonal(out, 0)
    return out


@lru_cache
def kernel_k1() -> np.ndarray:
    """Odds of a residue pair against chance, to the power of KERNEL_EXPONENT; single precision as in published use."""
    q = from_triangle(PAIR_FREQUENCIES).astype(np.float32)
    marginal = q.sum(axis=1, dtype=np.float32)
    return np.power(q / np.outer(marginal, marginal), np.float32(KERNEL_EXPONENT))


_CODES = np.full(256, 255, np.uint8)
_CODES[np.frombuffer(RESIDUES.encode(), np.uint8)] = np.arange(len(RESIDUES), dtype=np.uint8)


def encode(sequences: Iterable[str], length: int) -> np.ndarray:
    """Equally long sequences as a matrix of residue numbers (255 for other letters)."""
    joined = "".join(sequences).encode("ascii", "replace")
    return _CODES[np.frombuffer(joined, np.uint8)].reshape(-1, length) if length else np.zeros((0, 0), np.uint8)
