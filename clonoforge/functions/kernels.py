"""Numeric kernels on batches of sequences, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from clonoforge.functions.columns import RESIDUES
from clonoforge.functions.matrices import blosum62, encode, kernel_k1, mismatch_distances

GAP = 4
#: Residues at either end that a CDR3 distance leaves out.
N_TRIM, C_TRIM = 3, 2
FAR = 255
_N = len(RESIDUES)


def _rows_and_marks(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance rows of a's residues and indicator columns of b's, so that their product sums distances over positions."""
    table = np.full((_N + 1, _N), float(GAP), np.float32)
    table[:_N] = d
    rows = table[np.minimum(a, _N)].reshape(len(a), -1)
    marks = np.zeros((b.shape[1], _N, len(b)), np.float32)
    for p in range(b.shape[1]):
        known = b[:, p] < _N
        marks[p, b[known, p], np.flatnonzero(known)] = 1
    return rows, marks.reshape(-1, len(b))


def cdr3_distances(a: np.ndarray, b: np.ndarray, d: np.ndarray | None = None, gap: int = GAP) -> np.ndarray:
    """All distances between two sets of encoded CDR3s, each of one length, at most 255.

    Equal lengths: residue distances summed over the places between the trimmed ends.
    Unequal: one gap block in the longer, at the place that gives the least sum, plus `gap`
    per missing residue; places before it count from the start, those behind from the end.
    """
    d = mismatch_distances(blosum62(), GAP) if d is None else d
    if a.shape[1] > b.shape[1]:
        return cdr3_distances(b, a, d.T, gap).T
    s, length = a.shape[1], b.shape[1]
    fixed = (length - s) * gap
    if fixed >= FAR:
        return np.full((len(a), len(b)), FAR, np.int32)

    def part(i: int, j: int, shift: int) -> np.ndarray | float:
        if i >= j:
            return 0.0
        rows, marks = _rows_and_marks(a[:, i:j], b[:, i + shift : j + shift], d)
        return rows @ marks

    if s == length:
        total = part(N_TRIM, max(N_TRIM, s - C_TRIM), 0) + np.zeros((len(a), len(b)), np.float32)
        return np.minimum(np.rint(total), FAR).astype(np.int32)
    first, last = 5, s - 5
    while first > last:
        first, last = first - 1, last + 1
    best = None
    shift = length - s
    for place in range(first, last + 1):
        total = part(N_TRIM, place, 0) + part(place, s - C_TRIM, shift) + np.zeros((len(a), len(b)), np.float32)
        best = total if best is None else np.minimum(best, total)
    return np.minimum(np.rint(best) + fixed, FAR).astype(np.int32)


def cdr3_pair_distances(a: np.ndarray, b: np.ndarray, d: np.ndarray, gap: int = GAP) -> np.ndarray:
    """`cdr3_distances` of the k-th row of `a` with the k-th of `b`, each set of one length.

    For candidates that are few among all pairs. Sums up to each place of the gap block and
    behind it are kept as running sums.
    """
    if a.shape[1] > b.shape[1]:
        return cdr3_pair_distances(b, a, d.T, gap)
    s, shift = a.shape[1], b.shape[1] - a.shape[1]
    fixed = shift * gap
    if fixed >= FAR:
        return np.full(len(a), FAR, np.int32)
    table = np.zeros((_N + 1, _N + 1), np.int16)
    table[:_N, :_N], table[_N, :_N] = np.rint(d), GAP
    flat = table.ravel()
    one, two = np.minimum(a, _N).T.astype(np.int16) * (_N + 1), np.minimum(b, _N).T.astype(np.int16)
    at = lambda i, moved: flat[one[i] + two[i + moved]]
    total = np.zeros(len(a), np.int16)
    if not shift:
        for i in range(N_TRIM, s - C_TRIM):
            total += at(i, 0)
        return np.minimum(total, FAR).astype(np.int32)
    first, last = 5, s - 5
    while first > last:
        first, last = first - 1, last + 1
    for i in range(N_TRIM, first):
        total += at(i, 0)
    for i in range(first, s - C_TRIM):
        total += at(i, shift)
    best = total.copy()
    for place in range(first, last):
        if place >= N_TRIM:
            total += at(place, 0)
        if place < s - C_TRIM:
            total -= at(place, shift)
        np.minimum(best, total, out=best)
    return np.minimum(best + fixed, FAR).astype(np.int32)


def cdr3_distance(a: str, b: str) -> int:
    return int(cdr3_distances(encode([a], len(a)), encode([b], len(b)))[0, 0])


def germline_distance(a: str, b: str, d: np.ndarray | None = None, gap: int = GAP) -> int:
    """Place by place of two aligned loops; a residue against a gap (.) or nothing costs `gap`."""
    d = mismatch_distances(blosum62(), GAP) if d is None else d
    total = 0
    for k in range(max(len(a), len(b))):
        x, y = a[k : k + 1] or ".", b[k : k + 1] or "."
        if x == y == ".":
            continue
        known = x in RESIDUES and y in RESIDUES
        total += int(d[RESIDUES.index(x), RESIDUES.index(y)]) if known else gap
    return total


def k3_matrix(one: np.ndarray, many: np.ndarray, most: int = 30) -> np.ndarray:
    """The similarity kernel of one encoded sequence against many of one length.

    The sum over all pairs of equally long runs of the product of their residues' k1:
    with s(i, j) = k1(i, j) (1 + s(i-1, j-1)) it is the sum of all s. Runs are at most
    `most` long, which only both sequences beyond it feel.
    """
    k1 = kernel_k1().astype(np.float64)
    n, m = len(one), many.shape[1]
    total = np.zeros(len(many))
    if n > most and m > most:
        layer = k1[one][:, many].transpose(1, 0, 2)  # many, n, m
        run = layer.copy()
        for k in range(1, most + 1):
            total += run.sum(axis=(1, 2))
            if k < most:
                run = run[:, :-1, :-1] * layer[:, k:, k:]
        return total
    before = np.zeros((len(many), m))
    for residue in one:
        now = k1[residue][many]
        now[:, 1:] *= 1 + before[:, :-1]
        total += now.sum(axis=1)
        before = now
    return total


def k3_layers(codes: np.ndarray, most: int = 30) -> np.ndarray:
    """Per row, and per length 1 to `most` of the runs, that length's part of the kernel of the row with itself."""
    k1 = kernel_k1().astype(np.float64)
    n = codes.shape[1]
    out = np.zeros((len(codes), max(1, min(n, most))))
    for first in range(0, len(codes), 4096):
        own = codes[first : first + 4096]
        layer = k1[own[:, :, None], own[:, None, :]]
        run = layer
        for k in range(1, out.shape[1] + 1):
            out[first : first + 4096, k - 1] = run.sum(axis=(1, 2))
            if k < out.shape[1]:
                run = run[:, :-1, :-1] * layer[:, k:, k:]
    return out


def k3_pairs(some: np.ndarray, many: np.ndarray, most: int = 30, cells: int = 50_000) -> np.ndarray:
    """The similarity kernel of the k-th row of `some` with the k-th of `many`, each set of one length.

    Pairs lie along the last axis, `cells` numbers at a time, so that a slice stays in the cache.
    """
    n, m = some.shape[1], many.shape[1]
    if n > most and m > most:
        return np.array([k3_matrix(a, b[None, :], most)[0] for a, b in zip(some, many, strict=True)])
    k1 = kernel_k1().astype(np.float64).ravel()
    out = np.zeros(len(some))
    step = max(1, cells // max(1, m))
    for first in range(0, len(some), step):
        own = some[first : first + step].T.astype(np.intp) * _N
        other = np.ascontiguousarray(many[first : first + step].T.astype(np.intp))
        before, now, at = np.zeros(other.shape), np.empty(other.shape), np.empty(other.shape, np.intp)
        for i in range(n):
            np.add(other, own[i], out=at)
            np.take(k1, at, out=now, mode="clip")
            before += 1
            now[1:] *= before[:-1]
            out[first : first + step] += now.sum(axis=0)
            before, now = now, before
    return out


def global_scores(one: np.ndarray, many: np.ndarray, opening: int = 7, extending: int = 1) -> np.ndarray:
    """Global affine alignment scores of one encoded sequence against many of one length.

    A gap of n residues costs opening + (n - 1) * extending.
    """
    scores = np.zeros((_N + 1, _N + 1))
    scores[:_N, :_N] = blosum62()
    many = np.minimum(many, _N)
    n, m = len(one), many.shape[1]
    low = -1e9
    edge = -opening - extending * np.arange(m)
    h = np.concatenate([[0.0], edge])[None, :].repeat(len(many), 0)
    e = np.full((len(many), m + 1), low)  # ends in a gap in `many`
    for i in range(1, n + 1):
        e = np.maximum(h - opening, e - extending)
        new = np.empty_like(h)
        new[:, 0] = -opening - extending * (i - 1)
        e[:, 0] = low
        f = np.full(len(many), low)
        sub = scores[min(int(one[i - 1]), _N)][many]
        for j in range(1, m + 1):
            f = np.maximum(new[:, j - 1] - opening, f - extending)
            new[:, j] = np.maximum(np.maximum(h[:, j - 1] + sub[:, j - 1], e[:, j]), f)
        h = new
    return h[:, m]


def _alignment_table(extending: int) -> np.ndarray:
    """BLOSUM62 with two extensions added, 0 of unknown residues: scores of cells counted from `extending` * (i + j) below."""
    table = np.zeros((_N + 1, _N + 1), np.int16)
    table[:_N, :_N] = blosum62()
    return table + np.int16(2 * extending)


def paired_scores(one: np.ndarray, two: np.ndarray, opening: int = 7, extending: int = 1, cells: int = 50_000) -> np.ndarray:
    """`global_scores` of the k-th row of `one` against the k-th of `two`, each set of one length.

    A cell holds its score plus `extending` for each residue so far, so that a longer gap
    costs nothing more; pairs lie along the last axis, about `cells` numbers at a time.
    """
    if not 0 <= extending <= opening:
        return np.array([global_scores(a, b[None, :], opening, extending)[0] for a, b in zip(one, two, strict=True)], float)
    table, first_gap = _alignment_table(extending).ravel(), np.int16(opening - extending)
    n, m = one.shape[1], two.shape[1]
    out, step = np.empty(len(one)), max(1, cells // max(1, m))
    for first in range(0, len(one), step):
        own = np.minimum(one[first : first + step], _N).T.astype(np.intp) * (_N + 1)
        other = np.ascontiguousarray(np.minimum(two[first : first + step], _N).T.astype(np.intp))
        held = other.shape[1]
        h, new, at = np.full((m + 1, held), -first_gap, np.int16), np.full((m + 1, held), -first_gap, np.int16), np.empty(other.shape, np.intp)
        e, f, t = np.full((m, held), -10_000, np.int16), np.full((m, held), -2 * first_gap, np.int16), np.empty((m, held), np.int16)
        h[0] = 0
        for i in range(n):
            np.maximum(e, np.subtract(h[1:], first_gap, out=t), out=e)
            np.take(table, np.add(other, own[i], out=at), out=t, mode="clip")
            best = np.add(t, h[:-1], out=new[1:])
            np.maximum(best, e, out=best)
            np.subtract(best, first_gap, out=t)
            for j in range(1, m):
                np.maximum(f[j - 1], t[j - 1], out=f[j])
            np.maximum(best, f, out=best)
            h, new = new, h
            new[0] = -first_gap
        out[first : first + step] = h[m] - extending * (n + m)
    return out


def scores_against(ones: list[np.ndarray], many: np.ndarray, opening: int = 7, extending: int = 1) -> np.ndarray:
    """`global_scores` of each of some encoded sequences against many of one length, as in `paired_scores`.

    The cells of a common beginning are kept from one sequence to the next, so ordered ones cost less.
    """
    if not 0 <= extending <= opening:
        return np.array([global_scores(one, many, opening, extending) for one in ones], np.int16)
    first_gap = np.int16(opening - extending)
    m, held, longest = many.shape[1], len(many), max(map(len, ones), default=0)
    profile = _alignment_table(extending)[:, np.minimum(many, _N).T]
    h, e = np.full((longest + 1, m + 1, held), -first_gap, np.int16), np.full((longest + 1, m, held), -10_000, np.int16)
    h[0, 0] = 0
    f, t = np.full((m, held), -2 * first_gap, np.int16), np.empty((m, held), np.int16)
    out, before = np.empty((len(ones), held), np.int16), np.zeros(0, np.intp)
    for k, one in enumerate(np.minimum(x, _N).astype(np.intp) for x in ones):
        shared = min(len(one), len(before))
        same = int(np.argmin(np.append(one[:shared] == before[:shared], False)))
        for i in range(same, len(one)):
            np.maximum(e[i], np.subtract(h[i, 1:], first_gap, out=t), out=e[i + 1])
            best = np.add(h[i, :-1], profile[one[i]], out=h[i + 1, 1:])
            np.maximum(best, e[i + 1], out=best)
            np.subtract(best, first_gap, out=t)
            for j in range(1, m):
                np.maximum(f[j - 1], t[j - 1], out=f[j])
            np.maximum(best, f, out=best)
        out[k], before = h[len(one), m] - extending * (len(one) + m), one
    return out


# --- deterministic random numbers ------------------------------------------------

_MULTIPLIER = 6364136223846793005
_MASK = (1 << 64) - 1


def seed_of(text: str) -> int:
    """FNV-1a of the text's bytes, never 0."""
    value = 0xCBF29CE484222325
    for byte in text.encode():
        value = (value ^ byte) * 0x100000001B3 & _MASK
    return max(value, 1)


#: States of which a process keeps the factors, 16 bytes each.
KEPT_STATES = 1 << 20


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What n states are made of besides the seed: powers of the multiplier, and the sums of those before."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n, _MULTIPLIER, np.uint64), dtype=np.uint64)
        return powers, np.cumsum(np.concatenate([np.ones(1, np.uint64), powers[:-1]]) if n else powers, dtype=np.uint64)


_kept_factors = lru_cache(maxsize=1)(_factors)


def states(seed: int, n: int) -> np.ndarray:
    """The n next states of x -> x * multiplier + 1 modulo 2**64."""
    powers, sums = _kept_factors(KEPT_STATES) if n <= KEPT_STATES else _factors(n)
    with np.errstate(over="ignore"):
        return powers[:n] * np.uint64(seed) + sums[:n]


def bounded(state: np.ndarray, n: int) -> np.ndarray:
    """High half of state * n: a number below n (n under 2**32)."""
    hi, lo = state >> np.uint64(32), state & np.uint64(0xFFFFFFFF)
    k = np.uint64(n)
    return ((hi * k + (lo * k >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def sample_weights(state: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Indices drawn in proportion to weights, one per state."""
    usable = np.where(np.isfinite(weights) & (weights > 0), weights, 0.0)
    total = np.cumsum(usable)
    if not len(total):
        return np.zeros(len(state), np.int64)
    if total[-1] <= 0:
        return bounded(state, len(total))
    target = (state >> np.uint64(11)).astype(np.float64) / float(1 << 53) * total[-1]
    return np.minimum(np.searchsorted(total, target, "left"), len(total) - 1)
