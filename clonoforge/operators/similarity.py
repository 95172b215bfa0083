"""Similarity search of receptor sequences in an annotated database."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoforge.functions.columns import is_residues, trim_flanks
from clonoforge.functions.kernels import k3_layers, k3_pairs
from clonoforge.functions.matrices import encode, kernel_k1
from clonoforge.session import cut, spread

THRESHOLD = 0.97
#: Database sequences that are broadcast at once.
BLOCK = 50_000


def usable(df: DataFrame, column: str, trimmed: bool = True, strict: bool = False) -> DataFrame:
    """df with `sequence`: upper case, trimmed flanks, residues only; other rows fall out or, if strict, are an error."""
    text = F.upper(F.trim(column))
    text = trim_flanks(text) if trimmed else text
    out = df.withColumn("sequence", text).filter(F.col("sequence").isNotNull() & (F.col("sequence") != ""))
    if strict:
        return out.filter(F.when(is_residues("sequence"), True).otherwise(F.raise_error(F.concat(F.lit("no residue sequence: "), F.col("sequence"))).cast("boolean")))
    return out.filter(is_residues("sequence"))


#: Directions kept of the residues' space for each residue of runs of each length; of longer runs those in which at most one residue leaves the first direction.
DIRECTIONS = {1: 20, 2: 10, 3: 5}
#: Directions that profiles keep of the products of runs, and sequences they are fitted to.
KEPT, FITTED = 96, 2_000


@lru_cache
def _directions() -> np.ndarray:
    """Residues as vectors whose products are k1, the most important directions first."""
    values, vectors = np.linalg.eigh(kernel_k1().astype(float))
    if values.min() < 0:
        raise ValueError("the residue kernel is no inner product")
    return (vectors * np.sqrt(values))[:, ::-1]


def _bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and features of encoded sequences of one length; products of features are no less than scores.

    The kernel is a sum over run lengths k of kernels, each an inner product in the k-fold product of
    the residues' space. Of each only a part is kept; what two sequences have in the rest is by
    Cauchy and Schwarz at most the product of its lengths. The first direction holds most of
    a run, so of long runs the products with one residue in another direction are kept.
    """
    layers = k3_layers(codes)
    norms = np.sqrt(layers.sum(axis=1))
    own, parts = _directions()[codes], []
    turned = own[:, :, 1:] / own[:, :, :1]
    for k in range(1, layers.shape[1] + 1):
        m = codes.shape[1] - k + 1
        if k in DIRECTIONS:
            some = own[:, :, : DIRECTIONS[k]]
            runs = some
            for j in range(1, k):
                runs = (runs[:, :-1, :, None] * some[:, j:, None, :]).reshape(len(codes), codes.shape[1] - j, -1)
            kept = runs.sum(axis=1)
        else:
            first = np.prod([own[:, j : j + m, 0] for j in range(k)], axis=0)
            kept = np.hstack([first.sum(axis=1)[:, None], *[(first[:, None, :] @ turned[:, p : p + m])[:, 0] for p in range(k)]])
        rest = np.sqrt(np.maximum(layers[:, k - 1] - (kept**2).sum(axis=1), 0))
        parts += [kept, rest[:, None]]
    return norms, (np.hstack(parts) / norms[:, None]).astype(np.float32)


def _lengths(sequences: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and codes of the sequences of each length, at most 1024 at a time."""
    lengths = np.array([len(s) for s in sequences])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for begin in range(0, len(at), 1024):
            some = at[begin : begin + 1024]
            yield some, encode([sequences[i] for i in some], int(n))


def _basis(sequences: list[str]) -> np.ndarray:
    """The directions in which the features of some sequences lie for the most part, as columns."""
    held = [_bounds(codes)[1] for _, codes in _lengths(sequences)]
    width = max((f.shape[1] for f in held), default=1)
    features = np.concatenate([np.zeros((0, width), np.float32), *[np.pad(f, ((0, 0), (0, width - f.shape[1]))) for f in held]])
    values, vectors = np.linalg.eigh((features @ features.T).astype(float))
    largest = [i for i in np.argsort(-values)[:KEPT] if values[i] > 1e-6]
    return np.linalg.qr(features.T.astype(float) @ (vectors[:, largest] / np.sqrt(values[largest])))[0].astype(np.float32)


def _profiles(sequences: list[str], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the features along the basis with the length of what lies beside it: products still bound scores."""
    norms, out = np.zeros(len(sequences)), np.zeros((len(sequences), basis.shape[1] + 1), np.float32)
    for at, codes in _lengths(sequences):
        norms[at], features = _bounds(codes)
        width = min(features.shape[1], len(basis))
        along = features[:, :width] @ basis[:width]
        out[at, :-1], out[at, -1] = along, np.sqrt(np.maximum((features.astype(float) ** 2).sum(axis=1) - (along.astype(float) ** 2).sum(axis=1), 0) + 1e-6)
    return norms, out


def _profiled(df: DataFrame, basis: Broadcast) -> DataFrame:
    """df with the norm and profile of each sequence."""
    schema = T.StructType([*df.schema, T.StructField("norm", T.DoubleType()), T.StructField("profile", T.BinaryType())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            norms, profiles = _profiles(batch.column("sequence").to_pylist(), basis.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms, pa.float64()), pa.array([x.tobytes() for x in profiles], pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


#: Leading directions of the profiles whose bound sorts out most pairs, and rows and columns of the matrices that are bounded at once.
HEAD, TILE = 40, (512, 1024)
#: Pairs that are compared exactly at once.
COMPARED = 200_000


class Side:
    """Sequences with their norms, profiles and codes."""

    def __init__(self, names: list[str], norms: np.ndarray, profiles: np.ndarray):
        self.names, self.norms, self.profiles = np.array(names, object), norms, profiles
        self.lengths = np.array([len(s) for s in names], int)
        longest = int(self.lengths.max(initial=1))
        self.codes = encode([s.ljust(longest, ".") for s in names], longest)

    def take(self, at: np.ndarray) -> Side:
        """The sequences at some places."""
        out = object.__new__(Side)
        out.names, out.norms, out.profiles, out.lengths, out.codes = self.names[at], self.norms[at], self.profiles[at], self.lengths[at], self.codes[at]
        return out

    def _heads(self, order: np.ndarray) -> np.ndarray:
        """The profiles' leading directions with the length of the others: their products bound the profiles' products."""
        head, tail = self.profiles[order, :HEAD], self.profiles[order, HEAD:]
        return np.hstack([head, np.sqrt((tail.astype(float) ** 2).sum(axis=1))[:, None]]).astype(np.float32)

    @cached_property
    def _tiles(self) -> tuple[int, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The direction in which the profiles differ most, the order along it and the places there, and of tiles in that order the heads as columns and the other directions."""
        along = int(self.profiles.var(axis=0).argmax())
        order = np.argsort(self.profiles[:, along], kind="stable")
        heads, tails = [], []
        for first in range(0, len(order), TILE[1]):
            some = order[first : first + TILE[1]]
            held = np.zeros((min(HEAD, self.profiles.shape[1]) + 1, TILE[1]), np.float32)
            held[:, : len(some)] = self._heads(some).T
            heads.append(held)
            tails.append(np.ascontiguousarray(self.profiles[some, HEAD:]))
        return along, order, self.profiles[order, along].astype(float), heads, tails

    def _bounded(self, other: Side, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs whose profiles' product is above `least`.

        The product is half of the squared lengths less half of the squared distance, so only tiles
        near enough in one direction are bounded: first by their heads, then what is left by all directions.
        """
        along, order, places, heads, tails = other._tiles
        square = lambda x: float((x.profiles.astype(float) ** 2).sum(axis=1).max(initial=0))
        reach = np.sqrt(max(0.0, square(self) + square(other) - 2 * least)) + 1e-6
        mine = np.argsort(self.profiles[:, along], kind="stable")
        product, above = np.empty(TILE, np.float32), np.empty(TILE, bool)
        words = above.reshape(-1).view(np.uint64)
        for first in range(0, len(mine), TILE[0]):
            own = mine[first : first + TILE[0]]
            head, tail, n = self._heads(own), np.ascontiguousarray(self.profiles[own, HEAD:]), len(own)
            ends = self.profiles[own[[0, -1]], along].astype(float) + (-reach, reach)
            begin, end = np.searchsorted(places, ends[0], "left"), np.searchsorted(places, ends[1], "right")
            for k in range(begin // TILE[1], -(-end // TILE[1])):
                np.matmul(head, heads[k], out=product[:n])
                np.greater(product[:n], np.float32(least), out=above[:n])
                some = np.flatnonzero(words[: n * TILE[1] // 8])
                if not len(some):
                    continue
                at = np.flatnonzero(above.reshape(-1, 8)[some].ravel())
                x, y = np.divmod(some[at >> 3] * 8 + (at & 7), TILE[1])
                if len(tails[k]) < TILE[1]:
                    x, y = x[y < len(tails[k])], y[y < len(tails[k])]
                if tail.shape[1]:
                    left = np.einsum("ij,ij->i", head[x, :HEAD], heads[k].T[y, :HEAD]) + np.einsum("ij,ij->i", tail[x], tails[k][y]) > least
                    x, y = x[left], y[left]
                yield own[x], order[y + k * TILE[1]]

    def matches(self, other: Side, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(own places, other's places, scores) above the threshold.

        Only pairs whose bound is above the threshold are compared, many at once.
        """
        if not len(self.names) or not len(other.names):
            return
        held, n = [], 0
        for x, y in self._bounded(other, threshold - 1e-4):  # single precision
            held.append((x, y))
            n += len(x)
            if n >= COMPARED:
                yield from self._compared(other, held, threshold)
                held, n = [], 0
        if n:
            yield from self._compared(other, held, threshold)

    def _compared(self, other: Side, held: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        x, y = (np.concatenate(some) for some in zip(*held, strict=True))
        shape = self.lengths[x] * (1 + other.lengths.max(initial=0)) + other.lengths[y]
        order = np.argsort(shape, kind="stable")
        ends = np.flatnonzero(np.diff(shape[order], append=-1)) + 1
        for begin, end in zip(np.concatenate([[0], ends[:-1]]).astype(int), ends, strict=len(ends) > 0):
            i, j = x[order[begin:end]], y[order[begin:end]]
            score = k3_pairs(self.codes[i, : self.lengths[i[0]]], other.codes[j, : other.lengths[j[0]]]) / (self.norms[i] * other.norms[j])
            above = score > threshold
            yield i[above], j[above], score[above]


def _side(t: pa.Table) -> Side:
    return Side(t.column("sequence").to_pylist(), t.column("norm").to_numpy(), np.frombuffer(b"".join(t.column("profile").to_pylist()), np.float32).reshape(t.num_rows, -1))


def similar_pairs(inputs: DataFrame, database: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(sequence, match, score): distinct input and database sequences scoring above the threshold.

    score = k3(a, b) / sqrt(k3(a, a) k3(b, b)), strictly above the threshold. Each sequence of either
    side (column sequence) is profiled once; the directions of the profiles are
    fitted to some of the database, which no score depends on. The database goes to the
    workers in blocks of about `block` sequences, one scan of the inputs each; the
    inputs stay where they are. Two sequences of both sides in different blocks meet once, when the later
    block goes round, and match both ways. In a task most pairs fall to a bound of their score (`Side`)
    and only the rest are compared; only matches leave it.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    spark = inputs.sparkSession
    sides = inputs.select("sequence", F.lit(True).alias("own"), F.lit(False).alias("base")).unionByName(database.select("sequence", F.lit(False).alias("own"), F.lit(True).alias("base")))
    distinct = cut(sides.groupBy("sequence").agg(F.max("own").alias("own"), F.max("base").alias("base")))
    bases = distinct.filter("base")
    basis = spark.sparkContext.broadcast(_basis([r.sequence for r in bases.select("sequence").orderBy(F.xxhash64("sequence"), "sequence").limit(FITTED).collect()]))
    blocks = max(1, -(-bases.count() // block))
    # Stored in even parts, so that no block's scan moves them again.
    stored = cut(_profiled(spread(distinct.withColumn("part", F.pmod(F.xxhash64("sequence"), F.lit(blocks)).cast("int"))), basis))
    schema = T.StructType([T.StructField("sequence", T.StringType()), T.StructField("match", T.StringType()), T.StructField("score", T.DoubleType())])
    out = None
    for k in range(blocks):
        members = stored.filter(F.col("base") & (F.col("part") == k)).select("sequence", "own", "norm", "profile").toArrow()
        shared = spark.sparkContext.broadcast(members)
        # Those of both sides in later blocks meet members of both sides then.
        later = F.col("base") & (F.col("part") > k)
        lone = members.num_rows - pc.sum(members.column("own"), min_count=0).as_py()

        def run(frames: Iterator[pa.RecordBatch], held=shared, k=k) -> Iterator[pa.RecordBatch]:
            other = _side(held.value)
            both = held.value.column("own").to_numpy()
            alone = other.take(np.flatnonzero(~both))
            rows = lambda a, b, score: pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(score, pa.float64())], names=schema.names)
            for batch in frames:
                own = _side(pa.Table.from_batches([batch]))
                base, part = batch.column("base").to_numpy(zero_copy_only=False), batch.column("part").to_numpy()
                earlier = own.take(np.flatnonzero(base & (part < k)))
                for i, j, score in earlier.matches(other, threshold):
                    yield rows(earlier.names[i], other.names[j], score)
                    back = both[j]
                    yield rows(other.names[j[back]], earlier.names[i[back]], score[back])
                for some, against in ((own.take(np.flatnonzero(~base | (part == k))), other), (own.take(np.flatnonzero(base & (part > k))), alone)):
                    for i, j, score in some.matches(against, threshold):
                        yield rows(some.names[i], against.names[j], score)

        found = stored.filter(F.col("own") if lone else F.col("own") & ~later).mapInArrow(run, schema)
        if blocks > 1:
            found = cut(found)
            shared.destroy()  # its file too
        out = found if out is None else out.unionByName(found)
    return out


ANNOTATIONS = ("receptor_group", "epitope", "antigen", "organism")


def annotate(inputs: DataFrame, pairs: DataFrame, database: DataFrame, dedupe_database: bool = False) -> DataFrame:
    """(input_sequence, match_sequence, score, annotations): every input row with every annotation of its matches.

    A sequence listed k times in the database gives k * k rows, since each listing matches
    and each match carries all annotations; once each with dedupe_database.
    """
    listed = database.groupBy("sequence").agg(F.count(F.lit(1)).alias("times"))
    rows = inputs.join(pairs, "sequence").select(F.col("sequence").alias("input_sequence"), F.col("match").alias("sequence"), "score")
    if not dedupe_database:
        rows = rows.join(listed, "sequence").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_k", "times")
    noted = rows.join(database.select("sequence", *ANNOTATIONS), "sequence")
    return noted.select("input_sequence", F.col("sequence").alias("match_sequence"), "score", *ANNOTATIONS)


def written_score(score: str = "score"):
    """Six decimals, as in the text output."""
    return F.format_string("%.6f", F.col(score))
