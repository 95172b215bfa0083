"""Filling fixed-capacity containers with token-counted texts by minimum bin slack."""

from __future__ import annotations

import base64
import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoforge.session import cut

#: Where the vocabulary file lies, unless the session's setting clonoforge.vocabulary or the caller names another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Kinds of containers at most. Each takes all items once, so they are few by what they are.
MOST_TARGETS = 10_000
#: How the public byte-level vocabulary parts a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items packed together in one task; a shard wastes room in its last containers only.
SHARD_ITEMS = 16_384


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, keep: Sequence[str], vocabulary: str | None = None, pattern: str = PIECES) -> DataFrame:
    """(keep..., n_tokens): the tokens of the whole text; 0 for null and empty texts.

    Special-token strings in a text are ordinary text. Only keep and the text are read, no
    shuffle; each worker loads the vocabulary file once.
    """
    vocabulary = vocabulary or df.sparkSession.conf.get("clonoforge.vocabulary", VOCABULARY)
    target = "n_tokens"
    while target in keep:
        target = f"_{target}"
    read = df.select(*keep, F.col(text).alias("_text" if "_text" not in keep else "__text"))
    schema = T.StructType([*(read.schema[c] for c in keep), T.StructField(target, T.LongType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            counts = [len(encode(x.as_py())) if x.is_valid else 0 for x in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts, pa.int64())], names=schema.names)

    return read.mapInArrow(run, schema)


def fullest(room: int, lengths: Sequence[int], held: dict[int, list]) -> list[int]:
    """Lengths, with repeats, whose sum is the largest that fits `room`.

    Bit s of a whole number says that s can be reached; each further copy of a length
    shifts and joins it. Lengths are ascending and are taken from the longest that fits,
    so that short ones stay for later containers; it ends as soon as the room can be filled.
    """
    mask = (1 << (room + 1)) - 1
    bits, steps = 1, []
    for k in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        length = lengths[k]
        for _ in range(min(len(held[length]), room // length)):
            more = bits | (bits << length) & mask
            if more == bits:
                break
            steps.append((length, bits))
            bits = more
        if bits >> room & 1:
            break
    left, out = bits.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            out.append(length)
            left -= length
    return out


def pack_shard(lengths: Sequence[int], capacity: int) -> list[int]:
    """The container number of each item: minimum bin slack, the longest item left opening each container."""
    held: dict[int, list[int]] = {}
    for k, length in enumerate(lengths):
        if not 0 < length <= capacity:
            raise ValueError(f"item of length {length} for a capacity of {capacity}")
        held.setdefault(length, []).append(k)
    order = sorted(held)
    out, number = [0] * len(lengths), 0
    while order:
        longest = order[-1]
        first = held[longest].pop()
        if not held[longest]:
            order.pop()
        out[first] = number
        for length in fullest(capacity - longest, order, held) if capacity > longest and order else ():
            out[held[length].pop()] = number
            if not held[length]:
                del order[bisect_left(order, length)]
        number += 1
    return out


def pack(sizes: DataFrame, targets: DataFrame, item: str, size: str, target: str, capacity: str, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(target, container_id, item, piece, start, length): every item in containers of every capacity.

    An item longer than the capacity is split into full pieces and a rest, any other stays
    whole. Items of no length (and of null or negative size) need no room: one row with
    piece 0, length 0 and a null container. Repeated items are packed each; targets without
    a positive capacity give no row; empty tables give no row; targets are few (a fixed
    table of capacities), items may be any number.

    Items are dealt to shards of about `shard_items`, so that each task packs a bounded
    group, whatever the table's size; all of one capacity share one numbering:
    container_id = shard * 2**32 + number. Pieces that fill a container are numbered in shards
    of their own and never packed, so one giant item burdens no task. Only identifiers and
    lengths are moved. The capacities (MOST_TARGETS at most, more are an error) become part
    of the plan.
    """
    few = targets.select(F.col(target).alias("target"), F.col(capacity).cast("bigint").alias("capacity")).filter(F.col("capacity") > 0).distinct().orderBy("target", "capacity").limit(MOST_TARGETS + 1).collect()
    if len(few) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} kinds of containers")
    target_kind = targets.schema[target].dataType
    sized = cut(sizes.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("_row")))
    held = sized.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.floor(F.col("size") / r.capacity)).alias(f"full_{k}") for k, r in enumerate(few)]).first()
    shards = max(1, math.ceil(held.n / shard_items))
    kinds = F.array(*[F.struct(F.lit(r.target).cast(target_kind).alias("target"), F.lit(r.capacity).alias("capacity"), F.lit(max(1, math.ceil((held[f"full_{k}"] or 0) / shard_items))).alias("full_shards")) for k, r in enumerate(few)])
    names = {"target": target, "item": item}
    item_kind = dict(sized.dtypes)["item"]
    schema = f"target {target_kind.simpleString()}, container_id bigint, item {item_kind}, piece int, start bigint, length bigint"
    if not few:
        return sizes.sparkSession.createDataFrame([], schema).withColumnsRenamed(names)
    every = sized.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")).select("item", "size", "_row", "_shard", F.inline(kinds))
    full = F.floor(F.col("size") / F.col("capacity")).cast("int")
    rest = every.select("target", "capacity", "_shard", "item", full.alias("piece"), (full * F.col("capacity")).alias("start"), (F.col("size") - full * F.col("capacity")).alias("length"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "item", "piece"], kind="stable", ignore_index=True)
        numbers = pack_shard(group["length"].tolist(), int(group["capacity"].iat[0]))
        base = int(group["_shard"].iat[0]) << 32
        return pd.DataFrame({"target": group["target"], "container_id": [base + k for k in numbers], "item": group["item"], "piece": group["piece"], "start": group["start"], "length": group["length"]})

    packed = rest.filter("length > 0").groupBy("target", "_shard").applyInPandas(run, schema)
    filled = every.filter(full > 0).select("target", "capacity", "full_shards", "item", "_row", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    filled = filled.withColumn("_shard", F.lit(shards) + F.pmod(F.xxhash64("_row", "piece"), F.col("full_shards")).cast("int"))
    number = F.row_number().over(Window.partitionBy("target", "_shard").orderBy("_row", "piece")) - 1
    filled = filled.select("target", (F.shiftleft(F.col("_shard").cast("bigint"), 32) + number).alias("container_id"), "item", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("length"))
    nothing = every.filter("size = 0").select("target", F.lit(None).cast("bigint").alias("container_id"), "item", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"))
    return packed.unionByName(filled).unionByName(nothing).withColumnsRenamed(names)


def fill(packed: DataFrame, targets: DataFrame, target: str, capacity: str) -> DataFrame:
    """Per target: containers, tokens, and the share of all room that is used."""
    room = targets.select(target, F.col(capacity).alias("capacity"))
    per_container = packed.filter(F.col("container_id").isNotNull()).groupBy(target, "container_id").agg(F.sum("length").alias("held"))
    used = per_container.groupBy(target).agg(F.count(F.lit(1)).alias("n_containers"), F.sum("held").alias("n_tokens"))
    return used.join(room, target).withColumn("used_share", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
