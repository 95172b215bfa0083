"""Evaluation passages inside training text: a BM25 inverted index searched by block-max WAND."""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoforge.session import cut

WORD = re.compile(rb"[a-z0-9]+")
#: Words of a passage of the corpus, and how far the next begins: every `shared` words in a
#: row stand whole in some passage.
PASSAGE = 40
#: Words of one index term. Runs of three are rare enough that few passages keep a bound above
#: the threshold; single words and pairs of the common phrases would keep most.
GRAM = 3
#: Items of one index; more are searched block by block.
BLOCK_ITEMS = 20_000
#: Bytes of indexes that one scan of the texts searches; the blocks beyond take another scan.
SCAN_BYTES = 256_000_000
K1, B = 1.2, 0.75
_BLOCK = 16  # postings under one maximum
_WORD64 = (1 << 64) - 1


def words(text: str) -> list[bytes]:
    """Longest runs of ASCII letters and digits in lower case (bytes.lower leaves others alone)."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Index:
    """Items by their runs of GRAM words, with impacts and block maxima.

    A posting's impact is its BM25 weight divided by its item's threshold: the least BM25
    score that any `shared` words in a row of the item bring. A passage that holds such a
    row scores 1 or more against the item, so retrieval above 1 loses none.
    """

    def __init__(self, items: Sequence[tuple[object, str]], shared: int = 12):
        self.shared = shared
        self.gram = min(GRAM, shared)
        self.vocabulary: dict[bytes, int] = {}
        self.ids, texts = [], []
        for item, text in items:
            found = words(text or "")
            if len(found) >= shared:
                self.ids.append(item)
                texts.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found])
        self.width = len(self.vocabulary) + 1
        terms = [[self.term(t[i : i + self.gram]) for i in range(len(t) - self.gram + 1)] for t in texts]
        counts: list[dict[int, int]] = []
        frequency: dict[int, int] = {}
        for own in terms:
            counts.append(c := {})
            for p in own:
                c[p] = c.get(p, 0) + 1
            for p in c:
                frequency[p] = frequency.get(p, 0) + 1
        n, mean = len(texts), max(1.0, sum(map(len, terms)) / max(1, len(texts)))
        postings: dict[int, tuple[list[int], list[float]]] = {}
        self.rows: list[set[tuple[int, ...]]] = []
        for k, (text, own, c) in enumerate(zip(texts, terms, counts, strict=True)):
            weight = {p: math.log(1 + (n - frequency[p] + 0.5) / (frequency[p] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean)) for p, tf in c.items()}
            rows = range(len(text) - shared + 1)
            least = min(sum(weight[p] for p in set(own[i : i + shared - self.gram + 1])) for i in rows)
            self.rows.append({tuple(text[i : i + shared]) for i in rows})
            for p, w in weight.items():
                docs, impacts = postings.setdefault(p, ([], []))
                docs.append(k)
                impacts.append(w / least)
        self.terms = np.array(sorted(postings), np.uint64)
        self.lists = [postings[int(p)] for p in self.terms]
        self.blocks = [[max(x[i : i + _BLOCK]) for i in range(0, len(x), _BLOCK)] for _, x in self.lists]
        self.most = np.array([max(x) for _, x in self.lists], np.float64)

    def term(self, run: Sequence[int]) -> int:
        """The run as one number of 64 bits. Should two runs ever share one, they are one term on both sides, and no match is lost."""
        out = 0
        for w in run:
            out = (out * self.width + w) & _WORD64
        return out

    def wand(self, query: Sequence[int], threshold: float = 1.0 - 1e-9) -> list[int]:
        """All items scoring `threshold` or more for the distinct terms of a passage."""
        heads = [[self.lists[t][0][0], t, 0] for t in query]  # document, term, place in its list
        out = []
        while heads:
            heads.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(heads):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = heads[pivot][0]
            while pivot + 1 < len(heads) and heads[pivot + 1][0] == doc:
                pivot += 1
            block, nearest = 0.0, heads[pivot + 1][0] if pivot + 1 < len(heads) else len(self.ids)
            for _, t, place in heads[: pivot + 1]:
                docs = self.lists[t][0]
                at = bisect_left(docs, doc, place)
                if at < len(docs):
                    block += self.blocks[t][at // _BLOCK]
                    if (end := (at // _BLOCK + 1) * _BLOCK) < len(docs):
                        nearest = min(nearest, docs[end])
            if block < threshold:  # no item before `nearest` can reach it
                goal = max(nearest, doc + 1)
            elif heads[0][0] == doc:
                if sum(self.lists[t][1][place] for _, t, place in heads[: pivot + 1]) >= threshold:
                    out.append(doc)
                goal = doc + 1
            else:
                goal = doc
            moved = []
            for head in heads[: pivot + 1]:
                docs = self.lists[head[1]][0]
                head[2] = bisect_left(docs, goal, head[2])
                if head[2] < len(docs):
                    head[0] = docs[head[2]]
                    moved.append(head)
            heads = moved + heads[pivot + 1 :]
        return out

    def search(self, texts: Sequence[list[bytes]]) -> Iterator[tuple[int, object]]:
        """(place of the text, item) for each text, given as its words, and item that share `shared` words in a row."""
        if not self.ids:
            return
        look = self.vocabulary.get
        flat: list[int] = []
        starts = []
        for text in texts:
            starts.append(len(flat))
            flat += [look(w, 0) for w in text]
            flat.append(0)  # parts two texts
        ids = np.array(flat, np.uint64)
        if len(ids) < self.shared:
            return
        runs = len(ids) - self.gram + 1
        known = np.ones(runs, bool)
        for k in range(self.gram):
            known &= ids[k : runs + k] > 0
        known = np.flatnonzero(known)
        run = np.zeros(len(known), np.uint64)
        for k in range(self.gram):
            run = run * np.uint64(self.width) + ids[known + k]
        at = np.searchsorted(self.terms, run)
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == run
        place, term = known[hit], at[hit]
        # The first step of WAND for all passages at once: the sum of all maxima.
        total = np.zeros(len(ids) + 1)
        total[place + 1] = self.most[term]
        total = np.cumsum(total)
        step = PASSAGE - self.shared + 1
        begins = np.arange(0, len(ids), step)
        bound = total[np.minimum(begins + PASSAGE - self.gram + 1, len(ids))] - total[begins]
        done: set[tuple[int, int]] = set()
        starts = np.array(starts)
        for begin in begins[bound >= 1.0 - 1e-6].tolist():
            lo, hi = np.searchsorted(place, (begin, begin + PASSAGE - self.gram + 1))
            found = self.wand(np.unique(term[lo:hi]).tolist())
            if not found:
                continue
            passage = flat[begin : begin + PASSAGE]
            rows = [tuple(passage[i : i + self.shared]) for i in range(len(passage) - self.shared + 1)]
            for k in found:
                same = [begin + i for i, row in enumerate(rows) if row in self.rows[k]]
                done.update((text, k) for text in (np.searchsorted(starts, same, "right") - 1).tolist())
        for text, k in sorted(done):
            yield text, self.ids[k]


def indexes(items: DataFrame, item: str, passage: str, shared: int = 12, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(block, held): an index of about `block_items` items each, built in tasks and stored in the shared folder."""
    chosen = items.select(F.col(item).alias("item"), F.col(passage).alias("passage")).filter(F.col("passage").isNotNull())
    blocks = max(1, math.ceil(chosen.count() / block_items))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["item", "passage"], kind="stable")
        own = Index([(k, text) for k, text in zip(ordered["item"].tolist(), ordered["passage"], strict=True)], shared)
        return pd.DataFrame({"block": [int(group["block"].iat[0])], "held": [pickle.dumps(own)]})

    dealt = chosen.withColumn("block", F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)).cast("int"))
    return cut(dealt.groupBy("block").applyInPandas(build, "block int, held binary"))


def find_leaks(docs: DataFrame, items: DataFrame, doc: str, text: str, item: str, passage: str, shared: int = 12, block_items: int = BLOCK_ITEMS, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(doc, item): every pair in which `shared` words in a row of the passage also stand in the text.

    All passages of all whole texts are queries against the index. Null and blank texts and
    items shorter than `shared` words match nothing; items with equal passages are each
    reported; repeated rows of docs are reported each; other columns are not read; empty
    tables give no row.

    Indexes hold about `block_items` items each and are built in tasks. One scan of the texts
    searches as many of them as fit `scan_bytes`, which bounds what is broadcast; its words
    are read once for all of them. Further blocks take further scans, each stored before the
    next begins. No text is shuffled.
    """
    spark = docs.sparkSession
    built = indexes(items, item, passage, shared, block_items)
    scans: list[list[int]] = []
    room = 0
    for r in built.select("block", F.length("held").alias("n")).orderBy("block").toLocalIterator():
        if not scans or r.n > room:
            scans.append([])
            room = scan_bytes
        scans[-1].append(r.block)
        room -= r.n
    read = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    kind = items.schema[item].dataType
    schema = T.StructType([T.StructField(doc, docs.schema[doc].dataType), T.StructField(item if item != doc else f"_{item}", kind)])
    arrow_kind = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else None
    out = None
    for blocks in scans:
        shared_indexes = spark.sparkContext.broadcast([r.held for r in built.filter(F.col("block").isin(blocks)).orderBy("block").collect()])

        def run(batches: Iterator[pa.RecordBatch], held=shared_indexes) -> Iterator[pa.RecordBatch]:
            own = [pickle.loads(x) for x in held.value]
            for batch in batches:
                sizes = np.cumsum([len(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]) if batch.num_rows else []
                begin = 0
                while begin < batch.num_rows:  # about 4 MB of text at a time
                    past = sizes[begin - 1] if begin else 0
                    end = max(begin + 1, int(np.searchsorted(sizes, past + 4_000_000, "right")))
                    part = batch.slice(begin, end - begin)
                    texts = [words(x) for x in part.column(1).to_pylist()]
                    pairs = [pair for index in own for pair in index.search(texts)]
                    docs_found = part.column(0).take(pa.array([p for p, _ in pairs], pa.int32()))
                    yield pa.RecordBatch.from_arrays([docs_found, pa.array([i for _, i in pairs], arrow_kind)], names=schema.names)
                    begin = end

        found = read.mapInArrow(run, schema)
        if len(scans) > 1:
            found = cut(found)
            shared_indexes.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
