"""Problem 9: evaluation texts, or passages of them, inside documents.

Method: SimHash of every window of RUN words, the shortest passage that counts, of documents and items; windows within
RADIUS bits share one of BLOCKS blocks of their fingerprints and are joined on those. Where two windows meet, the
document's item-sized window at that place is laid beside the item: the two are alike by the weight of their shared
shingles, of which one that stands in many items weighs little. A leak is an item-sized window that is alike (SIMILAR)
or a shared run of at least RUN consecutive words.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.llm.near import _Ids, _mix, words_of
from moorline.session import table, written

RUN, RADIUS = 15, 3
BLOCKS = RADIUS + 1  # of 16 bits
#: Weighted similarity of five-word shingles from which an item-sized window is a leak without a run of RUN words.
SIMILAR, SHINGLE = 0.8, 5
#: Words of items in one block of the query set; 8 bytes a word and 32 a window are broadcast, one block at a time.
ITEM_WORDS = 1_000_000
_and = re.compile(r"(?<!\S)&(?!\S)")
_tags = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")


def plain_words(text: str) -> list[str]:
    """Words of a text without markup: character references are read, a lone & is the word and, tags are dropped."""
    if "&" in text:
        text = _and.sub(" and ", html.unescape(text))
    if "<" in text:
        text = _tags.sub(" ", text)
    return words_of(text)


def simhashes(ids: np.ndarray, run: int = RUN) -> np.ndarray:
    """SimHash of each window of `run` words; len(ids) - run + 1 of them. run is odd and below 128."""
    if len(ids) < run:
        return np.zeros(0, np.uint64)
    h = _mix(_mix(ids + np.uint64(0x1F3D5B79)))
    signs = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)
    total = np.zeros((len(ids) + 1, 64), np.int8)
    np.cumsum(signs, axis=0, dtype=np.int8, out=total[1:])  # may wrap; differences over a window don't
    return np.packbits((total[run:] - total[:-run]) > 0, axis=1).view(np.uint64).ravel()


def shingles(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of every `size` consecutive words; of all words where there are fewer."""
    size = min(size, len(ids))
    h = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        h = _mix(h * np.uint64(31) + ids[k : k + len(h)] + np.uint64(1))
    return h


class Index:
    """Windows of the items by each block of their fingerprints, and the weights of the items' shingles."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.items = dict(items)
        self.words = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        ends = np.cumsum([len(w) for _, w in items])
        at, of, first, prints, every = [], [], [], [], []
        for (item, w), end in zip(items, ends, strict=True):
            p = simhashes(w)
            prints.append(p)
            at.append(np.arange(len(p)) + end - len(w))
            first.append(np.full(len(p), end - len(w), np.int64))
            of.append(np.full(len(p), item, np.int64))
            every.append(np.unique(shingles(w)))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.at, self.item, self.first, self.prints = cat(at, np.int64), cat(of, np.int64), cat(first, np.int64), cat(prints, np.uint64)
        self.shingle, self.held = np.unique(cat(every, np.uint64), return_counts=True)
        self.order, self.starts = [], []
        for b in range(BLOCKS):
            v = ((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            o = np.argsort(v, kind="stable")
            self.order.append(o)
            self.starts.append(np.searchsorted(v[o], np.arange(65537)))

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """A shingle of k items weighs 1 / k; of none, 1."""
        if not len(self.shingle):
            return np.ones(len(hashes))
        at = np.minimum(np.searchsorted(self.shingle, hashes), len(self.shingle) - 1)
        return np.where(self.shingle[at] == hashes, 1.0 / self.held[at], 1.0)

    def alike(self, item: int, window: np.ndarray) -> float:
        """Weighted share of common shingles (Jaccard) of an item and a window."""
        a, b = np.unique(shingles(self.items[item])), np.unique(shingles(window))
        both, either = np.intersect1d(a, b), np.union1d(a, b)
        return float(self.weights(both).sum() / max(self.weights(either).sum(), 1e-9))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) of all pairs within RADIUS bits."""
        left, right = [], []
        for b in range(BLOCKS):
            v = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            lo, n = self.starts[b][v], self.starts[b][v + 1] - self.starts[b][v]
            some = np.flatnonzero(n)
            n = n[some]
            i = np.repeat(some, n)
            j = self.order[b][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[some], n)]
            ok = np.bitwise_count(prints[i] ^ self.prints[j]) <= RADIUS
            left.append(i[ok])
            right.append(j[ok])
        return np.concatenate(left), np.concatenate(right)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, words, alike: the documents and items that share a run of at least RUN words or an item-sized window of which SIMILAR is alike.

    words: the document's words in shared runs of RUN (0: none), alike: the best weighted similarity found. Items are
    the query set: they are read in blocks of at most ITEM_WORDS words, so what is broadcast is bounded, and with more
    than one block each block's finds are written before the next is sent. Null texts and those below RUN words have no
    row. A document that repeats an item many times has one row for it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_id = _Ids()
        for batch in batches:
            w = [[word_id[x] for x in plain_words(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.list_(pa.int64()))], names=["i", "w"])

    words = items.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t")).mapInArrow(read, "i bigint, w array<bigint>").filter(F.size("w") >= RUN)
    block: list[tuple[int, np.ndarray]] = []
    out, size = [], 0
    for row in words.toLocalIterator():
        if size + len(row.w) > ITEM_WORDS and block:
            out.append(written(_against(docs, block, key, text, item), "leaks"))
            block, size = [], 0
        block.append((row.i, np.array(row.w, np.uint64)))
        size += len(row.w)
    last = _against(docs, block, key, text, item)
    if not out:
        return last
    for found in out:
        last = last.unionByName(found)
    return last.groupBy(key, item).agg(F.max("words").alias("words"), F.max("alike").alias("alike"))


def _against(docs: DataFrame, items: list[tuple[int, np.ndarray]], key: str, text: str, item: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([(key, pa.int64()), (item, pa.int64()), ("words", pa.int64()), ("alike", pa.float64())])

    def search(index: Index, ids: list[int], words: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, float]]:
        flat = np.concatenate(words)
        lens = np.array([len(w) for w in words])
        ends = np.cumsum(lens)
        doc = np.repeat(np.arange(len(lens)), lens)
        prints = simhashes(flat)
        whole = np.flatnonzero(doc[: len(prints)] == doc[RUN - 1 :])
        i, j = index.near(prints[whole])
        i = whole[i]
        runs: dict[tuple[int, int], set[int]] = {}
        places: dict[tuple[int, int], set[int]] = {}
        step = np.arange(RUN)
        for lo in range(0, len(i), 100_000):
            a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
            same = (flat[a[:, None] + step] == index.words[index.at[b][:, None] + step]).all(1)
            for x, y in zip(a[same].tolist(), b[same].tolist(), strict=True):
                runs.setdefault((doc[x], int(index.item[y])), set()).update(range(x, x + RUN))
            start = a - (index.at[b] - index.first[b])  # where the item would begin in the document
            for d, y, s in {*zip(doc[a].tolist(), index.item[b].tolist(), start.tolist(), strict=True)}:
                places.setdefault((d, y), set()).add(s)
        found = {}
        for (d, y), at in places.items():
            size = len(index.items[y])
            lo, hi = ends[d] - lens[d], ends[d]
            alike = max(index.alike(y, flat[max(lo, s) : min(hi, s + size)]) for s in at)
            run = len(runs.get((d, y), ()))
            if run or alike >= SIMILAR:
                old = found.get((ids[d], y), (0, 0.0))
                found[ids[d], y] = (max(old[0], run), max(old[1], alike))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, word_id = Index(shared.value), _Ids()
        for batch in batches:
            ids, words, size = [], [], 0
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for n, (i, x) in enumerate(rows, 1):
                w = [word_id[y] for y in plain_words(x)] if x else []
                if len(w) >= RUN:
                    ids.append(i)
                    words.append(np.array(w, np.uint64))
                    size += len(w)
                if ids and (size > 100_000 or n == len(rows)):
                    found = search(index, ids, words)
                    if found:
                        k, v = zip(*found.items(), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64()), pa.array([x[0] for x in v], pa.int64()), pa.array([x[1] for x in v])], schema=schema)
                    ids, words, size = [], [], 0

    return docs.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"{key} bigint, {item} bigint, words bigint, alike double")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id of every document that shares a run of at least RUN words with an item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).filter("words > 0").select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, documents (with a run of RUN words), alike_documents (with an item-sized window that is alike), most_words, most_alike."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("alike").alias("alike"))
    return found.groupBy("item_id").agg(F.count_if(F.col("words") > 0).alias("documents"), F.count_if(F.col("alike") >= SIMILAR).alias("alike_documents"), F.max("words").alias("most_words"), F.max("alike").alias("most_alike"))
