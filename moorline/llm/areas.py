"""Problem 10: the subject areas of each document, several or none, and their shares of the corpus.

Method: labels are propagated over the graph of similar documents. All documents that share a word are neighbours, and
an edge is the sum over all common words of what each tells. Edges are never listed: what a word's documents know is
summed at the word and told from there to each of them, so a round takes time by the words, not by the pairs. Labelled
documents are clamped to their subjects, or to none, and any document may have several. What has reached a document
leans the reading of its sentences: the words' weights for each subject are counted over the labelled documents, then over all sentences
as they are read, and a document has every subject that a fifth of its sentences are about.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.llm.leaks import plain_words
from moorline.session import dropped, table, written

SHARE = 0.19  # "about a fifth"
NONE = "none"
#: Words are kept as one of so many cells; a heavy word outweighs the rare ones beside it. Subjects stored for a cell at most.
CELLS, TOP = 1 << 18, 16
#: A word in more than this share of the documents says nothing about likeness.
COMMON = 0.2
#: Rounds of propagation and of reading; what a document's graph label adds to a subject's share before reading.
ROUNDS, READINGS, LEAN = 4, 3, 0.1
#: Sentences by which a word's labels are drawn to the corpus; the weight below which no sentence is about an area.
PRIOR, SURE = 2.0, 0.55
#: The share of sentences about no area is taken to be this at least.
REST = 0.4
#: The share of no area with which the sentences of a labelled document begin.
START_REST = 0.15

_ends = re.compile(r"(?<=[.!?…])[\"'”’)\]*_]*\s+|\n+")


class _Cells(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = c = -1 if word.isdigit() else xxhash.xxh32_intdigest(word) & (CELLS - 1)
        return c


def sentence_cells(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lens, cells of every document with a word: the number of distinct words of each sentence, and their cells one after another; numbers are left out."""
    fields = pa.schema([(key, pa.int64()), ("lens", pa.list_(pa.int32())), ("cells", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = _Cells()
        for batch in batches:
            ids, lens, cells = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, flat = [], []
                for part in _ends.split(x) if x else ():
                    w = plain_words(part)
                    if len(w) > 2:
                        c = [cell[y] for y in dict.fromkeys(w)]
                        c = [y for y in c if y >= 0]
                        n.append(len(c))
                        flat += c
                if n:
                    ids.append(i)
                    lens.append(n)
                    cells.append(flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lens, pa.list_(pa.int32())), pa.array(cells, pa.list_(pa.int32()))], schema=fields)

    return docs.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"{key} bigint, lens array<int>, cells array<int>")


def _few(docs: DataFrame) -> DataFrame:
    """All rows in at most two tasks a core: every task sends sums of about the same size, so what is shuffled doesn't grow with the table."""
    return docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("at").agg(F.sum("c").alias("c"))


def document_frequencies(sent: DataFrame) -> tuple[np.ndarray, int]:
    """(documents of each cell, documents), counted over all; summed per partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total[list(set(x))] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, CELLS)), pa.array(np.append(total[at], n).astype(float))], names=["at", "c"])

    found = _summed(sent.select("cells").mapInArrow(count, "at bigint, c double")).toArrow()
    out = np.zeros(CELLS + 1)
    out[found["at"].to_numpy()] = found["c"].to_numpy()
    return out[:-1], int(out[-1])


class Told(NamedTuple):
    """For each cell its labels, and how much of each it tells a document that holds it."""

    start: np.ndarray
    label: np.ndarray
    weight: np.ndarray


def _told(sums: DataFrame, classes: int, weight: np.ndarray) -> Told:
    """From (at, c), at = cell * classes + label: a cell tells the mean of its documents, by its weight and by how far that is from the mean of all."""
    got = sums.toArrow()
    at, c = got["at"].to_numpy(), got["c"].to_numpy()
    del got
    order = np.argsort(at)
    cell, label, c = at[order] // classes, at[order] % classes, c[order]
    total, prior = np.bincount(cell, c, CELLS), np.bincount(label, c, classes)
    prior /= max(prior.sum(), 1e-9)
    part = c / total[cell]
    far = np.maximum(np.bincount(cell, part * np.log(part / prior[label]), CELLS), 0)
    return Told(np.searchsorted(cell, np.arange(CELLS + 1)), label.astype(np.int32), ((weight * far)[cell] * c / (total[cell] + PRIOR)).astype(np.float32))


def _heard(told: Told, cell: np.ndarray, doc: np.ndarray, docs: int, classes: int) -> np.ndarray:
    """Documents x labels: what the documents' cells tell them. A document that little has reached stays uncertain."""
    size = (told.start[cell + 1] - told.start[cell]).astype(np.int64)
    at = np.repeat(told.start[cell] - np.cumsum(size) + size, size) + np.arange(size.sum())
    m = np.bincount(np.repeat(doc, size) * classes + told.label[at], told.weight[at], docs * classes).reshape(docs, classes)
    p = m / (m.sum(1, keepdims=True) + 0.1)
    p[p < 0.02] = 0
    return p


def reached(docs: DataFrame, frequency: np.ndarray, n: int, classes: int, rounds: int = ROUNDS) -> DataFrame:
    """docs (key, lens, cells, and of labelled ones allowed, q) with label, p: what reaches each document over all that share a word with it; labelled ones keep theirs.

    A word's weight is its inverse frequency; every document and every word within COMMON takes part. The driver holds
    the labels that each cell meets.
    """
    weight = np.where((frequency > 1) & (frequency <= max(2.0, COMMON * n)), np.log(max(2, n) / np.maximum(frequency, 1)), 0.0).astype(np.float32)
    spark, key = docs.sparkSession, docs.columns[0]

    def states(batch: pa.RecordBatch, told: Told | None, good: np.ndarray) -> Iterator[tuple]:
        """(rows, document and cell of each of its words once, documents x labels)."""
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            cells, allowed, q = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("cells", "allowed", "q"))
            flat = np.concatenate([np.array(x, np.int64) for x in cells])
            doc = np.repeat(np.arange(len(cells)), [len(x) for x in cells])
            use = good[flat]
            if told is None:
                use &= np.array([bool(a) for a in allowed])[doc]
            both = np.unique(doc[use] * CELLS + flat[use])
            doc, cell = both // CELLS, both % CELLS
            p = np.zeros((len(cells), classes)) if told is None else _heard(told, cell, doc, len(cells), classes)
            for k, (a, x) in enumerate(zip(allowed, q, strict=True)):
                if a:
                    p[k] = 0
                    p[k, a] = x
            yield part, doc, cell, p

    def summed(told: Told | None) -> DataFrame:
        shared = spark.sparkContext.broadcast((told, weight > 0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def added() -> tuple[np.ndarray, np.ndarray]:
                at, where = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
                return at, np.bincount(where, np.concatenate([c for _, c in held]), len(at))

            for batch in batches:
                for _, doc, cell, p in states(batch, *shared.value):
                    d, label = np.nonzero(p)
                    start = np.searchsorted(doc, np.arange(len(p) + 1))
                    words = np.diff(start)[d]
                    c = cell[np.repeat(start[d] - np.cumsum(words) + words, words) + np.arange(words.sum())]
                    held.append((c * classes + np.repeat(label, words), np.repeat(p[d, label], words)))
                    size += len(c)
                    if size > 3_000_000:
                        held = [added()]
                        size = len(held[0][0])
            if held:
                at, c = added()
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(c, pa.float64())], names=["at", "c"])

        return _summed(_few(docs.select("cells", "allowed", "q")).mapInArrow(run, "at bigint, c double"))

    told = None
    for _ in range(rounds):
        told = _told(summed(told), classes, weight)
    last = spark.sparkContext.broadcast((told, weight > 0))
    schema = docs.select("*", F.col("allowed").alias("label"), F.col("q").alias("p")).drop("q").schema

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, p in states(batch, *last.value):
                has = [np.flatnonzero(x) for x in p]
                label, p = pa.array(has, pa.list_(pa.int32())), pa.array([x[h] for x, h in zip(p, has, strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in (key, "lens", "cells", "allowed")), label, p], names=[key, "lens", "cells", "allowed", "label", "p"])

    return docs.select(key, "lens", "cells", "allowed", "q").mapInArrow(tell, schema)


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """As `reached`, by joins over a graph whose edges (a, b, w) are listed: node, label, p of every node that a label reaches; seeds (node, label, p) keep theirs. A node's p add up to at most 1."""
    both = written(edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "edges")
    now = seeds
    for _ in range(rounds):
        told = both.join(now, both.a == now.node).groupBy(F.col("b").alias("node"), "label").agg(F.sum(F.col("w") * F.col("p")).alias("m"))
        total = told.groupBy("node").agg(F.sum("m").alias("t"))
        # A document that little has reached stays uncertain.
        heard = told.join(total, "node").select("node", "label", (F.col("m") / (F.col("t") + F.lit(0.1))).alias("p")).filter("p >= 0.02")
        before, now = now, written(heard.join(seeds.select("node").distinct(), "node", "left_anti").unionByName(seeds), "labels")
        if before is not seeds:
            dropped(before)
    return now


class Weights(NamedTuple):
    """For each cell its subjects and their weights beyond those of a subject that never meets it, and that one's weight; the subjects' shares."""

    start: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    absent: np.ndarray
    share: np.ndarray


def _weights(sums: DataFrame, described: dict[tuple[int, int], float], classes: int, tells: np.ndarray) -> Weights:
    """From (at, c), at = cell * classes + class; the subjects of a cell beyond the TOP heaviest share the rest of it.

    tells: whether a cell is met in more than one document and in not more than half of them; others tell nothing.
    """
    got = sums.groupBy(F.floor(F.col("at") / classes).alias("cell")).agg(F.sum("c").alias("total"), F.slice(F.sort_array(F.collect_list(F.struct("c", "at")), False), 1, TOP).alias("x"))
    got = got.select(F.col("total").cast("float").alias("total"), F.inline("x")).select("total", F.col("at").cast("int").alias("at"), F.col("c").cast("float").alias("c")).toArrow()
    at, c, t = got["at"].to_numpy().astype(np.int64), got["c"].to_numpy().astype(float), got["total"].to_numpy().astype(float)
    del got
    total = np.zeros(CELLS)
    total[at // classes] = t
    if described:
        more = np.array([k * classes + s for k, s in described])
        at, c = np.append(at, more), np.append(c, [2.0 * v for v in described.values()])
        np.add.at(total, more // classes, 2.0 * np.array([*described.values()]))
    at, c = at[tells[at // classes]], c[tells[at // classes]]
    total[~tells] = 0
    at, where = np.unique(at, return_inverse=True)
    c = np.bincount(where, c, len(at))
    share = np.bincount(at % classes, c, classes)
    share = np.maximum((share + max(0.0, total.sum() - c.sum()) / classes) / max(total.sum(), 1e-9), min(1e-4, 0.1 / classes))
    # Subjects that are not listed for a cell share what is left of it by their shares of the corpus.
    listed = np.bincount(at // classes, share[at % classes], CELLS)
    left = np.maximum(total - np.bincount(at // classes, c, CELLS), 0) / np.maximum(1 - listed, 1e-3)
    absent = np.where(total > 0, np.log((left + PRIOR) / (total + PRIOR)), 0).astype(np.float32)
    b, t = share[at % classes], total[at // classes]
    weight = (np.log((c + PRIOR * b) / ((t + PRIOR) * b)) - absent[at // classes]).astype(np.float32)
    share[-1] = max(share[-1], REST)
    return Weights(np.searchsorted(at // classes, np.arange(CELLS + 1)), (at % classes).astype(np.int32), weight, absent, share)


def _read(w: Weights, lens: np.ndarray, cells: np.ndarray, lean: np.ndarray) -> np.ndarray:
    """Sentences x classes: the probability of each class; lean is what the document adds to the classes' shares."""
    classes, sent = len(w.share), np.repeat(np.arange(len(lens)), lens)
    size = (w.start[cells + 1] - w.start[cells]).astype(np.int64)
    at = np.repeat(w.start[cells] - np.cumsum(size) + size, size) + np.arange(size.sum())
    z = np.bincount(np.repeat(sent, size) * classes + w.label[at], w.weight[at], len(lens) * classes).reshape(len(lens), classes)
    z += np.bincount(sent, w.absent[cells], len(lens))[:, None] + np.log(w.share + lean)
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _batches(batch: pa.RecordBatch, classes: int) -> Iterator[tuple]:
    """(ids, document of each sentence, lens, cells, lean, clamp, whether labelled) of up to 500 documents at a time."""
    for lo in range(0, batch.num_rows, 500):
        ids, lens, cells, label, p, allowed = (c.to_pylist() for c in batch.slice(lo, 500).columns)
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in lens])
        lean, clamp = np.zeros((len(ids), classes)), np.ones((len(ids), classes))
        for k, (s, q, a) in enumerate(zip(label, p, allowed, strict=True)):
            if s:
                lean[k, s] = q
            if a:
                clamp[k] = 0
                clamp[k, [*a, classes - 1]] = 1
        yield ids, doc, np.concatenate([np.array(x, np.int64) for x in lens]), np.concatenate([np.array(x, np.int64) for x in cells]), lean, clamp, np.array([bool(a) for a in allowed])


def _counted(docs: DataFrame, w: Weights | None, classes: int):  # noqa: ANN202
    """(at, c, and the broadcast that they need): how often a cell meets a class, by the labelled documents (without weights) or by all sentences as they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, held, size = shared.value, [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            at, where = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            return at, np.bincount(where, np.concatenate([c for _, c in held]), len(at))

        for batch in batches:
            for _, doc, lens, cells, lean, clamp, seed in _batches(batch, classes):
                if w is None:
                    p = np.where(seed[:, None], lean, 0.0)
                    p[seed, -1] = np.maximum(p[seed, -1], START_REST)
                    p = p[doc]
                else:
                    p = _read(w, lens, cells, LEAN * lean[doc]) * clamp[doc]
                    p /= np.maximum(p.sum(1, keepdims=True), 1e-9)
                s, k = np.nonzero(p >= 1e-3)
                start = np.cumsum(lens) - lens
                n = lens[s]
                c = cells[np.repeat(start[s] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                held.append((c * classes + np.repeat(k, n), np.repeat(p[s, k], n)))
                size += len(c)
                if size > 3_000_000:
                    held = [added()]
                    size = len(held[0][0])
        if held:
            at, c = added()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c)], names=["at", "c"])

    return _summed(_few(docs.select(docs.columns[0], "lens", "cells", "label", "p", "allowed")).mapInArrow(run, "at bigint, c double")), shared


def subject_shares(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, subject, share: the share of a document's sentences that are about each subject, where it is above 0.

    Null, empty and one-word texts have no row; labels of unknown documents or subjects, or null, are ignored; with
    repeated document rows each is read by itself and the greatest share counts. Any number of subjects.
    """
    about = subjects.filter("subject is not null").groupBy("subject").agg(F.concat_ws(" ", F.collect_list("description")).alias("d")).orderBy("subject").collect()
    names = [r.subject for r in about]
    classes, cell = len(names) + 1, _Cells()
    described: dict[tuple[int, int], float] = {}
    for k, r in enumerate(about):
        for w in {*plain_words(f"{r.subject} {r.d}")}:
            if cell[w] >= 0:
                described[cell[w], k] = 1.0
    sent = written(sentence_cells(docs, key, text), "sentences")
    number = docs.sparkSession.createDataFrame([(s, k) for k, s in enumerate([*names, NONE])], "subject string, label int")
    known = labels.select(F.col(key).cast("bigint").alias("node"), "subject").join(number, "subject").select("node", "label").distinct()
    seeds = known.join(known.groupBy("node").agg(F.count("*").alias("n")), "node").join(sent.select(F.col(key).alias("node")).distinct(), "node", "left_semi")
    seeds = written(seeds.select("node", "label", (F.lit(1.0) / F.col("n")).alias("p")), "seeds")
    frequency, n = document_frequencies(sent)
    tells = (frequency > 1) & (frequency <= max(2.0, 0.5 * n))
    allowed = seeds.groupBy("node").agg(F.collect_list("label").alias("allowed"), F.collect_list("p").alias("q"))
    base = written(sent.join(allowed.withColumnRenamed("node", key), key, "left").select(key, "lens", "cells", "allowed", "q"), "clamped")
    dropped(sent)
    every = written(reached(base, frequency, n, classes).select(key, "lens", "cells", "label", "p", "allowed"), "documents")
    dropped(base)
    w = None
    for _ in range(1 + READINGS):
        counted, sent_out = _counted(every, w, classes)
        w = _weights(counted, described, classes, tells)
        sent_out.destroy()  # the driver keeps one round's weights at a time
    shared = docs.sparkSession.sparkContext.broadcast((w, names))
    fields = pa.schema([(key, pa.int64()), ("subject", pa.string()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, names = shared.value
        for batch in batches:
            for ids, doc, lens, cells, lean, _, _ in _batches(batch, len(names) + 1):
                p = _read(w, lens, cells, LEAN * lean[doc])
                best = p[:, :-1].argmax(1) if names else np.zeros(len(p), int)
                sure = p[np.arange(len(p)), best] >= SURE if names else np.zeros(len(p), bool)
                n = np.bincount(doc, minlength=len(ids))
                at, c = np.unique(doc[sure] * len(names) + best[sure], return_counts=True)
                d, s = (at // len(names), at % len(names)) if names else (at, at)
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in d], pa.int64()), pa.array([names[x] for x in s], pa.string()), pa.array(c / n[d], pa.float64())], schema=fields)

    found = every.mapInArrow(run, f"{key} bigint, subject string, share double")
    return found.groupBy(key, "subject").agg(F.max("share").alias("share"))


def _of(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = subject_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))
    return shares.filter(F.col("share") >= SHARE)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, subject: the areas that at least about a fifth of a document's sentences are about."""
    return _of(spark, sf_dir).select("doc_id", "subject")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, documents, share_of_documents of every area that occurs."""
    n = table(spark, sf_dir, "documents").count()
    return _of(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents")).withColumn("share_of_documents", F.col("documents") / F.lit(float(max(1, n))))
