"""TF-IDF: (document, term, weight) with sublinear counts, smooth IDF and unit length.

In long form (`counts`, `weights`) for small tables. Over whole tables terms are counted and weighed within Arrow batches:
a text that fills many cells is read once a batch, and only the counts of terms are shuffled, never terms of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.functions.text import TERM, control_terms
from moorline.session import written
from moorline.sources.tables import EXAMPLES

COLUMNS = ("body", "rule", *EXAMPLES)
FEATURES = 40_000
#: Rows of a batch that are read at a time; different terms that a task holds before it sends their counts.
ROWS, HELD = 2000, 2_000_000
_ascii_term = re.compile(r"[a-z0-9_]{2,}")


def cells(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """row_id, field, text: each cell is a document; null cells are left out."""
    return df.unpivot(["row_id"], list(columns), "field", "text").filter("text is not null")


def counts(docs: DataFrame) -> DataFrame:
    """row_id, field, term, tf."""
    return docs.select("row_id", "field", F.explode(control_terms(F.col("text"))).alias("term")).groupBy("row_id", "field", "term").agg(F.count("*").alias("tf"))


def _most_frequent(of: DataFrame, documents: int, features: int) -> DataFrame:
    return of.orderBy(F.desc("n"), "term").limit(features).withColumn("idf", F.ln((F.lit(1.0) + documents) / (F.col("df") + 1.0)) + 1)


def vocabulary(tf: DataFrame, documents: int, features: int = FEATURES) -> DataFrame:
    """term, n, df, idf of the terms with the highest counts (ties: the smaller term)."""
    return _most_frequent(tf.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df")), documents, features)


def weights(tf: DataFrame, terms: DataFrame) -> DataFrame:
    """row_id, field, term, w of unit length per document; terms outside the vocabulary are ignored."""
    raw = tf.join(terms.select("term", "idf"), "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = raw.groupBy("row_id", "field").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["row_id", "field"]).select("row_id", "field", "term", (F.col("w") / F.col("norm")).alias("w"))


# ---- whole tables ----------------------------------------------------------------------------------------------------


def _plain(text: Column) -> Column:
    """ASCII as it is, other text as the JVM's terms joined by spaces, so that terms are those of control_terms."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.array_join(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), " "))


def gathered(frame: DataFrame, columns: tuple[str, ...] = COLUMNS, label: Column | None = None) -> DataFrame:
    """row_id and for each column the texts of its document, with `label` also the rows' labels; rows of one row_id are one document a column, as in `counts`."""
    rows = frame.select("row_id", *(_plain(F.col(c)).alias(c) for c in columns), *([] if label is None else [label.alias("labels")]))
    single = lambda df: df.select("row_id", *(F.when(F.col(c).isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array(c)).alias(c) for c, kind in rows.dtypes[1:]))
    again = written(frame.groupBy("row_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("row_id").alias("again")), "repeated")
    if again.isEmpty():
        return single(rows)
    same = F.col("row_id").eqNullSafe(F.col("again"))
    merged = rows.join(again, same, "left_semi").groupBy("row_id").agg(*(F.collect_list(c).alias(c) for c in rows.columns[1:]))
    return single(rows.join(again, same, "left_anti")).unionByName(merged)


def _split(text: str) -> list[str]:
    return _ascii_term.findall(text.lower()) if text.isascii() else text.split(" ")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[tuple[str, ...]], np.ndarray]]:
    """(row_ids, different documents, document of each row and column or -1) of up to ROWS rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            known: dict[tuple[str, ...], int] = {}
            of = [[known.setdefault(tuple(x), len(known)) if x else -1 for x in c.to_pylist()] for c in batch.columns[1:]]
            yield batch.column(0).to_pylist(), list(known), np.array(of, np.int64).T


def _codes(docs: list[tuple[str, ...]], number) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """(document, code) of every term of the documents: a word's number, or (number + 1, next number) of two neighbours of a text. Words of number -1 have no terms."""
    flat, lens, of = [], [], []
    for k, texts in enumerate(docs):
        for t in texts:
            w = _split(t)
            flat += map(number, w)
            lens.append(len(w))
            of.append(k)
    ids = np.array(flat, np.int64)
    text = np.repeat(np.arange(len(lens)), lens)
    doc = np.array(of, np.int64)[text] if len(text) else text
    pair = (text[1:] == text[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)
    alone = ids >= 0
    return np.concatenate([doc[alone], doc[1:][pair]]), np.concatenate([ids[alone], (ids[:-1][pair] + 1 << 32) | ids[1:][pair]])


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n, df of gathered documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = _Numbers(), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return code, *(np.bincount(at, np.concatenate([h[k] for h in held]), len(code)).astype(np.int64) for k in (1, 2))

        def sent() -> Iterator[pa.RecordBatch]:
            words = pa.array(list(numbers), pa.string())
            code, n, df = merged()
            for lo in range(0, len(code), 100_000):
                c = code[lo : lo + 100_000]
                right = words.take(pa.array(c & 0xFFFFFFFF))
                left = words.take(pa.array(np.maximum((c >> 32) - 1, 0)))
                term = pa.compute.if_else(pa.array(c >> 32 > 0), pa.compute.binary_join_element_wise(left, right, " "), right)
                yield pa.RecordBatch.from_arrays([term, pa.array(n[lo : lo + 100_000]), pa.array(df[lo : lo + 100_000])], names=["term", "n", "df"])

        for _, different, of in _parts(batches):
            cells_of = np.bincount(of[of >= 0], minlength=len(different))
            doc, code = _codes(different, numbers.__getitem__)
            if not len(code):
                continue
            code, which = np.unique(code, return_inverse=True)
            key, tf = np.unique(doc * len(code) + which, return_counts=True)
            m = cells_of[key // len(code)]
            held.append((code, np.bincount(key % len(code), m * tf, len(code)), np.bincount(key % len(code), m, len(code))))
            size += len(code)
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from sent()
                    numbers, held, size = _Numbers(), [], 0
        if held:
            yield from sent()

    return docs.mapInArrow(run, "term string, n bigint, df bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def terms_of(frame: DataFrame, docs: DataFrame, columns: tuple[str, ...] = COLUMNS, features: int = FEATURES) -> DataFrame:
    """The `vocabulary` of a table; docs: its gathered documents."""
    n = frame.agg(*(F.count(c).alias(c) for c in columns)).first()
    return _most_frequent(term_counts(docs), sum(n), features)


class Vocabulary:
    """Terms in their order, for batches: words' numbers, the place of a word and of two neighbours, IDF."""

    def __init__(self, terms: DataFrame) -> None:
        t = terms.select("term", "idf").orderBy("term").toArrow()
        self.terms, self.idf = t["term"].to_pylist(), t["idf"].to_numpy().astype(float)
        self.number = _Numbers()
        codes = []
        for x in self.terms:
            a, _, b = x.partition(" ")
            codes.append((self.number[a] + 1 << 32) | self.number[b] if b else self.number[a])
        codes = np.array(codes, np.int64)
        order = np.argsort(codes)
        self.code, self.place = codes[order], order

    def vectors(self, docs: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each document and the end, places, weights); places rise within a document."""
        get = self.number.get
        doc, code = _codes(docs, lambda w: get(w, -1))
        if not len(self.code):
            doc, code = doc[:0], code[:0]
        at = np.minimum(np.searchsorted(self.code, code), max(0, len(self.code) - 1))
        ok = self.code[at] == code
        size = max(1, len(self.terms))
        key, tf = np.unique(doc[ok] * size + self.place[at[ok]], return_counts=True)
        doc, place = key // size, key % size
        w = (1 + np.log(tf)) * self.idf[place]
        w /= np.sqrt(np.bincount(doc, w * w, len(docs)))[doc]
        return np.searchsorted(doc, np.arange(len(docs) + 1)), place, w


def document_sums(docs: DataFrame, terms: Vocabulary) -> DataFrame:
    """row_id, field, terms, greatest, total of the weights of every gathered document that has any."""
    shared, columns, kind = docs.sparkSession.sparkContext.broadcast(terms), docs.columns[1:], docs.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, different, of in _parts(batches):
            start, _, w = shared.value.vectors(different)
            size = np.diff(start)
            there = size > 0
            greatest, total = np.zeros(len(size)), np.zeros(len(size))
            if there.any():
                greatest[there], total[there] = np.maximum.reduceat(w, start[:-1][there]), np.add.reduceat(w, start[:-1][there])
            row, field = np.nonzero((of >= 0) & np.append(there, False)[of])
            d = of[row, field]
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in row]), pa.array([columns[f] for f in field], pa.string()), pa.array(size[d]), pa.array(greatest[d]), pa.array(total[d])], names=["row_id", "field", "terms", "greatest", "total"])

    return docs.filter("row_id is not null").mapInArrow(run, f"row_id {kind}, field string, terms bigint, greatest double, total double")


def dots(start: np.ndarray, place: np.ndarray, w: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """The products of each row's first document with its others; 0 where either is missing."""
    out, body = np.zeros((len(of), of.shape[1] - 1)), np.zeros(size)
    bounds = start.tolist()
    for k, (b, *rest) in enumerate(of.tolist()):
        if b < 0:
            continue
        at = slice(bounds[b], bounds[b + 1])
        body[place[at]] = w[at]
        for f, d in enumerate(rest):
            if d >= 0:
                other = slice(bounds[d], bounds[d + 1])
                out[k, f] = body[place[other]] @ w[other]
        body[place[at]] = 0
    return out


def context_similarities(docs: DataFrame, terms: Vocabulary, rows: DataFrame) -> DataFrame:
    """row_id and the eight context features of rows: the body's similarity with its rule and examples, the greatest of either label and their margin."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(terms), docs.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, different, of in _parts(batches):
            out = dots(*shared.value.vectors(different), of, len(shared.value.terms))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c) for c in np.ascontiguousarray(out.T))], names=["row_id", *COLUMNS[1:]])

    found = docs.filter("row_id is not null").select("row_id", *COLUMNS).mapInArrow(run, f"row_id {kind}, " + ", ".join(f"{c} double" for c in COLUMNS[1:]))
    more = rows.groupBy("row_id").agg(F.count("*").alias("n")).filter("n > 1 or row_id is null")  # documents stand for one row each, those of no row_id for none
    more = written(more, "repeated")
    if not more.isEmpty():
        found = found.join(more.filter("row_id is not null"), "row_id", "left").withColumn("n", F.explode(F.array_repeat(F.lit(1), F.coalesce(F.col("n"), F.lit(1)).cast("int")))).drop("n")
        none = more.filter("row_id is null").select("row_id", F.explode(F.array_repeat(F.lit(0.0), F.col("n").cast("int"))).alias("z"))
        found = found.unionByName(none.select("row_id", *(F.col("z").alias(c) for c in COLUMNS[1:])))
    pos, neg = F.greatest(*EXAMPLES[:2]), F.greatest(*EXAMPLES[2:])
    return found.select("row_id", *(F.col(c).alias(f"similarity_{c}") for c in COLUMNS[1:]), pos.alias("max_positive_similarity"), neg.alias("max_negative_similarity"), (pos - neg).alias("similarity_margin"))
