"""Problem 1: records that differ only in layout, letter case, punctuation or the order of labelled fields.

Method: Bloom filters of canonical hashes seen once and seen repeatedly are built per partition and merged; only rows
that may repeat are shuffled and grouped exactly, every other row is its own record.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.session import table, written

_gaps = re.compile(r"[\W_]+")
_json_field = re.compile(r"""["“”'‘’]\s*([^"“”:=|\[\]{}]{1,40}?)\s*["“”'‘’]\s*[:=：]\s*["“”]([^"“”]*)["“”]""")
_bracket_field = re.compile(r"\[\s*([^\[\]]{1,30}?)\s*\]([^\[\]]*)")
_maybe_fields = re.compile(r"[\n|={\[;｛［＝｜]")
_marks = " \t\r\n\u00a0\u202f\u2007\u3000->*•#~–—\"'“”‘’"
_pair = re.compile(r"^\s*([^\W\d_][^:=|\[\]{}.!?;,\n]{0,30}?)\s*[:=：＝](.*)$", re.S)


_plain = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
_ascii_gaps = bytes(c for c in range(128) if not chr(c).isalnum())


def squeeze(text: str) -> str:
    """Letters and digits alone, letter case folded."""
    if text.isascii() or _plain.fullmatch(text):
        return text.casefold().encode().translate(None, _ascii_gaps).decode()
    return _gaps.sub("", unicodedata.normalize("NFC", text).casefold())


def fields_of(text: str) -> list[tuple[str, str]] | None:
    """The labelled fields of a text made of nothing else (at least two), or None for prose.

    Layouts: quoted names and values in braces; [Label] value; Label = value between bars; Label: value on lines or between semicolons.
    """
    s = text.strip().lstrip(_marks)
    if s[:1] in "{｛" and (found := _json_field.findall(s)) and len(found) > 1 and len(squeeze(s)) == sum(len(squeeze(a)) + len(squeeze(b)) for a, b in found):
        return found
    if s[:1] in "[［":
        found = _bracket_field.findall(s.replace("［", "[").replace("］", "]"))
        if len(found) > 1 and all(squeeze(b) for _, b in found):
            return found
    for bar in ("|", "｜", "\n", ";"):
        parts = [p for p in s.split(bar) if p.strip()]
        if len(parts) > 1:
            found = [_pair.match(p) for p in parts]
            if all(found) and all(squeeze(m[2]) and len(m[1].split()) <= 3 for m in found):
                return [(m[1], m[2]) for m in found]
    return None


def canonical(text: str) -> str:
    """What is compared in the sense of problem 1."""
    if _maybe_fields.search(text):
        found = fields_of(text)
        if found:
            return "\x1f".join(sorted(squeeze(a) + "\x1e" + squeeze(b) for a, b in found))
    return squeeze(text)


def hashed(text: str) -> int:
    """64 bits of a canonical text."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def keyed(df: DataFrame, key: str = "row_id", body: str = "body", rule: str = "rule", with_form: bool = False) -> DataFrame:
    """key, h, h2: 128 bits of rule and canonical body per row; rows without a letter or digit in body are left out.

    with_form: compare after problem 2's consistent form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from moorline.llm.forms import consistent

        form = consistent if with_form else (lambda x: x)
        rules: dict[str, str] = {}
        schema = pa.schema([(key, pa.int64()), ("h", pa.int64()), ("h2", pa.int64())])
        for batch in batches:
            ids, h, h2 = [], [], []
            for i, b, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = canonical(form(b)) if b else ""
                if not c:
                    continue
                if r not in rules:
                    if len(rules) > 10_000:
                        rules.clear()
                    rules[r] = squeeze(form(r)) if r else ""
                d = xxhash.xxh3_128_digest(rules[r] + "\x1d" + c)
                ids.append(i)
                h.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h, pa.int64()), pa.array(h2, pa.int64())], schema=schema)

    return df.select(F.col(key).cast("bigint").alias(key), F.col(body), F.col(rule)).mapInArrow(run, f"{key} bigint, h bigint, h2 bigint")


# The filter: words of 64 bits, four bits of one word for each hash, in pieces of PIECE words.
PIECE = 1 << 13
#: Bits of a filter for each row, and the words of one filter at most (32 MB). More rows are divided by ranges of their
#: hashes, each with a filter of its own, so that filters are as sparse at any number of rows.
BITS_PER_ROW, MAX_WORDS = 24, 1 << 22


def _words(rows: int) -> int:
    return int(min(MAX_WORDS, max(PIECE, 1 << int(np.ceil(np.log2(max(64, rows) * BITS_PER_ROW / 64))))))


def _spots(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    mask = np.zeros(len(u), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((u >> np.uint64(40 + 6 * k)) & np.uint64(63))
    return ((u & np.uint64((1 << 40) - 1)) % np.uint64(words)).astype(np.int64), mask


def _fold(once: np.ndarray, again: np.ndarray, h: np.ndarray) -> None:
    """Add a batch of hashes to the two filters of a partition; a hash of which the batch holds any number of copies is one step."""
    h, n = np.unique(h, return_counts=True)
    word, mask = _spots(h, len(once))
    seen = ((once[word] & mask) == mask) | (n > 1)
    np.bitwise_or.at(again, word[seen], mask[seen])
    np.bitwise_or.at(once, word, mask)


def _merged(hashes: DataFrame, words: int, twice: bool) -> DataFrame:
    """_range, piece, bits of the filters of (h, _range): of the hashes that occur at least twice (and of few others), or of all.

    Each partition builds a pair of filters and sends the pieces that it touched; pieces are merged by once = a | b,
    again = ra | rb | (a & b), which misses no repeat.
    """
    schema = pa.schema([("_range", pa.int32()), ("piece", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])

    def row(r: int, p: int, a: np.ndarray | None, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([p], pa.int32()), pa.array([b"" if a is None else zlib.compress(a.tobytes(), 1)]), pa.array([zlib.compress(b.tobytes(), 1)])], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, again = None, np.zeros(words, np.uint64), np.zeros(words, np.uint64)

        def send() -> Iterator[pa.RecordBatch]:
            for p in range(0, words, PIECE):
                if once[p : p + PIECE].any():
                    yield row(at, p // PIECE, once[p : p + PIECE], (again if twice else once)[p : p + PIECE])

        for batch in batches:
            h, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for r in np.unique(of):  # files hold one range each, so ranges come one after another
                if r != at:
                    if at is not None:
                        yield from send()
                        once[:], again[:] = 0, 0
                    at = int(r)
                _fold(once, again, h[of == r].astype(np.int64))
        if at is not None:
            yield from send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r, p, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(zlib.decompress(a), np.uint64), np.frombuffer(zlib.decompress(b), np.uint64)
                if (r, p) in held:
                    o, g = held[r, p]
                    held[r, p] = (o | a, g | b | (o & a))
                else:
                    held[r, p] = (a, b)
        for (r, p), (_, g) in held.items():
            yield row(r, p, None, g)

    ddl = "_range int, piece int, once binary, again binary"
    pieces = hashes.select("h", "_range").mapInArrow(build, ddl).repartition("_range", "piece")
    return pieces.mapInArrow(merge, ddl).select("_range", "piece", F.col("again").alias("bits"))


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    w, m = _spots(h, len(bits))
    return (bits[w] & m) == m


def split_repeats(hashes: DataFrame, column: str = "h", max_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that may repeat, rows that certainly do not), told apart without a shuffle of rows. hashes: a written table.

    Rows are divided by ranges of their hashes as they are written, one for every MAX_WORDS words of filter that they
    need; a task reads the filter of the range it is at from the shared folder, so no task and no broadcast grows with
    the number of rows.
    """
    n, most = hashes.count(), max_words or MAX_WORDS
    ranges = max(1, -(-n * BITS_PER_ROW // (64 * most)))
    words = min(_words(-(-n // ranges)), most)
    rows = hashes.withColumn("_range", F.pmod(F.shiftrightunsigned(column, 20), F.lit(ranges)).cast("int") if ranges > 1 else F.lit(0))
    if ranges > 1:
        rows = written(rows, "ranged", by="_range")
    filters = written(_merged(rows.select(F.col(column).alias("h"), "_range"), words, True), "filters", by="_range")
    path, names = filters._moorline_path, [*hashes.columns, "may_repeat"]
    at = hashes.columns.index(column)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        now, bits = None, np.zeros(words, np.uint64)
        for batch in batches:
            h, of = batch.column(at).to_numpy().astype(np.int64), batch.column(batch.num_columns - 1).to_numpy()
            may = np.zeros(len(h), bool)
            for r in np.unique(of):
                if r != now:
                    now, bits[:] = r, 0
                    pieces = ds.dataset(f"{root}/_range={r}", filesystem=system, format="parquet").to_table(columns=["piece", "bits"])
                    for p, b in zip(pieces["piece"].to_pylist(), pieces["bits"].to_pylist(), strict=True):
                        bits[p * PIECE : p * PIECE + PIECE] = np.frombuffer(zlib.decompress(b), np.uint64)
                may[of == r] = _held(bits, h[of == r])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(may)], names=names)

    ddl = ", ".join(f"`{c}` {t}" for c, t in [*hashes.dtypes, ("may_repeat", "boolean")])
    marked = rows.select(*hashes.columns, "_range").mapInArrow(mark, ddl)
    return marked.filter("may_repeat").drop("may_repeat"), marked.filter("not may_repeat").drop("may_repeat")


def only_in(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """The rows of df whose value may occur in values (few others remain), without a shuffle of df while the filter is within its bound; beyond it a semi-join, which leaves no others."""
    n = values.count()
    if n * BITS_PER_ROW > 64 * MAX_WORDS:
        return df.join(values.select(F.col(value).alias(column)).distinct(), column, "left_semi")
    words = _words(n)
    full = np.zeros(words, np.uint64)
    for row in _merged(values.select(F.xxhash64(value).alias("h"), F.lit(0).alias("_range")), words, False).toLocalIterator():
        full[row.piece * PIECE : row.piece * PIECE + PIECE] = np.frombuffer(zlib.decompress(row.bits), np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(full.tobytes())

    @F.pandas_udf("boolean")
    def held(h):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(_held(np.frombuffer(shared.value, np.uint64), h.to_numpy(np.int64)))

    return df.filter(held(F.xxhash64(column)))


def copies(df: DataFrame, key: str = "row_id", body: str = "body", rule: str = "rule") -> tuple[DataFrame, DataFrame]:
    """(groups, singletons): groups has h, h2, first_row_id, copies; singletons has first_row_id, copies = 1.

    A group may hold any share of all rows: counts are summed per partition before the shuffle.
    """
    repeat, single = split_repeats(written(keyed(df, key, body, rule), "keys"))
    groups = repeat.groupBy("h", "h2").agg(F.min(key).alias("first_row_id"), F.count("*").alias("copies"))
    return groups, single.select(F.col(key).alias("first_row_id"), F.lit(1).cast("bigint").alias("copies"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_row_id, row_id: each member of a set of copies beside the set's smallest row_id.

    Null and blank bodies belong to no set; a null rule counts as an empty one. Equal rows under one id count once.
    """
    repeat, _ = split_repeats(written(keyed(table(spark, sf_dir, "train")), "keys"))
    firsts = repeat.groupBy("h", "h2").agg(F.min("row_id").alias("first_row_id"), F.max("row_id").alias("last")).filter("last > first_row_id").drop("last")
    return repeat.join(firsts, ["h", "h2"]).filter("row_id > first_row_id").select("first_row_id", "row_id").distinct()


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_row_id, copies: one record per comment and rule, with the number of its copies."""
    groups, single = copies(table(spark, sf_dir, "train"))
    return groups.select("first_row_id", "copies").unionByName(single)
