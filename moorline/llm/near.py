"""Problem 4: bodies that are another body with small edits, and the groups that they form.

Method: pigeonhole blocks. A body is a set of numbered words (the second "the" is another element than the first), in
one order for all bodies, rare words first. Two bodies of which at least SHARE of the longer's words are in the other
leave out at most n - ceil(SHARE * n) words of either, so of the first n - ceil(SHARE * n) + 1 words of each at least
one is shared: those words are a body's blocks, and no near pair is without a common block. Within blocks the bodies'
parity codes (each word flips one bit) are compared: every word that one of two bodies lacks changes at most one bit,
so near bodies differ in at most n + m - 2 * ceil(SHARE * max(n, m)) bits. Neither step loses a pair; what is left is
verified on the words themselves.
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

from moorline.llm.forms import _special, consistent
from moorline.llm.graph import components
from moorline.llm.records import only_in
from moorline.session import dropped, table, written

MIN_WORDS, SHARE = 25, 0.8
#: Bodies of a block up to which all are compared with all; in larger blocks those near the first aren't compared among
#: themselves. One task compares WHOLE times as many; still larger blocks are dealt to cells.
HOT, WHOLE = 8192, 8
#: Rows of blocks that are on disk at a time, where ROUNDS passes over the bodies are enough for that.
ROWS, ROUNDS = 1 << 24, 8
#: Words whose order by frequency is known to all tasks (the most frequent of those that occur twice; 8 bytes each are
#: broadcast). The others come before them, by their hash. Any order is right; a better one makes smaller blocks.
RANKED = 1 << 19
_CELLS = 1 << 21
#: Pairs of codes that are compared at a time.
TILE = 1 << 15
#: Pairs up to which a block is compared together with others, pairs that are compared or checked together, and pairs of
#: a task that are held to be made different.
FEW, AT_ONCE, PAIRS = 1000, 1 << 18, 1 << 21

_apostrophes = re.compile("['’‘ʼ＇]")
_signs = re.compile(r"[^\x00-\x7f\w]")
_first_bytes = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_to_words = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    """Words of the consistent form: runs of letters or digits, case ignored, apostrophes dropped."""
    return [w.decode() for w in word_bytes(text)]


def word_bytes(text: str | None) -> list[bytes]:
    """The same words in UTF-8."""
    return _spaced(text).split()


def _spaced(text: str | None) -> bytes:
    """The words with spaces between them, and maybe more around them."""
    s = consistent(text) or ""
    if s.isascii():
        return s.lower().encode().translate(_to_words, b"'")
    if _special.search(s):  # else all that is not ASCII are letters
        s = _apostrophes.sub("", s)
        return _signs.sub(" ", s.casefold()).encode().translate(_to_words)
    return s.casefold().encode().translate(_to_words, b"'")


def _word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit ids of the words of spaced texts one after another, number of words of each text)."""
    data = b" ".join([*texts, b" " * 8])
    letter = np.concatenate([[False], np.frombuffer(data, np.uint8) != 32])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight, h, todo = np.ndarray(len(data) - 7, "<u8", data, 0, (1,)), np.zeros(len(start), np.uint64), np.arange(len(start))
    for k in range(0, 64, 8):
        left = size[todo] - k
        h[todo] = _mix(h[todo] ^ (eight[start[todo] + k] & _first_bytes[np.minimum(left, 8)]))
        todo = todo[left > 8]
    for i in todo.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h >> np.uint64(32), np.diff(np.searchsorted(start, ends), prepend=0)


class _Ids(dict):
    def __missing__(self, word: bytes | str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _numbered(ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """32-bit elements of bodies one after another: words told apart by how often they came before in their body. The order within a body is lost."""
    doc = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
    s = np.sort((doc << np.uint64(32)) | ids)
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    nth = np.arange(len(s), dtype=np.uint64) - np.repeat(start, np.diff(np.append(start, len(s)))).astype(np.uint64)
    return _mix((s & np.uint64(0xFFFFFFFF)) + (nth << np.uint64(32))) >> np.uint64(32)


def tokens(df: DataFrame, key: str = "row_id", body: str = "body", extra: str | None = None, least: int = MIN_WORDS) -> DataFrame:
    """key, same, scope, bag, n, toks of every body of at least `least` words.

    bag is a hash of the words with repetition; in a partition only the first row of a bag and scope carries toks, the
    others name that row in `same`, so a text that fills a third of the table comes once per partition.
    extra: a column whose squeezed consistent form limits what is compared (scope); without it scope is 0.
    """
    fields = [(key, pa.int64()), ("same", pa.int64()), ("scope", pa.int64()), ("bag", pa.int64()), ("n", pa.int32()), ("toks", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from moorline.llm.records import hashed, squeeze

        first, scopes = {}, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                ids, spaced, scope = [], [], []
                for i, b, r in zip(*(c.to_pylist() for c in whole.slice(at, 2000).columns), strict=True):
                    if not b:
                        continue
                    ids.append(i)
                    spaced.append(_spaced(b))
                    if r not in scopes:
                        if len(scopes) > 10_000:
                            scopes.clear()
                        scopes[r] = hashed(squeeze(consistent(r))) if r else 0
                    scope.append(scopes[r])
                words, n = _word_ids(spaced)
                if not (n >= least).any():
                    continue
                words, n, ids, scope = words[np.repeat(n >= least, n)], n[n >= least], [i for i, m in zip(ids, n, strict=True) if m >= least], [s for s, m in zip(scope, n, strict=True) if m >= least]
                tok = _numbered(words, n)
                ends = np.cumsum(n)
                bag = np.add.reduceat(_mix(tok + np.uint64(1)), ends - n).view(np.int64)
                same = [first.setdefault((s, int(h)), i) for s, h, i in zip(scope, bag, ids, strict=True)]
                if len(first) > 200_000:
                    first.clear()
                lead = np.array([a == b for a, b in zip(same, ids, strict=True)])
                keep = np.repeat(lead, n)
                offsets = np.concatenate([[0], np.cumsum(np.where(lead, n, 0))]).astype(np.int32)
                toks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tok[keep].astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(same, pa.int64()), pa.array(scope, pa.int64()), pa.array(bag), pa.array(n.astype(np.int32)), toks], schema=pa.schema(fields))

    columns = [F.col(key).cast("bigint").alias(key), F.col(body), (F.col(extra) if extra else F.lit(None).cast("string")).alias("_scope")]
    return df.select(*columns).mapInArrow(run, f"{key} bigint, same bigint, scope bigint, bag bigint, n int, toks array<int>")


class Order(NamedTuple):
    """The frequent elements, their numbers of bodies, and whether any element that is not listed occurs once."""

    element: np.ndarray
    bodies: np.ndarray
    whole: bool


def frequencies(toks: DataFrame) -> Order:
    """How many bodies hold an element, counted over all bodies, of the RANKED most frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added():  # noqa: ANN202
            t, at = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            return t, np.bincount(at, np.concatenate([b for _, b in held]), len(t)).astype(np.int64)

        for batch in batches:
            held.append(np.unique(batch.column(0).flatten().to_numpy(), return_counts=True))
            size += len(held[-1][0])
            if size > 4_000_000:
                held = [added()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["t", "c"])
                    held, size = [], 0
        if held:
            t, c = added()
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c)], names=["t", "c"])

    counts = toks.filter("size(toks) > 0").select("toks").mapInArrow(count, "t int, c bigint").groupBy("t").agg(F.sum("c").alias("c")).filter("c > 1")
    top = counts.orderBy(F.desc("c"), "t").limit(RANKED).toArrow()
    return Order(top["t"].to_numpy().astype(np.int32).view(np.uint32), top["c"].to_numpy().astype(np.int64), len(top) < RANKED)


def _ranks(order: Order) -> np.ndarray:
    """A rank for every cell of an element's low bits: 0 where no listed element falls, else rising with the frequency."""
    total = np.zeros(_CELLS, np.int64)
    np.add.at(total, order.element & np.uint32(_CELLS - 1), order.bodies)
    used = np.flatnonzero(total)
    out = np.zeros(_CELLS, np.uint32)
    out[used[np.argsort(total[used], kind="stable")]] = np.arange(1, len(used) + 1, dtype=np.uint32)
    return out


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many words a body of at most n words must share with one of n words to be near."""
    return np.ceil(n * SHARE - 1e-9).astype(np.int64)


def code_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of a parity code: a power of two, two to four bits for each word of the body."""
    return 1 << np.maximum(1, np.ceil(np.log2(np.maximum(n, 1) / 32)).astype(np.int64))


def parity_codes(tok: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all codes' words one after another, number of words of each)."""
    width = code_words(n)
    base = np.cumsum(width) - width
    bit = _mix(tok ^ np.uint64(0x5851F42D)) >> np.uint64(24)
    word = np.repeat(base, n) + ((bit >> np.uint64(6)) & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(width.sum()), np.uint64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (bit & np.uint64(63)))
    return out, width


def _among(k: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which k are in the sorted `of`, their places there)."""
    at = np.minimum(np.searchsorted(of, k), max(len(of) - 1, 0))
    return (of[at] == k if len(of) else np.zeros(len(k), bool)), at


class First(NamedTuple):
    """The body of least key in each large block, in the order of k; the words of its code begin at `start`."""

    k: np.ndarray
    id: np.ndarray
    n: np.ndarray
    words: np.ndarray
    start: np.ndarray


def blocks(toks: DataFrame, order: Order, key: str = "row_id", codes: bool = True, ids: bool = False, above: int = 0, only: np.ndarray | None = None, without: np.ndarray | None = None, turn: tuple[int, int] = (0, 1), first: First | None = None) -> DataFrame:
    """k, key, n, place, code of the blocks of every body: its elements up to the last that a near body must share, rare ones first. The scope takes part in k.

    An element of one body alone is no block. With codes=False only k, with ids=True k and key; with `above` only of elements
    that more bodies may hold. only, without: sorted k that alone are made, or are left out; turn (i, of): those of one of several passes.
    first: instead of blocks the pairs k, a, b of a block's first body and each other whose codes allow them to be near.
    """
    shared = toks.sparkSession.sparkContext.broadcast((order, only if first is None else first.k, without, first))
    ddl = f"k bigint, {key} bigint, n int, place int, code binary" if codes else f"k bigint, {key} bigint" if ids else "k bigint"
    fields = [("k", pa.int64()), (key, pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("code", pa.binary())][: 5 if codes else 1 + ids]
    if first is not None:
        ddl, fields = "k bigint, a bigint, b bigint", [("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, only, without, first = shared.value
        rank, whole = _ranks(order), order.whole
        many = np.zeros(_CELLS, np.int64)
        np.add.at(many, order.element & np.uint32(_CELLS - 1), order.bodies)
        many = (many > above) | (np.zeros(1, bool) if whole else rank == 0)  # what is not listed may be in any number of bodies
        for all_ in batches:
            for at in range(0, all_.num_rows, 2000):
                batch = all_.slice(at, 2000)
                n = batch.column(2).to_numpy().astype(np.int64)
                tok = batch.column(3).flatten().to_numpy().view(np.uint32).astype(np.uint64)
                doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                s = np.sort((doc << np.uint64(53)) | (rank[tok & np.uint64(_CELLS - 1)].astype(np.uint64) << np.uint64(32)) | tok)
                place = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
                use = place <= np.repeat(n - least_shared(n), n)
                if whole:
                    use &= (s >> np.uint64(32)) & np.uint64((1 << 21) - 1) > 0
                if above:
                    use &= many[s & np.uint64(_CELLS - 1)]
                s, place, doc = s[use] & np.uint64(0xFFFFFFFF), place[use].astype(np.int32), (s[use] >> np.uint64(53)).astype(np.int64)
                scope = batch.column(1).to_numpy().view(np.uint64)
                k = _mix(s + _mix(scope[doc])).view(np.int64)
                use = (k.view(np.uint64) >> np.uint64(20)) % np.uint64(turn[1]) == turn[0]
                if only is not None:
                    use &= _among(k, only)[0]
                if without is not None:
                    use &= ~_among(k, without)[0]
                k, doc, place = k[use], doc[use], place[use]
                if not codes:
                    yield pa.RecordBatch.from_arrays([pa.array(k), *[batch.column(0).take(pa.array(doc))] * ids], schema=pa.schema(fields))
                    continue
                code, width = parity_codes(tok, n)
                if first is not None:
                    own, at = batch.column(0).to_numpy(), _among(k, first.k)[1]
                    near = _near_codes((code, np.cumsum(width) - width, n), (first.words, first.start, first.n), doc, at) & (own[doc] != first.id[at])
                    yield pa.RecordBatch.from_arrays([pa.array(k[near]), pa.array(first.id[at[near]]), pa.array(own[doc[near]])], schema=pa.schema(fields))
                    continue
                k = pa.array(k)
                each = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(width * 8)]).astype(np.int32)), pa.py_buffer(code)])
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([k, batch.column(0).take(take), batch.column(2).take(take), pa.array(place), each.take(take)], schema=pa.schema(fields))

    return toks.filter("size(toks) > 0").select(key, "scope", "n", "toks").mapInArrow(run, ddl)


def _folded(words: np.ndarray, start: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
    """Codes of `width` words, a column each, of codes that begin at `start` and have `own` words."""
    out = np.empty((width, len(start)), np.uint64)
    for o in np.flatnonzero(np.bincount(own)).tolist():
        at = np.flatnonzero(own == o)
        out[:, at] = np.bitwise_xor.reduce(words[start[at][:, None] + np.arange(o)].reshape(len(at), o // width, width), axis=1).T
    return out


def _near_codes(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the codes of pairs (r of x, c of y) allow them to be near; x and y: words, start and n."""
    n, m = x[2][r], y[2][c]
    least = least_shared(np.maximum(n, m))
    ok = np.minimum(n, m) >= least
    wide = np.where(ok, np.minimum(code_words(n), code_words(m)), 0)
    for w in np.flatnonzero(np.bincount(wide)).tolist():
        if w:
            at = np.flatnonzero(wide == w)
            mixed = _folded(x[0], x[1][r[at]], code_words(n[at]), w) ^ _folded(y[0], y[1][c[at]], code_words(m[at]), w)
            ok[at] = np.bitwise_count(mixed).sum(0, dtype=np.int64) <= (n + m - 2 * least)[at]
    return ok


# ---- pairs of a block ------------------------------------------------------------------------------------------------


class _Bodies:
    """Bodies of many blocks in the order of block, side and length, their codes folded as needed. t: k, key, n, place, code, side."""

    def __init__(self, t: pa.Table) -> None:
        k, ids, n, place, side = (t.column(c).to_numpy() for c in (0, 1, 2, 3, 5))
        group = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) * 2 + side  # k comes sorted
        o = np.argsort((group << 32) | n, kind="stable")
        self.group, self.id, self.n, self.place = group[o], ids[o], n[o].astype(np.int64), place[o].astype(np.int64)
        self.least, self.own, self.folded = least_shared(self.n), code_words(self.n), {}
        code = t.column(4).combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(code.buffers()[1], np.int64)[code.offset : code.offset + len(code) + 1]
        self.words, self.start = np.frombuffer(code.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64), ((ends[:-1] - ends[0]) // 8)[o]

    def fold(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of `width` words of the bodies whose own are at least as wide, and the places of bodies among them."""
        if width not in self.folded:
            held = self.own >= width
            at = np.cumsum(held) - held
            self.folded[width] = _folded(self.words, self.start[held], self.own[held], width), at
        return self.folded[width]

    def differing(self, r: np.ndarray, c: np.ndarray, width: int) -> np.ndarray:
        """Differing bits of pairs of bodies by codes of `width` words."""
        code, at = self.fold(width)
        return np.bitwise_count(code[:, at[r]] ^ code[:, at[c]]).sum(0, dtype=np.int64)

    def partners(self, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the bodies of like length that each is held against: those after it in its block (alone), or for side 0 those of side 1."""
        group, n = (self.group << 32), self.n
        if alone:
            first = np.arange(1, len(n) + 1)
        else:
            first = np.searchsorted(group | n, (group + (1 << 32)) | self.least, "left")
            group = group + (1 << 32)
        end = np.searchsorted((self.group << 32) | self.least, group | n, "right")
        return first, np.maximum(first, end) if alone else np.where(self.group & 1, first, np.maximum(first, end))


def _alike_codes(p: np.ndarray, q: np.ndarray, top: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of p, column of q, differing bits) where codes differ in at most top[row] bits, by tiles that stay in a core's cache."""
    rows, kind = p.shape[1], np.uint8 if len(p) < 4 else np.uint16
    size = max(1, TILE // rows)
    mixed, bits, total = np.empty((rows, size), np.uint64), np.empty((rows, size), np.uint8), np.empty((rows, size), kind)
    top = np.minimum(top, np.iinfo(kind).max).astype(kind)[:, None]
    for lo in range(0, q.shape[1], size):
        part = q[:, lo : lo + size]
        m, c, far = (v[:, : part.shape[1]] for v in (mixed, bits, total))
        for w in range(len(p)):
            np.bitwise_xor(p[w][:, None], part[w], out=m)
            np.bitwise_count(m, out=c)
            np.add(far, c, out=far) if w else np.copyto(far, c)
        near = far <= top
        at = np.flatnonzero(near)
        if len(at):
            r, at = at // near.shape[1], at % near.shape[1]
            yield r, at + lo, far[r, at].astype(np.int64)


def close_pairs(x: _Bodies, alone: bool, step: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the pairs of a block that length, places and codes allow to be near; between the sides, that of side 0 first."""
    first, end = x.partners(alone)
    block = x.group >> 1
    pairs = np.bincount(block, end - first)[block]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def ready(most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal size
        if size > most:
            r, c, far = (np.concatenate(v) for v in zip(*held, strict=True))
            held.clear()
            size = 0
            least = np.maximum(x.least[r], x.least[c])
            bits = x.n[r] + x.n[c] - 2 * least
            # What comes before the first shared element is in one body alone; and each must be long enough for the other.
            ok = (far <= bits) & (x.place[r] + x.place[c] <= bits) & (np.minimum(x.n[r], x.n[c]) >= least)
            if alone:
                ok &= r < c
            r, c, bits = r[ok], c[ok], bits[ok]
            wide, ok = np.minimum(x.own[r], x.own[c]), np.zeros(len(r), bool)
            for w in np.flatnonzero(np.bincount(wide)).tolist():  # by the whole codes, of the shorter's width
                at = np.flatnonzero(wide == w)
                ok[at] = x.differing(r[at], c[at], w) <= bits[at]
            yield x.id[r[ok]], x.id[c[ok]]

    few = np.flatnonzero((pairs <= FEW) & (end > first))
    part = np.cumsum(end[few] - first[few]) // AT_ONCE
    for rows in np.split(few, np.flatnonzero(np.diff(part)) + 1) if len(few) else ():  # many small blocks at once
        m = end[rows] - first[rows]
        r = np.repeat(rows, m)
        c = np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[rows], m)
        far = x.differing(r, c, 2)  # folding never adds a difference
        ok = far <= 2 * (x.n[r] - x.least[r]) + 1  # no partner of any length allows more
        held.append((r[ok], c[ok], far[ok]))
        size += len(held[-1][0])
        yield from ready(AT_ONCE)
    many = np.flatnonzero((pairs > FEW) & (end > first))
    if len(many):
        edge = np.flatnonzero(np.diff(block[many])) + 1
        for lo, hi in zip(many[np.concatenate([[0], edge])].tolist(), (many[np.concatenate([edge - 1, [len(many) - 1]])] + 1).tolist(), strict=True):
            for i in range(lo, hi, step):
                j = min(i + step, hi)
                a, b = int(first[i]), int(end[i:j].max())
                if a >= b:
                    continue
                width = int(min(x.own[i], x.own[a])) // 2
                code, at = x.fold(width)
                for r, c, far in _alike_codes(code[:, at[i] : at[i] + j - i], code[:, at[a] : at[a] + b - a], 2 * (x.n[i:j] - x.least[i:j]) + 1):
                    held.append((r + i, c + a, far))
                    size += len(r)
                    yield from ready(AT_ONCE)
    yield from ready(0)


def _different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    low = min(a.min(), b.min())
    if int(max(a.max(), b.max())) - int(low) < 1 << 32:
        both = np.sort(((a - low).view(np.uint64) << np.uint64(32)) | (b - low).view(np.uint64))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        return (both >> np.uint64(32)).view(np.int64) + low, (both & np.uint64(0xFFFFFFFF)).view(np.int64) + low
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new]


def block_pairs(rows: DataFrame, key: str, alone: bool) -> DataFrame:
    """a, b: the pairs of bodies of a block that may be near, each once. rows: k, key, n, place, code, side.

    alone: any two bodies of a block (a < b), else one of side 0 (a) and one of side 1 (b). Blocks come sorted, one after
    another. A near pair meets in many blocks, so a task's pairs are made different before they are sent. With `alone` a
    row of side 2 is no body; it says that the body of its key is not compared with others of which that is said.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            side = t.column(5).to_numpy()
            if not alone or not (said := side == 2).any():
                yield from close_pairs(_Bodies(t), alone)
                return
            k, i = t.column(0).to_numpy(), t.column(1).to_numpy()
            known = set(zip(k[said].tolist(), i[said].tolist(), strict=True))
            linked = np.array([x in known for x in zip(k[~said].tolist(), i[~said].tolist(), strict=True)], bool)
            t = t.filter(pa.array(~said)).set_column(5, "side", pa.array(linked.astype(np.int32)))
            if not linked.all():
                yield from close_pairs(_Bodies(t.filter(pa.array(~linked))), True)
                yield from ((a[a != b], b[a != b]) for a, b in close_pairs(_Bodies(t), False))

        def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for a, b in pairs(t):
                if len(a):
                    found.append((np.minimum(a, b), np.maximum(a, b)) if alone else (a, b))
                    yield from send(PAIRS)

        def send(most: int) -> Iterator[pa.RecordBatch]:
            if sum(len(a) for a, _ in found) > most:
                a, b = _different(*(np.concatenate(v) for v in zip(*found, strict=True)))
                found.clear()
                if len(a) > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
                else:
                    found.append((a, b))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 50_000:
                continue
            t = pa.Table.from_batches(held)
            k = t.column(0).to_numpy()
            cut = int(np.searchsorted(k, k[-1], "left"))  # the last block may go on
            if cut:
                yield from whole(t.slice(0, cut))
                held, size = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if size:
            yield from whole(pa.Table.from_batches(held))
        yield from send(0)

    rows = rows.select("k", key, "n", "place", "code", "side").repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def hot_blocks(toks: DataFrame, order: Order, key: str, hot: int) -> DataFrame | None:
    """k of the blocks of more than `hot` bodies; None where no element is in so many."""
    if order.whole and not (order.bodies > hot).any():
        return None
    return written(blocks(toks, order, key, codes=False, above=hot).groupBy("k").agg(F.count("*").alias("m")).filter(F.col("m") > hot).select("k"), "hot")


def cells(x: DataFrame, y: DataFrame, hot: int) -> DataFrame:
    """Rows for block_pairs of the bodies x (side 0) and y (side 1) of large blocks: every x meets every y of a like length in one cell, of about `hot` bodies a side at most."""
    at = ["k", "_band"]
    band = F.floor(F.log("n") / float(np.log(1 / SHARE))).cast("int")
    x = x.withColumn("_band", band)
    y = y.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    parts = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count("*") / hot).cast("int").alias(name))
    size = written(parts(x, "_px").join(parts(y, "_py"), at), "sizes")
    slot = lambda name: F.pmod(F.xxhash64(F.col("place"), F.col("code"), F.col("n"), *(c for c in x.columns if c.endswith("_id"))), F.col(name)).cast("int")
    all_ = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    x = x.join(F.broadcast(size), at).withColumn("_i", slot("_px")).withColumn("_j", all_("_py")).withColumn("side", F.lit(0))
    y = y.join(F.broadcast(size), at).withColumn("_j", slot("_py")).withColumn("_i", all_("_px")).withColumn("side", F.lit(1))
    both = x.unionByName(y)
    return both.withColumn("k", F.xxhash64("k", "_band", "_i", "_j")).drop("_band", "_i", "_j", "_px", "_py")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """The pairs (a, b) whose words overlap enough; left and right hold key and toks of every a and b. Repeated words count as often as both have them."""
    pairs = written(pairs, "pairs")
    a = only_in(left.select(F.col(key).alias("a"), F.col("toks").alias("ta")), "a", pairs, "a")
    b = only_in(right.select(F.col(key).alias("b"), F.col("toks").alias("tb")), "b", pairs, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").filter(shared >= F.ceil(F.greatest(F.size("ta"), F.size("tb")) * F.lit(SHARE) - F.lit(1e-9))).select("a", "b")


def linking(pairs: DataFrame, bodies: DataFrame, key: str = "row_id") -> DataFrame:
    """a, b: as many of the verified pairs (a < b) as connect all bodies that they would connect.

    First each body's pair with its least partner is verified, then every pair whose ends these leave apart.
    """
    pairs = written(pairs, "candidates")
    least = written(verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), bodies, bodies, key), "least")
    of = written(components(least, "first"), "parts")
    part = lambda end: of.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    apart = pairs.join(part("a"), "a", "left").join(part("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    return least.unionByName(verified(apart, bodies, bodies, key))


def first_bodies(toks: DataFrame, order: Order, large: DataFrame, key: str) -> First:
    """large: k and a, the least key of the block."""
    k = np.sort(large.select("k").toArrow()["k"].to_numpy())
    some = toks.join(F.broadcast(large.select(F.col("a").alias(key)).distinct()), key)
    of = blocks(some, order, key, only=k).join(large.select("k", F.col("a").alias(key)), ["k", key]).dropDuplicates(["k"]).select("k", key, "n", "code").toArrow().sort_by("k")
    code = of["code"].combine_chunks()
    ends = np.cumsum([0, *(len(c.as_py()) // 8 for c in code)])
    return First(of["k"].to_numpy(), of[key].to_numpy(), of["n"].to_numpy().astype(np.int64), np.frombuffer(b"".join(code.to_pylist()), np.uint64), ends[:-1])


def near_links(toks: DataFrame, key: str = "row_id", hot: int | None = None) -> DataFrame:
    """a, b: enough verified links between bodies to connect all that are near.

    In a block of more than `hot` bodies every body is first held against the block's first; those that are near to it
    are then not compared among themselves. Blocks are made in several passes over the bodies, each for some of the k,
    so that the disk holds a share of them at a time; what a pass leaves are its pairs.
    """
    order, hot = frequencies(toks), hot or HOT
    lead = toks.filter("size(toks) > 0").select(key, "toks")
    rows = toks.filter("size(toks) > 0").agg(F.sum(F.col("n") - F.ceil(F.col("n") * SHARE - 1e-9) + 1)).first()[0] or 0
    found, star, marks, huge = [], None, None, None
    if not order.whole or (order.bodies > hot).any():
        large = written(blocks(toks, order, key, codes=False, ids=True, above=hot).groupBy("k").agg(F.count("*").alias("m"), F.min(key).alias("a")).filter(F.col("m") > hot), "hot")
        if not large.isEmpty():
            held = written(blocks(toks, order, key, first=first_bodies(toks, order, large, key)).distinct(), "held")
            star = written(verified(held.select("a", "b").distinct(), lead, lead, key), "star")
            linked = written(held.join(star, ["a", "b"]).select("k", F.col("b").alias(key)).unionByName(large.select("k", F.col("a").alias(key))).distinct(), "linked")
            dropped(held)
            top = large.filter(F.col("m") > WHOLE * hot).select("k", "m").toArrow()
            huge, cell_rows = np.sort(top["k"].to_numpy()), int(sum(m * 4 * -(-m // (WHOLE * hot)) for m in top["m"].to_pylist()))
            marks = linked.join(F.broadcast(large.filter(F.col("m") <= WHOLE * hot).select("k")), "k").select("k", key, F.lit(0).alias("n"), F.lit(0).alias("place"), F.lit(b"").alias("code"), F.lit(2).alias("side"))
    turns = min(ROUNDS, -(-rows // ROWS)) or 1
    for i in range(turns):
        made = blocks(toks, order, key, without=huge, turn=(i, turns)).withColumn("side", F.lit(0))
        if marks is not None:
            made = made.unionByName(marks.filter(F.pmod(F.shiftrightunsigned("k", 20), F.lit(turns)) == i))
        found.append(written(block_pairs(made, key, alone=True), "found"))
    if huge is not None and len(huge):
        turns = -(-cell_rows // ROWS)
        for i in range(turns):
            of = written(blocks(toks, order, key, only=huge, turn=(i, turns)), "members")
            found.append(written(block_pairs(cells(of.join(linked, ["k", key], "left_anti"), of, WHOLE * hot), key, alone=False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "found"))
            dropped(of)
    pairs = found[0]
    for df in found[1:]:
        pairs = pairs.unionByName(df)
    links = linking(pairs.distinct() if len(found) > 1 else pairs, lead, key)
    for df in found:
        dropped(df)
    return links if star is None else links.unionByName(star)


def near_groups(df: DataFrame, key: str = "row_id", body: str = "body", hot: int | None = None) -> DataFrame:
    """first_row_id, row_id of every body of at least MIN_WORDS words: the group's smallest row_id (its own where it is alone).

    Null, blank and shorter bodies have no row; equal bodies, also under many ids, are one group; repeated rows count once.
    One body of each bag of words is compared with others, wherever its copies stand; the copies follow it.
    """
    toks = written(tokens(df.filter(F.col(key).isNotNull()), key, body), "tokens")
    held = toks.filter(F.col(key) == F.col("same"))  # those that carry toks
    bags = toks.groupBy("scope", "bag").agg(F.min(key).alias("least"), F.min(F.when(F.col(key) == F.col("same"), F.col(key))).alias("lead"), F.count_if(F.col(key) == F.col("same")).alias("held"))
    bags = written(bags, "bags")
    different, bodies = bags.agg(F.count("*"), F.sum("held")).first()
    few = 2 * different > (bodies or 0)  # then copies are compared like other bodies
    links = near_links(toks if few else written(only_in(held, key, bags, "lead"), "bodies"), key, hot)
    of = written(toks.select(key, "scope", "bag").join(bags.select("scope", "bag", "lead"), ["scope", "bag"]).select(key, "lead"), "leads")
    # A copy that was compared by itself, and a row_id of several bodies, are linked to their leads.
    copies = held.select(key, "scope", "bag").join(bags.filter("held > 1"), ["scope", "bag"]).filter(F.col(key) != F.col("lead")) if few else bags.limit(0).withColumn(key, F.col("lead"))
    several = of.groupBy(key).agg(F.min("lead").alias("a"), F.max("lead").alias("z")).filter("a <> z").select(key, "a")
    links = links.unionByName(copies.select(F.col("lead").alias("a"), F.col(key).alias("b"))).unionByName(of.join(several, key).select("a", F.col("lead").alias("b")))
    groups = components(links, "near").select(F.col("node").alias("lead"), F.col("component").alias("c"))
    named = bags.select("lead", "least").join(groups, "lead", "left").select("lead", "least", F.coalesce("c", "lead").alias("c"))
    first = named.groupBy("c").agg(F.min("least").alias("first_row_id"))
    return of.join(named.join(first, "c").select("lead", "first_row_id").distinct(), "lead").select("first_row_id", key).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_row_id, row_id: each member of a group of near bodies beside the group's smallest row_id."""
    return near_groups(table(spark, sf_dir, "train")).filter("row_id > first_row_id")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, group_id, size of the group for every body that counts."""
    groups = written(near_groups(table(spark, sf_dir, "train")).withColumnRenamed("first_row_id", "group_id"), "groups")
    return groups.join(groups.groupBy("group_id").agg(F.count("*").alias("members")), "group_id").select("row_id", "group_id", "members")
