"""Problem 8: texts into containers of fixed capacity.

Method: hierarchical multi-length packing. Texts are routed to tiers of context sizes. From the longest tier to the
shortest, a tier's texts are packed among themselves, then the gaps of its containers are filled from the shorter
tiers, always with the longest text that fits; what is left of a tier goes on to be packed as its own. Containers are
dealt to step groups of their tier so that groups carry about equal loads.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.session import table, written

CAPACITY = 2048
TIERS = (256, 512, 1024, 2048)
#: Tokens that one task packs; at most one container of each such part stays half empty.
PART = 4_000_000
#: Containers in a step group.
GROUP = 8
#: The vocabulary file, the same on every executor; a parameter of token_counts and packed, and of the queries by $MOORLINE_TOKENIZER.
TOKENIZER = os.environ.get("MOORLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The split pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = TOKENIZER):  # noqa: ANN201
    import tiktoken

    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("moorline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """key, tokens of every row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "tokens"])

    return df.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"{key} bigint, tokens bigint")


def pack(sizes: np.ndarray, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(container, position, tier of the container) of each item of at most `capacity`; items of size 0 join the last container.

    A tier holds the items above the next shorter tier's size, up to its own; the last one reaches to the capacity.
    """
    bounds = sorted({t for t in tiers if t < capacity} | {capacity})
    waiting: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):  # a list's end is its first item
        waiting.setdefault(int(sizes[i]), []).append(i)
    zero = waiting.pop(0, [])
    left = sum(1 << s for s in waiting)
    container, position, home = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    gaps: list[int] = []
    count: list[int] = []
    of: list[int] = []

    def place(fits: int, at: int) -> None:
        nonlocal left
        s = fits.bit_length() - 1  # the longest that fits
        i = waiting[s].pop()
        if not waiting[s]:
            left ^= 1 << s
        container[i], position[i], home[i] = at, count[at], of[at]
        gaps[at] -= s
        count[at] += 1

    for above, tier in reversed(list(zip([0, *bounds], bounds, strict=False))):
        own = ((1 << (tier + 1)) - 1) ^ ((1 << (above + 1)) - 1)
        first = len(gaps)
        while left & own:  # the tier by itself
            gaps.append(capacity)
            count.append(0)
            of.append(tier)
            while fits := left & own & ((1 << (gaps[-1] + 1)) - 1):
                place(fits, len(gaps) - 1)
        shorter = (1 << (above + 1)) - 1
        for at in sorted(range(first, len(gaps)), key=lambda k: -gaps[k]):  # then its gaps
            while fits := left & shorter & ((1 << (gaps[at] + 1)) - 1):
                place(fits, at)
    if zero and not gaps:
        gaps, count, of = [capacity], [0], [bounds[0]]
    for i in reversed(zero):
        container[i], position[i], home[i] = len(gaps) - 1, count[-1], of[-1]
        count[-1] += 1
    return container, position, home


def step_groups(loads: np.ndarray, group: int = GROUP) -> np.ndarray:
    """The step group of each container: sorted by load and dealt back and forth, so that groups differ little."""
    groups = max(1, -(-len(loads) // group))
    order = np.argsort(-loads, kind="stable")
    lap, k = np.divmod(np.arange(len(loads)), groups)
    out = np.zeros(len(loads), np.int64)
    out[order] = np.where(lap % 2 == 0, k, groups - 1 - k)
    return out


def packed(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """key, piece, first_token, tokens, tier, container, position, container_tier, step_group of every text, or of every piece of a text above the capacity.

    Each text is in one container, or in pieces of which all but the last fill a container. Null and empty texts have 0
    tokens and a place nonetheless. Texts are dealt to parts of about PART tokens by a hash of their key; parts are packed
    side by side, whatever the number of texts. Rows that repeat a key are packed each.
    """
    sized = written(token_counts(df, key, text, path), "sized")
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, round(total / PART))
    pieces = sized.select(key, "tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int")))).alias("piece"))
    pieces = pieces.select(key, "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("first_token"), F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("tokens"))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(key, "piece"), F.lit(parts)).cast("int"))
    ddl = f"{key} bigint, piece int, first_token bigint, tokens bigint, tier int, container bigint, position bigint, container_tier int, step_group bigint"
    tiers = np.array([t for t in TIERS if t < capacity] + [capacity])

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([key, "piece"], kind="stable").reset_index(drop=True)
        sizes = group.tokens.to_numpy()
        c, p, home = pack(sizes, capacity)
        loads, of = np.bincount(c, sizes, c.max() + 1), np.zeros(c.max() + 1, np.int64)
        of[c] = home
        steps, groups = np.zeros(len(loads), np.int64), 0
        for t in np.unique(of):
            g = step_groups(loads[of == t])
            steps[of == t] = g + groups
            groups += g.max() + 1
        base = int(group.part.iloc[0]) << 32
        return group.assign(tier=tiers[np.searchsorted(tiers, sizes)], container=base + c, position=p, container_tier=home.astype(np.int32), step_group=base + steps[c]).drop(columns="part")

    return pieces.groupBy("part").applyInPandas(fill, ddl)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, first_token, tokens, tier, container, position, container_tier, step_group."""
    return packed(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """containers, tokens, unused_share, texts, fewest (containers that any packing needs)."""
    of = packed(table(spark, sf_dir, "documents")).groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return of.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), (1 - F.sum("t") / (F.count("*") * F.lit(float(CAPACITY)))).alias("unused_share"), F.sum("n").alias("texts"), F.ceil(F.sum("t") / F.lit(float(CAPACITY))).alias("fewest"))
