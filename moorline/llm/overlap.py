"""Problem 5: test rows that repeat a train row, exactly or almost, under the same rule.

Method: the blocks and parity codes of problem 4 with the rule as a part of the block; train and test rows are joined
block by block within the Hamming radius that a near pair cannot exceed, pairs are verified on their words and counted
by split and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.llm.near import HOT, block_pairs, blocks, cells, frequencies, hot_blocks, tokens, verified
from moorline.llm.records import keyed, only_in, split_repeats
from moorline.session import table, written


def cross_split_pairs(train: DataFrame, test: DataFrame, hot: int | None = None) -> DataFrame:
    """train_row_id, test_row_id of all pairs with one rule whose bodies are equal in the sense of problem 1 (after 2) or near.

    Rows with a null or blank body are in no pair; a null rule equals a blank one. Bodies are compared once per distinct
    bag of words and rule in a partition; the pairs of rows are made from the pairs of such classes at the end. Ids of
    the two tables may meet: a row is known by its table and id.
    """
    # Equal in the sense of problem 1: hashes that occur once can't be in a pair and leave before the shuffle.
    side = lambda df, name: keyed(df, with_form=True).withColumn("split", F.lit(name))
    keys, _ = split_repeats(written(side(train, "a").unionByName(side(test, "b")), "keys"))
    part = lambda s, name: keys.filter(F.col("split") == s).select("h", "h2", F.col("row_id").alias(name))
    equal = part("a", "train_row_id").join(part("b", "test_row_id"), ["h", "h2"]).select("train_row_id", "test_row_id")
    # Near: classes of equal bags per side, then blocks between the sides.
    ta, tb = written(tokens(train, extra="rule"), "tokens"), written(tokens(test, extra="rule"), "tokens")
    both = ta.unionByName(tb)
    order, hot = frequencies(both), hot or HOT
    y = blocks(tb, order).withColumn("side", F.lit(1))
    asked = written(blocks(tb, order, codes=False).distinct(), "asked")
    x = only_in(blocks(ta, order), "k", asked, "k").withColumn("side", F.lit(0))
    large = hot_blocks(both, order, "row_id", hot)
    if large is None or large.isEmpty():
        pairs = block_pairs(x.unionByName(y), "row_id", alone=False)
    else:
        pairs = block_pairs(x.unionByName(y).join(large, "k", "left_anti"), "row_id", alone=False)
        within = lambda df: written(df.drop("side").join(large, "k"), "members")
        pairs = pairs.unionByName(block_pairs(cells(within(x), within(y), hot), "row_id", alone=False)).distinct()
    lead = lambda t: t.filter("size(toks) > 0").select("row_id", "toks")
    found = verified(pairs, lead(ta), lead(tb))
    members = lambda t, c, name: t.select(F.col("same").alias(c), F.col("row_id").alias(name))
    near = found.join(members(ta, "a", "train_row_id"), "a").join(members(tb, "b", "test_row_id"), "b").select("train_row_id", "test_row_id")
    return equal.unionByName(near).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train_row_id, test_row_id: all pairs of a train and a test row that repeat each other."""
    return cross_split_pairs(table(spark, sf_dir, "train"), table(spark, sf_dir, "test"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eval_split, subreddit (of the test row, trimmed and in lower case, null kept), pairs, test_rows, train_rows."""
    test = table(spark, sf_dir, "test")
    pairs = cross_split_pairs(table(spark, sf_dir, "train"), test)
    of = test.select(F.col("row_id").alias("test_row_id"), "eval_split", F.lower(F.trim("subreddit")).alias("subreddit"))
    return pairs.join(of, "test_row_id").groupBy("eval_split", "subreddit").agg(F.count("*").alias("pairs"), F.countDistinct("test_row_id").alias("test_rows"), F.countDistinct("train_row_id").alias("train_rows"))
