"""The lexical engine: support examples of a policy against comments, by TF-IDF cosine, two nearest a label and abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moorline.functions.text import canonical, lexical_terms, nfkc, with_bigrams, without_stop_words, words
from moorline.session import written

# Fixed values of the engine.
NEIGHBOURS, RULE_BOOST, WEAK_SIMILARITY, WEAK_COVERAGE, BALANCED_MARGIN = 2, 1.5, 0.08, 0.15, 0.04
MAX_QUERY, MAX_RULE, MAX_EXAMPLE, MAX_PER_LABEL = 1200, 600, 500, 8
LABELS = ("violation", "allowed")


def _utf16_length(c):  # noqa: ANN001, ANN202
    return F.length(F.encode(c, "UTF-16BE")) / 2


def _text_ok(c, most: int):  # noqa: ANN001, ANN202
    t = F.trim(c)
    return F.coalesce((F.length(t) > 0) & (_utf16_length(t) <= most) & (F.length(canonical(t)) > 0), F.lit(False))


def supports(contexts: DataFrame) -> DataFrame:
    """context_id, label, place, text, key of every example, violations first. contexts: id, rule and arrays violation and allowed."""
    both = None
    for k, label in enumerate(LABELS):
        part = contexts.select(F.col("id").alias("context_id"), F.lit(label).alias("label"), F.posexplode(label).alias("p", "raw")).withColumn("place", F.col("p") + k * 100)
        both = part if both is None else both.unionByName(part)
    return both.select("context_id", "label", "place", F.trim("raw").alias("text"), canonical(F.col("raw")).alias("key"), _text_ok(F.col("raw"), MAX_EXAMPLE).alias("ok"))


def context_errors(contexts: DataFrame) -> DataFrame:
    """context_id, error: null where the context can be used. Wrong sizes, blank or too long texts, one text with both labels."""
    s = supports(contexts)
    sizes = contexts.select(F.col("id").alias("context_id"), (_text_ok(F.col("rule"), MAX_RULE)).alias("rule_ok"), *(F.coalesce(F.size(x).between(1, MAX_PER_LABEL), F.lit(False)).alias(f"{x}_ok") for x in LABELS))
    bad = s.groupBy("context_id").agg(F.max(~F.col("ok")).alias("text_bad"))
    clash = s.groupBy("context_id", "key").agg((F.min("label") < F.max("label")).alias("c")).groupBy("context_id").agg(F.max("c").alias("clash"))
    e = F.when(~F.col("rule_ok"), "invalid rule").when(~F.col("violation_ok") | ~F.col("allowed_ok"), "invalid number of examples").when(F.col("text_bad"), "invalid example").when(F.col("clash"), "conflicting labels")
    return sizes.join(bad, "context_id", "left").join(clash, "context_id", "left").select("context_id", e.alias("error"))


def variants(contexts: DataFrame) -> DataFrame:
    """The supports of each context once for every text that a query may copy, without that text.

    variant (the removed key, '' where none is), context_id, support_id, label, text, key, duplicates, purged. What a query
    changes is only whether one of the few examples is purged, so vocabularies are made per variant, never per query.
    """
    s = supports(contexts).filter("ok")
    first = Window.partitionBy("context_id", "key").orderBy("place")
    once = s.withColumn("n", F.row_number().over(first))
    dup = once.groupBy("context_id").agg((F.count("*") - F.count_if(F.col("n") == 1)).alias("duplicates"))
    once = once.filter("n = 1").join(dup, "context_id")
    gone = once.select("context_id", F.col("key").alias("variant")).unionByName(contexts.select(F.col("id").alias("context_id"), F.lit("").alias("variant")))
    kept = gone.join(once, "context_id").filter("variant <> key")
    order = Window.partitionBy("context_id", "variant").orderBy("place")
    ident = F.concat("label", F.lit("-"), (F.row_number().over(order) - 1).cast("string"))
    return kept.select("context_id", "variant", ident.alias("support_id"), "label", "text", "key", "duplicates", F.when(F.col("variant") == "", 0).otherwise(1).alias("purged"))


def fitted(contexts: DataFrame, v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vocabulary: context_id, variant, term, idf, boost; support weights: context_id, variant, support_id, term, w of unit length)."""
    tf = v.select("context_id", "variant", "support_id", F.explode(lexical_terms(F.col("text"))).alias("term")).groupBy("context_id", "variant", "support_id", "term").agg(F.count("*").alias("tf"))
    n = v.groupBy("context_id", "variant").agg(F.count("*").alias("n"))
    rule = contexts.select(F.col("id").alias("context_id"), without_stop_words(words(F.col("rule"))).alias("rule_words"))
    df = tf.groupBy("context_id", "variant", "term").agg(F.count("*").alias("df")).join(n, ["context_id", "variant"]).join(rule, "context_id")
    boost = F.when(F.forall(F.split("term", " "), lambda w: F.array_contains("rule_words", w)), RULE_BOOST).otherwise(1.0)
    vocab = df.select("context_id", "variant", "term", (F.ln((F.lit(1.0) + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"), boost.alias("boost"))
    raw = tf.join(vocab, ["context_id", "variant", "term"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf") * F.col("boost"))
    norm = raw.groupBy("context_id", "variant", "support_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return vocab, raw.join(norm, ["context_id", "variant", "support_id"]).select("context_id", "variant", "support_id", "term", (F.col("w") / F.col("norm")).alias("w"))


class Engine:
    """One set of contexts against a table of queries (query_id, context_id, text), every result by (query_id, context_id).

    Contexts hold at most 16 short examples each; what is made of them is small and Spark broadcasts it where its size allows.
    """

    def __init__(self, contexts: DataFrame, queries: DataFrame) -> None:
        errors = written(context_errors(contexts), "errors")
        self.contexts = contexts.join(errors.filter("error is null").select(F.col("context_id").alias("id")), "id", "left_semi")
        self.variants = written(variants(self.contexts), "variants")
        vocabulary, weights = fitted(self.contexts, self.variants)
        self.vocabulary = written(vocabulary, "vocabulary")
        self.support_weights = written(weights, "weights")
        # Keys and terms are made once a comment, not once a context: the one Python step of the engine.
        texts = queries.select("query_id", "text").distinct().withColumn("all_words", words(F.col("text")))
        texts = texts.select("query_id", F.array_join("all_words", " ").alias("key"), without_stop_words(F.col("all_words")).alias("ws"), F.coalesce((F.length(F.trim("text")) > 0) & (_utf16_length(F.trim("text")) <= MAX_QUERY) & (F.size("all_words") > 0), F.lit(False)).alias("ok"))
        q = queries.select("query_id", "context_id").join(written(texts, "texts"), "query_id").join(errors, "context_id")
        keys = self.variants.select("context_id", F.col("variant").alias("key")).distinct().withColumn("variant", F.col("key"))
        q = q.join(keys, ["context_id", "key"], "left").withColumn("variant", F.coalesce("variant", F.lit("")))
        enough = self.variants.groupBy("context_id", "variant").agg((F.count_distinct("label") == 2).alias("both"))
        q = q.join(enough, ["context_id", "variant"], "left")
        error = F.coalesce("error", F.when(~F.col("ok"), "invalid comment"), F.when(~F.coalesce("both", F.lit(False)), "no examples of a label remain"))
        self.queries = written(q.select("query_id", "context_id", "variant", "ws", error.alias("error")), "queries")

    def _terms(self) -> DataFrame:
        ok = self.queries.filter("error is null")
        per = ok.select("query_id", "context_id", "variant", F.explode(with_bigrams(F.col("ws"))).alias("term"))
        # Terms that no support holds leave before the count.
        per = per.join(self.vocabulary, ["context_id", "variant", "term"]).groupBy("query_id", "context_id", "variant", "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"), F.first("boost").alias("boost"))
        w = per.withColumn("w", (1 + F.ln("tf")) * F.col("idf") * F.col("boost"))
        norm = w.groupBy("query_id", "context_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, ["query_id", "context_id"]).select("query_id", "context_id", "variant", "term", "boost", (F.col("w") / F.col("norm")).alias("q"))

    def contributions(self) -> DataFrame:
        """query_id, context_id, support_id, term, contribution, boost: what each shared term adds to a similarity."""
        return self._terms().join(self.support_weights, ["context_id", "variant", "term"]).select("query_id", "context_id", "support_id", "term", (F.col("q") * F.col("w")).alias("contribution"), "boost")

    def evidence(self) -> DataFrame:
        """query_id, context_id, support_id, label, similarity of every support of every valid query, shared terms or not."""
        sims = self.contributions().groupBy("query_id", "context_id", "support_id").agg(F.sum("contribution").alias("similarity"))
        pairs = self.queries.filter("error is null").join(self.variants.select("context_id", "variant", "support_id", "label"), ["context_id", "variant"])
        return pairs.join(sims, ["query_id", "context_id", "support_id"], "left").select("query_id", "context_id", "support_id", "label", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))

    def nearest(self) -> DataFrame:
        """The evidence of the NEIGHBOURS most similar supports of each label (ties: the smaller id), with its place."""
        order = Window.partitionBy("query_id", "context_id", "label").orderBy(F.desc(F.round("similarity", 12)), "support_id")
        return self.evidence().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= NEIGHBOURS)

    def coverage(self) -> DataFrame:
        """query_id, context_id, query_words, matched_words, coverage: the share of distinct words that the supports hold."""
        ok = self.queries.filter("error is null")
        vocab = self.vocabulary.groupBy("context_id", "variant").agg(F.collect_set("term").alias("known"))
        both = ok.select("query_id", "context_id", "variant", F.array_distinct("ws").alias("ws")).join(vocab, ["context_id", "variant"])
        m = F.size(F.array_intersect("ws", "known"))
        return both.select("query_id", "context_id", F.size("ws").cast("bigint").alias("query_words"), m.cast("bigint").alias("matched_words"), F.when(F.size("ws") > 0, m / F.size("ws")).otherwise(0.0).alias("coverage"))

    def analyze(self) -> DataFrame:
        """query_id, context_id, violation_similarity, allowed_similarity, margin, coverage, strongest, state, purged, duplicates, error; the result is null where an error stands."""
        mean = lambda label: F.avg(F.when(F.col("label") == label, F.col("similarity")))
        near = self.nearest().groupBy("query_id", "context_id").agg(mean("violation").alias("violation_similarity"), mean("allowed").alias("allowed_similarity"), F.max("similarity").alias("strongest"))
        counts = self.variants.groupBy("context_id", "variant").agg(F.max("purged").alias("purged"), F.max("duplicates").alias("duplicates"))
        out = self.queries.drop("ws").join(near, ["query_id", "context_id"], "left").join(self.coverage(), ["query_id", "context_id"], "left").join(counts, ["context_id", "variant"], "left")
        out = out.withColumn("margin", F.col("violation_similarity") - F.col("allowed_similarity"))
        return out.select("query_id", "context_id", "violation_similarity", "allowed_similarity", "margin", "coverage", "strongest", F.when(F.col("error").isNull(), state("strongest", "coverage", "margin")).alias("state"), F.when(F.col("error").isNull(), F.col("purged")).alias("purged"), F.when(F.col("error").isNull(), F.col("duplicates")).alias("duplicates"), "error")


def state(strongest: str, coverage: str, margin: str) -> F.Column:
    """NO_EVIDENCE, BALANCED, VIOLATION_MATCH or ALLOWED_MATCH, tried in this order on values of 12 digits."""
    r = lambda c: F.round(c, 12)
    return F.when((r(strongest) < WEAK_SIMILARITY) | (r(coverage) < WEAK_COVERAGE), "NO_EVIDENCE").when(F.abs(r(margin)) < BALANCED_MARGIN, "BALANCED").when(r(margin) > 0, "VIOLATION_MATCH").otherwise("ALLOWED_MATCH")


def decision(state_: F.Column) -> F.Column:
    return F.when(state_ == "VIOLATION_MATCH", "violation").when(state_ == "ALLOWED_MATCH", "allowed").otherwise("abstain")


def compare(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query (query_id, text) against every context; an error stays with its context. Contexts must be few."""
    n = contexts.count()
    if n > 1000:
        raise ValueError(f"{n} contexts are too many to compare with every query")
    ids = contexts.select(F.col("id").alias("context_id"))
    return Engine(contexts, queries.crossJoin(F.broadcast(ids))).analyze()


def marked_tokens(text: F.Column, terms: F.Column) -> F.Column:
    """The words of a text with a flag: whether the word occurs in the contributing terms."""
    return F.transform(words(text), lambda w: F.struct(w.alias("word"), F.array_contains(terms, w).alias("marked")))


__all__ = ["Engine", "compare", "context_errors", "decision", "marked_tokens", "nfkc", "state", "supports", "variants", "with_bigrams"]
