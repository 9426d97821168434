"""The registered queries of the core operators, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moorline.functions import numeric, text
from moorline.operators import audit, challenge, contracts, events, lexical, metrics, model, prompts, scan, splits, support, tfidf
from moorline.session import shared_dir, table
from moorline.streaming import log as streams

T = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, T] = {}
BY = ["model", "protocol"]


def query(f: T) -> T:
    REGISTRY[f.__name__] = f
    return f


def r6(c: str | Column) -> Column:
    """A double to six digits, so that the order of summation does not show."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# ---- keys, contracts, audit


@query
def normalize_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train").select("row_id", text.normalize("body").alias("body_key"))


@query
def canonical_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train").select("row_id", text.canonical(F.col("body")).alias("body_key"))


@query
def content_digest(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train").select("row_id", F.sha2("body", 256).alias("sha256"))


@query
def fingerprint_fnv1a(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train").select("row_id", text.fnv1a(F.col("body")).alias("fingerprint"))


@query
def escaped_bodies(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train").select("row_id", text.escaped_html(F.col("body")).alias("escaped"), big(F.size(text.lines(F.col("body")))).alias("lines"))


@query
def contract_violations(s: SparkSession, d: str) -> DataFrame:
    of = lambda name, labelled: contracts.violations(table(s, d, name), labelled).select(F.lit(name).alias("table_name"), "check", big("violations").alias("violations"))
    return of("train", True).unionByName(of("test", False))


@query
def submission_alignment(s: SparkSession, d: str) -> DataFrame:
    """The sample's and the test's ids rise with their place, so the id itself stands for the order here."""
    test = table(s, d, "test").select("row_id", F.lit(0.5).alias("rule_violation"), F.col("row_id").alias("place"))
    sample = table(s, d, "sample_submission").withColumn("place", F.col("row_id"))
    return contracts.submission_violations(sample, test, "place").select("check", big("violations").alias("violations"))


@query
def shared_ids(s: SparkSession, d: str) -> DataFrame:
    return contracts.shared_ids(table(s, d, "train"), table(s, d, "test")).agg(F.count("*").alias("shared"))


@query
def audit_summary(s: SparkSession, d: str) -> DataFrame:
    a = audit.audit(table(s, d, "train"), table(s, d, "test"))
    return a.select("train_rows", "test_rows", big("duplicate_bodies").alias("duplicate_bodies"), "body_overlap", r6("prevalence").alias("prevalence"), big(F.size("train_rules")).alias("train_rules"), big(F.size("test_rules")).alias("test_rules"))


@query
def audit_by_rule(s: SparkSession, d: str) -> DataFrame:
    return audit.by_rule(table(s, d, "train")).select("rule", "rows", r6("prevalence").alias("prevalence"))


@query
def duplicate_bodies(s: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_flags(table(s, d, "train"))


@query
def train_test_overlap(s: SparkSession, d: str) -> DataFrame:
    return audit.body_overlap(table(s, d, "train"), table(s, d, "test")).select(F.col("key").alias("body_key"))


# ---- support construction, splits


def _forbidden(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "test").select(text.normalize("body").alias("body")).filter("body is not null")


def _marked(s: SparkSession, d: str) -> DataFrame:
    return support.classes(support.candidates(table(s, d, "train"), table(s, d, "test")), _forbidden(s, d))


@query
def support_pairs(s: SparkSession, d: str) -> DataFrame:
    return _marked(s, d).filter("status = 'retained'").select("body", "rule", "rule_violation", "source", "normalized_body", "normalized_rule")


@query
def support_audit(s: SparkSession, d: str) -> DataFrame:
    a = support.support_audit(_marked(s, d))
    return a.select("candidate_occurrences", "forbidden_text_occurrences", "conflicting_pairs", "conflicting_occurrences", "duplicate_occurrences", "retained_pairs", *(F.coalesce(F.col("by_source")[x], F.lit(0)).alias(x) for x in ("available_support", "train_body", "train_support")))


@query
def support_invariants(s: SparkSession, d: str) -> DataFrame:
    """Whether the counters of the support audit add up to all candidates, and these to all texts there are."""
    return support.audit_holds(table(s, d, "train"), table(s, d, "test"), support.support_audit(_marked(s, d)))


@query
def adaptation_repeats(s: SparkSession, d: str) -> DataFrame:
    train, test = table(s, d, "train"), table(s, d, "test")
    p = support.repeats(support.support_pairs(train, test), train)
    return p.groupBy("normalized_rule", "repeat").agg(F.count("*").alias("pairs"), F.sum("repeat").alias("occurrences")).select("normalized_rule", big("repeat").alias("repeat"), "pairs", "occurrences")


@query
def new_rules(s: SparkSession, d: str) -> DataFrame:
    return support.new_rules(table(s, d, "train"), table(s, d, "test"))


@query
def replicated_rows(s: SparkSession, d: str) -> DataFrame:
    train, test = table(s, d, "train"), table(s, d, "test")
    return support.replicated(support.repeats(support.support_pairs(train, test), train)).groupBy("rule_violation").agg(F.count("*").alias("rows"))


@query
def heldout_purge(s: SparkSession, d: str) -> DataFrame:
    return splits.heldout_counts(table(s, d, "train"))


@query
def purged_rows(s: SparkSession, d: str) -> DataFrame:
    return splits.heldout_purged(table(s, d, "train"))


@query
def seen_group_folds(s: SparkSession, d: str) -> DataFrame:
    return splits.seen_folds(table(s, d, "train")).select("row_id", big("fold").alias("fold"))


@query
def novel_queries(s: SparkSession, d: str) -> DataFrame:
    return splits.novel_queries(table(s, d, "train")).select("row_id", "rule")


@query
def study_counts(s: SparkSession, d: str) -> DataFrame:
    return splits.study_counts(table(s, d, "train"))


@query
def study_audit(s: SparkSession, d: str) -> DataFrame:
    """Training pairs, those of the new rule and the occurrences in an epoch, of the study of every rule by normalised text."""
    return splits.study_audit(table(s, d, "train"))


@query
def epoch_order(s: SparkSession, d: str) -> DataFrame:
    return splits.epoch_order(table(s, d, "train"), "row_id", 2025, 1).select("row_id", big("place").alias("place"))


STUDY_RULE = "No spoilers: do not reveal important details of a story without a warning."


@query
def study_training(s: SparkSession, d: str) -> DataFrame:
    """The training pairs of the study that leaves STUDY_RULE out."""
    return splits.study_fold(table(s, d, "train"), STUDY_RULE)[0].select("body", "rule", "rule_violation", big("repeat").alias("repeat"))


@query
def study_training_all(s: SparkSession, d: str) -> DataFrame:
    """The training pairs of the studies that leave each rule out, in all its spellings of one normalised text."""
    return splits.study_folds(table(s, d, "train")).select("fold_rule", "body", "rule", "rule_violation", big("repeat").alias("repeat"))


# ---- TF-IDF


@query
def lexical_terms(s: SparkSession, d: str) -> DataFrame:
    """Terms of the lexical engine over all bodies: occurrences, documents, IDF."""
    train = table(s, d, "train").filter("body is not null")
    tf = train.select("row_id", F.explode(text.lexical_terms(F.col("body"))).alias("term")).groupBy("row_id", "term").agg(F.count("*").alias("tf"))
    of = tf.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))
    return of.withColumn("idf", r6(F.ln((F.lit(1.0) + train.count()) / (F.col("documents") + 1.0)) + 1))


def _control(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents of every cell, and their vocabulary."""
    train = table(s, d, "train")
    docs = tfidf.gathered(train)
    return docs, tfidf.terms_of(train, docs)


@query
def vocabulary_top(s: SparkSession, d: str) -> DataFrame:
    return _control(s, d)[1].select("term", F.col("n").alias("occurrences"), F.col("df").alias("documents"), r6("idf").alias("idf"))


@query
def tfidf_documents(s: SparkSession, d: str) -> DataFrame:
    docs, terms = _control(s, d)
    return tfidf.document_sums(docs, tfidf.Vocabulary(terms)).select("row_id", "field", "terms", r6("greatest").alias("greatest"), r6("total").alias("total"))


@query
def context_similarities(s: SparkSession, d: str) -> DataFrame:
    docs, terms = _control(s, d)
    out = tfidf.context_similarities(docs, tfidf.Vocabulary(terms), table(s, d, "train"))
    return out.select("row_id", *(r6(c).alias(c) for c in out.columns[1:]))


# ---- the lexical engine


def _contexts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "policies").select(F.col("policy_id").alias("id"), "policy_name", "rule", "violation", "allowed")


def _cases(s: SparkSession, d: str, name: str) -> DataFrame:
    """query_id, context_id, text of the rows whose rule is a policy's."""
    c = _contexts(s, d).select(F.col("id").alias("context_id"), text.canonical(F.col("rule")).alias("k"))
    rows = table(s, d, name).select(F.col("row_id").alias("query_id"), F.col("body").alias("text"), text.canonical(F.col("rule")).alias("k"))
    return rows.join(c, "k").drop("k")


def _engine(s: SparkSession, d: str, name: str = "test") -> lexical.Engine:
    return lexical.Engine(_contexts(s, d), _cases(s, d, name))


@query
def lexical_margin(s: SparkSession, d: str) -> DataFrame:
    """Every test comment against the policy of its own rule: similarities, margin, coverage, state."""
    a = _engine(s, d).analyze()
    return a.select("query_id", "context_id", r6("violation_similarity").alias("violation_similarity"), r6("allowed_similarity").alias("allowed_similarity"), r6("margin").alias("margin"), r6("coverage").alias("coverage"), "state", F.coalesce(big("purged"), F.lit(0)).alias("purged"), F.coalesce(big("duplicates"), F.lit(0)).alias("duplicates"), F.col("error").isNotNull().alias("failed"))


@query
def lexical_evidence(s: SparkSession, d: str) -> DataFrame:
    return _engine(s, d).nearest().select("query_id", "context_id", "label", big("place").alias("place"), "support_id", r6("similarity").alias("similarity"))


@query
def lexical_contributions(s: SparkSession, d: str) -> DataFrame:
    return _engine(s, d).contributions().select("query_id", "context_id", "support_id", "term", r6("contribution").alias("contribution"), F.col("boost"))


@query
def query_coverage(s: SparkSession, d: str) -> DataFrame:
    return _engine(s, d).coverage().select("query_id", "context_id", "query_words", "matched_words", r6("coverage").alias("coverage"))


@query
def policy_compare(s: SparkSession, d: str) -> DataFrame:
    """Every test comment against every policy, counted by policy and state."""
    q = table(s, d, "test").select(F.col("row_id").alias("query_id"), F.col("body").alias("text"))
    a = lexical.compare(_contexts(s, d), q)
    return a.groupBy("context_id", F.coalesce("state", F.lit("ERROR")).alias("state")).agg(F.count("*").alias("comments"), r6(F.avg("margin")).alias("mean_margin"), r6(F.avg("coverage")).alias("mean_coverage"))


@query
def challenge_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    """The engine's decisions on labelled comments against their labels: in all, by policy and by community, of which one may be null."""
    a = _engine(s, d, "train").analyze().filter("error is null")
    t = table(s, d, "train").select(F.col("row_id").alias("query_id"), F.lower(F.trim("subreddit")).alias("slice"), F.when(F.col("rule_violation") == 1, "violation").otherwise("allowed").alias("expected"))
    rows = a.join(t, "query_id").select(F.col("context_id").alias("policy"), "slice", "expected", lexical.decision(F.col("state")).alias("decision"))
    out = challenge.summaries(rows, ["slice", "policy"])
    return out.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


# ---- metrics


def _scored(s: SparkSession, d: str) -> DataFrame:
    return metrics.clean(table(s, d, "oof"))


@query
def per_rule_auc(s: SparkSession, d: str) -> DataFrame:
    return metrics.auc(_scored(s, d), [*BY, "rule"]).select(*BY, "rule", r6("auc").alias("auc"))


@query
def macro_auc(s: SparkSession, d: str) -> DataFrame:
    return metrics.macro_auc(_scored(s, d), BY).select(*BY, r6("macro_auc").alias("macro_auc"))


@query
def pooled_auc(s: SparkSession, d: str) -> DataFrame:
    return metrics.auc(_scored(s, d), BY).select(*BY, r6("auc").alias("auc"))


@query
def average_precision(s: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_scored(s, d), BY).select(*BY, r6("average_precision").alias("average_precision"))


@query
def pointwise_metrics(s: SparkSession, d: str) -> DataFrame:
    m = metrics.pointwise(_scored(s, d), BY)
    return m.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes))


@query
def ece10(s: SparkSession, d: str) -> DataFrame:
    return metrics.ece(_scored(s, d), BY).select(*BY, r6("ece").alias("ece"))


@query
def calibration_table(s: SparkSession, d: str) -> DataFrame:
    c = metrics.calibration(_scored(s, d), BY)
    return c.select(*BY, big("bin").alias("bin"), r6("mean_probability").alias("mean_probability"), r6("observed_rate").alias("observed_rate"), F.col("count").alias("rows"))


@query
def metric_record(s: SparkSession, d: str) -> DataFrame:
    """All metrics of each cell as one JSON record."""
    return metrics.record(_scored(s, d), BY).select(*BY, F.to_json("metrics").alias("metrics"))


@query
def error_review(s: SparkSession, d: str) -> DataFrame:
    """The error of every prediction, the largest first."""
    out = metrics.error_review(_scored(s, d).groupBy("row_id", *BY).agg(F.max("rule_violation").alias("rule_violation"), F.max("probability").alias("probability")))
    return out.select("row_id", *BY, r6("absolute_error").alias("absolute_error"))


@query
def policy_ranks(s: SparkSession, d: str) -> DataFrame:
    return metrics.policy_ranks(_scored(s, d), [*BY, "rule"]).select("row_id", *BY, "rule", "fold", r6("probability").alias("probability"), r6("rank").alias("rank"))


@query
def rank_blend(s: SparkSession, d: str) -> DataFrame:
    """Ranks of one component of the vectors, of a second and of a third within each label, blended 0.5, 0.25, 0.25."""
    v = table(s, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(3)))
    ranks = [(metrics.policy_ranks(v, ["label"], f"e{k}"), w) for k, w in enumerate((0.5, 0.25, 0.25))]
    return metrics.blend(ranks, ["vec_id"]).select("vec_id", r6("blended").alias("blended"))


@query
def oof_coverage(s: SparkSession, d: str) -> DataFrame:
    return contracts.coverage(table(s, d, "oof"), table(s, d, "train"))


@query
def grid_coverage(s: SparkSession, d: str) -> DataFrame:
    """Cells that a plan with one more protocol would miss, and cells beside it."""
    return contracts.grid_gaps(table(s, d, "oof"), ["comment_only", "rule_examples"], ["seen_rule", "new_rule"])


@query
def metric_differences(s: SparkSession, d: str) -> DataFrame:
    """Numbers in which each fold of a cell differs from the cell, beyond the tolerance of a review."""
    scored = _scored(s, d)
    long = lambda df, keys: df.unpivot(keys, ["log_loss", "brier", "precision", "recall", "f1"], "path", "value")
    by = [*BY, "fold"]
    fold = long(metrics.pointwise(scored, by), by)
    cell = long(metrics.pointwise(scored, BY), BY).join(fold.select(*by).distinct(), BY)
    out = metrics.differing(cell, fold, by)
    return out.select(*BY, "fold", "path", r6("expected").alias("expected"), r6("actual").alias("actual"))


# ---- prompts, logits, vectors, batches


@query
def head_tail_truncate(s: SparkSession, d: str) -> DataFrame:
    t = prompts.tokens(F.col("body"))
    return table(s, d, "train").select("row_id", big(F.size(t)).alias("tokens"), F.array_join(text.head_tail(t, 40), " ").alias("kept")).filter("tokens >= 0")


@query
def prompt_budget(s: SparkSession, d: str) -> DataFrame:
    return prompts.truncations(table(s, d, "train")).select("field", "truncated", "longest")


@query
def prompt_variants(s: SparkSession, d: str) -> DataFrame:
    return prompts.prompts(table(s, d, "test"))


@query
def logit_scores(s: SparkSession, d: str) -> DataFrame:
    v = prompts.answer_scores(F.col("embedding"), [0, 1, 2], [3, 4, 5])
    return table(s, d, "embeddings").select("vec_id", *(r6(c).alias(n) for n, c in v.items()))


@query
def decision_loss(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", r6(prompts.decision_loss(F.col("embedding"), F.col("label"))).alias("loss"))


@query
def centroid_readout(s: SparkSession, d: str) -> DataFrame:
    return prompts.centroid_readout(table(s, d, "embeddings")).select("vec_id", "label", "predicted", r6("similarity").alias("similarity"))


@query
def score_batches(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "train").filter("body is not null")
    return prompts.length_batches(rows, "row_id", F.size(prompts.tokens(F.col("body")))).select("row_id", "n", "batch")


@query
def warmup_schedule(s: SparkSession, d: str) -> DataFrame:
    return s.range(1000).select(F.col("id").alias("step"), r6(numeric.warmup(F.col("id"), 1000, 0.1)).alias("factor"))


@query
def display_numbers(s: SparkSession, d: str) -> DataFrame:
    """Margins as they are shown: signed, as a place on a scale, coverage in whole percents."""
    a = _engine(s, d).analyze().filter("error is null")
    return a.select("query_id", numeric.signed3(F.round("margin", 3)).alias("margin"), F.round(numeric.marker(F.round("margin", 6)), 3).alias("marker"))


# ---- scans, events


@query
def publication_scan(s: SparkSession, d: str) -> DataFrame:
    return scan.findings(table(s, d, "train"), "row_id", "body").select("row_id", "finding", big("hits").alias("hits"))


@query
def asset_links(s: SparkSession, d: str) -> DataFrame:
    return scan.links(table(s, d, "train"), "row_id", "body")


@query
def stage_elapsed(s: SparkSession, d: str) -> DataFrame:
    return events.stage_elapsed(table(s, d, "run_log")).select("run_id", "stage", "events", "seconds", "failed")


@query
def event_since_start(s: SparkSession, d: str) -> DataFrame:
    return events.since_start(table(s, d, "run_log"))


@query
def event_window_counts(s: SparkSession, d: str) -> DataFrame:
    return events.window_counts(table(s, d, "run_log")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_name", "events", "late")


@query
def kept_last(s: SparkSession, d: str) -> DataFrame:
    """The last two log rows of each run and stage, as a retention of checkpoints keeps them."""
    return events.keep_last(table(s, d, "run_log"), ["run_id", "stage"], 2).select("run_id", "stage", "log_id")


@query
def latest_run(s: SparkSession, d: str) -> DataFrame:
    return events.latest_run(table(s, d, "run_log")).select("stage", "run_id")


@query
def click_windows(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy(F.window("ts", "60 minutes").alias("w"), "event_type").agg(F.count("*").alias("events"), r6(F.sum("value")).alias("value"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "value")


@query
def streamed_windows(s: SparkSession, d: str) -> DataFrame:
    """The run log as a stream of what is there: windows of an hour per event, the last ones too; repeats and rows later than a day left out."""
    folder = f"{d}/run_log.parquet"
    out = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    stream = s.readStream.schema(table(s, d, "run_log").schema).option("recursiveFileLookup", True).parquet(folder if not folder.endswith(".parquet") or _is_dir(folder) else f"{d}/run_log*.parquet")
    stream = streams.closed(stream, "logged_at", f"{out}/end-{uuid.uuid4().hex}", key="log_id")
    streams.replay(streams.windowed(stream, "logged_at", "event_name", key="log_id"), f"{out}/rows", f"{out}/state").awaitTermination()
    return s.read.schema("window_start timestamp, event_name string, events bigint").parquet(f"{out}/rows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _is_dir(path: str) -> bool:
    import os

    return os.path.isdir(path)


# ---- the linear control


def _seen(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    train = table(s, d, "train").filter("body is not null and trim(body) <> ''")
    of = splits.seen_folds(train)
    ks = s.range(3).select(F.col("id").cast("int").alias("k"))
    roles = of.crossJoin(F.broadcast(ks)).select(F.col("k").alias("fold"), "row_id", F.when(F.col("fold") == F.col("k"), "valid").otherwise("train").alias("role"))  # three folds
    return train, roles


@query
def lr_out_of_fold(s: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of the control on bodies alone, three folds of unsplit bodies."""
    return model.out_of_fold(*_seen(s, d), context=False)


@query
def lr_coefficients(s: SparkSession, d: str) -> DataFrame:
    """Coefficients of the control with context similarities on all rows."""
    return model.fit(_seen(s, d)[0], context=True).coefficients()


def queries() -> dict[str, T]:
    return dict(REGISTRY)


__all__ = ["REGISTRY", "Window", "queries"]
