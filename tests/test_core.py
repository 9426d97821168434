import math
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from moorline.functions import numeric, text
from moorline.operators import audit, challenge, contracts, events, lexical, match, metrics, model, prompts, scan, splits, support, tfidf
from moorline.sources import tables
from moorline.sources.store import Store

ROWS = "row_id bigint, body string, rule string, subreddit string, positive_example_1 string, positive_example_2 string, negative_example_1 string, negative_example_2 string, rule_violation int"


def frame(spark, n=12, rules=("No ads", "Be kind")):
    out = []
    for k, rule in enumerate(rules):
        out += [(k * 100 + i, f"Body {k} {i % (n - 1)} text", rule, f"c{i % 3}", f"bad {k} one", f"bad {k} two", f"good {k} one", f"good {k} two", i % 2) for i in range(n)]
    return spark.createDataFrame(out, ROWS)


def one(df):
    return df.first().asDict()


def test_text_keys(spark):
    df = spark.createDataFrame([("  ＡＢＣ　straße  x ",), ("It’s  it's, ok!",), (None,), ("",), ("a" * 50_000,), ("ok 😂 é",)], "t string")
    got = [tuple(r) for r in df.select(text.normalize("t"), text.canonical(F.col("t"))).collect()]
    assert got[0] == ("abc strasse x", "abc straße x") and got[1] == ("it’s it's, ok!", "it’s it's ok")
    assert got[2] == (None, None) and got[3] == ("", "") and len(got[4][0]) == 50_000 and got[5] == ("ok 😂 é", "ok é")


def test_fnv1a_over_utf16(spark):
    def plain(s):
        h = 2166136261
        b = s.encode("utf-16-be")
        for i in range(0, len(b), 2):
            h = ((h ^ int.from_bytes(b[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "a", "héllo wörld", "😂 ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.fnv1a(F.col("t")).alias("h"))
    assert [r.h for r in df.collect()] == [plain(t) for t in texts]


def test_terms_and_truncation(spark):
    df = spark.createDataFrame([("the cat the dog sat",), ("the",), ("",)], "t string")
    assert [r[0] for r in df.select(text.lexical_terms(F.col("t"))).collect()] == [["cat", "dog", "sat", "cat dog", "dog sat"], [], []]
    ids = spark.createDataFrame([([str(i) for i in range(10)],)], "a array<string>").select(text.head_tail(F.col("a"), 4)).first()[0]
    assert ids == ["0", "1", "2", "9"]


def test_numbers(spark):
    r = spark.range(1).select(numeric.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0))).alias("l"), numeric.sigmoid(F.lit(-800.0)).alias("s"), numeric.rate(F.lit(1), F.lit(0)).alias("n"), numeric.rate(F.lit(1), F.lit(3)).alias("t"), numeric.signed3(F.lit(-0.5)).alias("m")).first()
    assert math.isclose(r.l, 1000 + math.log(2)) and r.s == 0.0 and r.n is None and r.t == 0.333333333333 and r.m == "−0.500"


def test_contracts(spark):
    good = frame(spark)
    contracts.check_frame(good, True)
    contracts.check_frame(good.drop("rule_violation").withColumn("extra", F.lit(1)), False)
    with pytest.raises(ValueError, match="must not hold"):
        contracts.check_frame(good, False)
    with pytest.raises(ValueError, match="missing columns"):
        contracts.check_frame(good.drop("rule"), True)
    with pytest.raises(ValueError, match="row_id_repeated"):
        contracts.check_frame(good.union(good.limit(1)), True)
    with pytest.raises(ValueError, match="body_blank"):
        contracts.check_frame(good.withColumn("body", F.lit("  ")), True)
    with pytest.raises(ValueError, match="label_invalid"):
        contracts.check_frame(good.withColumn("rule_violation", F.lit(2)), True)
    with pytest.raises(ValueError, match="empty"):
        contracts.check_frame(good.limit(0), True)


def test_submission(spark):
    sample = spark.createDataFrame([(1, 0.5), (2, 0.5)], "row_id bigint, rule_violation double").coalesce(1)
    contracts.check_submission(sample, sample)
    for bad in ([(2, 0.5), (1, 0.5)], [(1, float("nan")), (2, 0.5)], [(1, 1.5), (2, 0.5)], [(1, 0.5)]):
        with pytest.raises(ValueError):
            contracts.check_submission(spark.createDataFrame(bad, sample.schema).coalesce(1), sample)


def test_audit_and_duplicates(spark):
    t = frame(spark)
    a = one(audit.audit(t, t.drop("rule_violation")))
    assert (a["train_rows"], a["duplicate_bodies"], a["body_overlap"], a["prevalence"]) == (24, 2, 22, 0.5)
    assert audit.duplicate_flags(t).filter("duplicate").count() == 2


def test_support_counters_and_order(spark):
    t = frame(spark)
    clash = t.limit(3).withColumn("body", F.col("negative_example_1")).withColumn("rule_violation", F.lit(1)).withColumn("row_id", F.col("row_id") + 1000)
    t = t.union(clash)
    test = t.drop("rule_violation")
    bad = spark.createDataFrame([("body 0 3 text",)], "b string")
    marked = support.classes(support.candidates(t, test), bad)
    a = one(support.support_audit(marked))
    assert a["candidate_occurrences"] == 5 * 27 + 4 * 27 == a["forbidden_text_occurrences"] + a["conflicting_occurrences"] + a["duplicate_occurrences"] + a["retained_pairs"]
    assert a["forbidden_text_occurrences"] == 1 and a["conflicting_pairs"] == 3 and sum(a["by_source"].values()) == a["retained_pairs"]
    rows = lambda m: {tuple(r) for r in m.filter("status = 'retained'").select("normalized_rule", "normalized_body", "source").collect()}
    assert rows(marked) == rows(support.classes(support.candidates(t.orderBy(F.desc("row_id")), test), bad))
    assert support.audit_holds(t, test, support.support_audit(marked)).first().holds
    rep = support.repeats(support.support_pairs(t.filter("rule = 'No ads'"), test), t.filter("rule = 'No ads'"))
    assert {tuple(r) for r in rep.select("rule", "repeat").distinct().collect()} == {("No ads", 1), ("Be kind", 2)}


def test_splits(spark):
    t = frame(spark, 30)
    folds = splits.seen_folds(t)
    assert folds.count() == 60 and folds.groupBy("row_id").count().filter("count > 1").count() == 0
    keyed = folds.join(t.select("row_id", text.normalize("body").alias("k")), "row_id")
    assert keyed.groupBy("k").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert {tuple(r) for r in folds.collect()} == {tuple(r) for r in splits.seen_folds(t.orderBy(F.rand(1))).collect()}
    leak = t.withColumn("positive_example_1", F.when(F.col("row_id") == 5, F.lit("BODY 1 4 Text")).otherwise(F.col("positive_example_1")))
    assert {tuple(r) for r in splits.heldout_purged(leak).collect()} == {("Be kind", 5)}
    roles = splits.heldout_roles(leak)
    assert {r.row_id for r in splits.purge(leak, roles.drop("fold_rule")).collect()} == {5}
    with pytest.raises(ValueError):
        splits.heldout_roles(t.filter("rule = 'No ads'"))
    training, queries = splits.study_fold(t, "No ads")
    support.check_study(training, queries)
    with pytest.raises(ValueError, match="evaluation text"):
        support.check_study(training.union(queries.limit(1).select("body", "rule", F.lit(1), F.lit(1))), queries)


def test_study_counters_and_orders(spark):
    t = frame(spark, 9)
    made = {r.fold_rule: (r.n, r.own, r.e) for r in splits.study_folds(t).groupBy("fold_rule").agg(F.count("*").alias("n"), F.count_if(F.col("repeat") == 2).alias("own"), F.sum("repeat").alias("e")).collect()}
    assert {r.fold_rule: tuple(r)[1:] for r in splits.study_audit(t).collect()} == made and len(made) == 2
    order = {r.row_id: r.place for r in splits.epoch_order(t, "row_id", 1, 0).collect()}
    assert sorted(order.values()) == list(range(18)) and order == {r.row_id: r.place for r in splits.epoch_order(t.orderBy(F.rand(3)), "row_id", 1, 0).collect()}
    assert order != {r.row_id: r.place for r in splits.epoch_order(t, "row_id", 1, 1).collect()}


def test_structural_match(spark):
    of = lambda x: match.flattened(spark.createDataFrame([(1, x), (2, None)], "id int, j string"), ["id"], "j")
    a = of('{"n": 1, "p": 0.5, "s": "x", "l": [1, 2], "b": true, "z": null}')
    assert match.differences(a, of('{"n": 1, "p": 0.5000000000001, "s": "x", "l": [1, 2], "b": true, "z": null}'), ["id"]).isEmpty()
    got = {r.path: r.problem for r in match.differences(a, of('{"n": 2, "p": 0.6, "s": "y", "l": [1], "b": 1, "extra": 0}'), ["id"]).collect()}
    assert got == {"/n": "value", "/p": "value", "/s": "value", "/l": "type", "/l/1": "missing", "/b": "type", "/z": "missing", "/extra": "unexpected"}
    assert [r.type for r in of("{broken").collect()] == ["invalid"]


def test_study_of_every_rule(spark, tmp_path):
    from moorline.plans import queries

    t = frame(spark, 12, ("No ads", "Be kind", "No spam"))
    t.withColumn("body", F.when(F.col("row_id") == 105, F.lit("body 0 4 TEXT")).otherwise(F.col("body"))).write.parquet(str(tmp_path / "train.parquet"))
    plain = spark.read.parquet(str(tmp_path / "train.parquet"))
    want = {(rule.lower(), *r) for rule in ("No ads", "Be kind", "No spam") for r in splits.study_fold(plain, rule)[0].collect()}
    assert {tuple(r) for r in splits.study_folds(plain).collect()} == want
    respelled = plain.withColumn("rule", F.when(F.col("row_id") == 3, F.lit("NO  ads")).otherwise(F.col("rule")))
    respelled.write.parquet(str(tmp_path / "b" / "train.parquet"))
    got = queries.queries()["study_training_all"](spark, str(tmp_path / "b")).filter("fold_rule = 'no ads'").collect()
    assert not any(r.body.startswith("Body 0") for r in got) and {r.fold_rule for r in got} == {"no ads"}



def test_study_of_every_rule_shuffles_pairs_once(spark):
    t = frame(spark, 12, ("No ads", "Be kind", "No spam"))
    shared = F.when(F.col("row_id").isin(3, 105, 207), F.lit("One text")).when(F.col("row_id").isin(4, 106), F.col("positive_example_1")).otherwise(F.col("body"))
    t = t.withColumn("body", shared).withColumn("rule", F.when(F.col("row_id") == 207, F.lit(None)).otherwise(F.col("rule")))
    made = splits.study_folds(t)
    want = {(rule.lower(), *r) for rule in ("No ads", "Be kind", "No spam") for r in splits.study_fold(t, rule)[0].collect()}
    assert {tuple(r) for r in made.collect()} == want
    assert "hashpartitioning(normalized_body" not in made._jdf.queryExecution().toString()


def test_study_of_every_rule_is_written_in_few_bytes(spark, tmp_path):
    """A text that stands in 119 folds is not written 119 times, also where the texts exceed a Parquet dictionary."""
    import hashlib

    text = lambda i: " ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(9))
    rows = [(i, text(i), f"rule {i % 120}", i % 2, text(-i) if i % 50 == 0 else None) for i in range(1, 5001)]
    t = spark.createDataFrame(rows, "row_id bigint, body string, rule string, rule_violation int, positive_example_1 string")
    t = t.withColumns({c: F.lit(None).cast("string") for c in splits.EXAMPLES if c != "positive_example_1"}).repartition(1)
    splits.study_folds(t).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 5000 * 119 + 100 * 120 == out.distinct().count() and out.filter("repeat = 2").count() == 100
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 2 * sum(len(r[1]) for r in rows)


def scored(spark, y, p, rules):
    return spark.createDataFrame([(i, r, a, float(b)) for i, (a, b, r) in enumerate(zip(y, p, rules, strict=True))], "row_id bigint, rule string, rule_violation int, probability double")


def test_metrics_golden(spark):
    s = scored(spark, [0, 1, 0, 1], [0.7, 0.8, 0.1, 0.2], "aabb")
    assert metrics.macro_auc(s, []).first()[0] == 1.0 and metrics.auc(s, []).first()[0] == 0.75
    assert metrics.macro_auc(scored(spark, [0, 1, 0, 1, 0, 1], [0.1, 0.9, 0.1, 0.9, 0.9, 0.1], "aaaabb"), []).first()[0] == 0.5
    with pytest.raises(ValueError, match="single-class"):
        metrics.check_inputs(scored(spark, [0, 1], [0.2, 0.7], "ab"))
    for bad in ([0.1, float("nan")], [0.1, 1.2]):
        with pytest.raises(ValueError, match="invalid"):
            metrics.check_inputs(scored(spark, [0, 1], bad, "rr"))


def test_metrics_against_brute_force(spark):
    r = random.Random(1)
    y, p = [r.randint(0, 1) for _ in range(300)], [round(r.random(), 2) for _ in range(300)]
    s = scored(spark, y, p, ["r"] * 300)
    pos, neg = [b for a, b in zip(y, p, strict=True) if a], [b for a, b in zip(y, p, strict=True) if not a]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.auc(s, ["rule"]).first().auc, auc)
    ap, before = 0.0, 0
    for t in sorted(set(p), reverse=True):
        tp = sum(a for a, b in zip(y, p, strict=True) if b >= t)
        ap += (tp - before) / len(pos) * tp / sum(b >= t for b in p)
        before = tp
    assert math.isclose(metrics.average_precision(s, []).first()[0], ap)
    rec = metrics.record(s.withColumn("model", F.lit("m")), ["model"]).first().metrics
    assert math.isclose(rec.pooled_auc, auc) and rec.confusion_matrix_at_0_5[1][1] == sum(a and b >= 0.5 for a, b in zip(y, p, strict=True))


def test_metric_differences_of_every_fold(spark, tmp_path):
    from moorline.plans import queries

    rows = [(i, "r", i % 2, (0.2, 0.8)[i % 2] if i < 8 else (0.9, 0.4)[i % 2], i // 4, "m", "p") for i in range(12)]
    spark.createDataFrame(rows, "row_id bigint, rule string, rule_violation int, probability double, fold int, model string, protocol string").write.parquet(str(tmp_path / "oof.parquet"))
    got = {(r.fold, r.path): r for r in queries.metric_differences(spark, str(tmp_path)).collect()}
    assert set(got) == {(f, p) for f in range(3) for p in ("log_loss", "brier", "precision", "recall", "f1")}
    assert all(got[2, p].actual == 0 for p in ("precision", "recall", "f1")) and got[1, "recall"].actual == 1 and math.isclose(got[1, "recall"].expected, 2 / 3, abs_tol=1e-6)


def test_ranks(spark):
    v = spark.createDataFrame([(0, 100.0, "a"), (1, 101.0, "a"), (2, 200.0, "b"), (3, -100.0, "a"), (4, 200.0, "b")], "row_id int, m double, rule string")
    got = {r.row_id: r.rank for r in metrics.policy_ranks(v, ["rule"], "m").collect()}
    assert got[1] > got[0] > got[3] and got[2] == got[4] == 0.5
    with pytest.raises(ValueError):
        metrics.check_finite(v.withColumn("m", F.lit(float("nan"))), "m")


CONTEXTS = "id string, rule string, violation array<string>, allowed array<string>"


def lexical_rows(spark, contexts, query):
    q = spark.createDataFrame([(1, query)], "query_id bigint, text string")
    return {r.context_id: r for r in lexical.compare(spark.createDataFrame(contexts, CONTEXTS), q).collect()}


def test_lexical_engine(spark):
    base = ("p", "No shop links", ["buy from my shop now", "shop discount code today"], ["a calm garden walk", "quiet music evening"])
    got = lexical_rows(spark, [base, ("s", base[1], base[3], base[2]), ("d", base[1], [*base[2], "Buy from my SHOP now!"], base[3]), ("x", base[1], base[2], [base[2][0]]), ("e", base[1], [], base[3])], "visit my shop for a discount code")
    assert got["p"].state == "VIOLATION_MATCH" and math.isclose(got["p"].margin, -got["s"].margin) and math.isclose(got["p"].margin, got["d"].margin)
    assert got["d"].duplicates == 1 and got["x"].error == "conflicting labels" and got["e"].error == "invalid number of examples" and got["x"].margin is None
    copy = lexical_rows(spark, [base], "Shop discount CODE today")["p"]
    assert copy.purged == 1 and copy.error is None
    assert lexical_rows(spark, [base], "zebra quantum")["p"].state == "NO_EVIDENCE"
    assert lexical_rows(spark, [base], "  ")["p"].error == "invalid comment"


def test_challenge_levels(spark):
    rows = spark.createDataFrame([("a", "p", "allowed", "violation"), ("a", "q", "violation", "abstain"), ("b", "p", "abstain", "abstain")], "slice string, policy string, expected string, decision string")
    got = {(r.slice, r.policy): r for r in challenge.summaries(rows, ["slice", "policy"]).collect()}
    assert got[(None, None)].cases == 3 and got[(None, None)].false_violations == 1 and got[("b", None)].selective_agreement is None and got[(None, "q")].decision_coverage == 0.0
    cases = spark.createDataFrame([("ok-1", "s1", "p", "hi", "allowed"), ("Bad", "s1", "p", "hi", "allowed"), ("no-policy", "s1", "z", "hi", "allowed")], "id string, slice string, policy string, query string, expected string")
    assert {r.id for r in challenge.invalid_cases(cases, spark.createDataFrame([("p",)], "id string")).collect()} == {"Bad", "no-policy"}


def test_prompts_and_scores(spark):
    v = prompts.answer_scores(F.col("l"), [0, 1], [2, 3])
    r = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0, 8.0],)], "l array<float>").select(*(c.alias(n) for n, c in v.items())).first()
    assert r.probability == 0.5 and r.margin == 0.0 and r.mass < 0.01
    with pytest.raises(ValueError):
        prompts.check_groups([1], [1])
    t = frame(spark, 4).drop("rule_violation")
    p = prompts.prompts(t)
    swapped = t.withColumnRenamed("positive_example_1", "z").withColumnRenamed("positive_example_2", "positive_example_1").withColumnRenamed("z", "positive_example_2")
    assert p.count() == 24 and {tuple(x) for x in p.collect()} == {tuple(x) for x in prompts.prompts(swapped).collect()}
    b = prompts.length_batches(t, "row_id", F.length("body"), 3)
    assert b.groupBy("batch").count().filter("count > 3").count() == 0 and b.count() == 8


def test_tfidf_and_control(spark):
    t = frame(spark, 16).withColumn("body", F.when(F.col("rule_violation") == 1, F.concat(F.lit("buy discount offer number"), F.col("row_id").cast("string"))).otherwise(F.concat(F.lit("calm thoughtful topic item"), F.col("row_id").cast("string"))))
    docs = tfidf.cells(t)
    tf = tfidf.counts(docs)
    w = tfidf.weights(tf, tfidf.vocabulary(tf, docs.count()))
    norms = w.groupBy("row_id", "field").agg(F.sum(F.col("w") * F.col("w")).alias("n"))
    assert norms.filter(F.abs(F.col("n") - 1) > 1e-9).count() == 0
    fitted = model.fit(t, True)
    p = {r.row_id: r.probability for r in fitted.predict(t).collect()}
    y = {r.row_id: r.rule_violation for r in t.collect()}
    assert all((p[k] > 0.5) == (y[k] == 1) for k in y)
    assert fitted.coefficients().filter("feature = 'similarity_margin'").count() == 1


def odd_cells(spark):
    """Rows of which some share a row_id or have none, with empty and null cells and terms beyond ASCII."""
    t = frame(spark, 12).withColumn("row_id", F.when(F.col("row_id") % 5 == 0, F.lit(7)).when(F.col("row_id") == 3, F.lit(None)).otherwise(F.col("row_id")))
    return t.withColumn("body", F.when(F.col("row_id") == 1, None).when(F.col("row_id") == 2, F.lit("")).when(F.col("row_id") == 4, F.lit("Stra\u00dfe \u00c9 K\u00e9\u0663 don\u2019t x_y be KIND Be kind")).otherwise(F.col("body")))


def test_tfidf_documents_shuffle_no_terms(spark, tmp_path):
    from moorline.plans import queries

    odd_cells(spark).write.parquet(str(tmp_path / "train.parquet"))
    t = spark.read.parquet(str(tmp_path / "train.parquet"))
    docs = tfidf.cells(t)
    tf = tfidf.counts(docs)
    top = tfidf.vocabulary(tf, docs.count())
    assert {tuple(r) for r in queries.queries()["vocabulary_top"](spark, str(tmp_path)).collect()} == {(r.term, r.n, r.df, round(r.idf, 6)) for r in top.collect()}
    want = tfidf.weights(tf, top).groupBy("row_id", "field").agg(F.count("*"), F.round(F.max("w"), 6), F.round(F.sum("w"), 6))
    got = queries.queries()["tfidf_documents"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plain = queries.queries()["tfidf_documents"](spark, str(plain_table(frame(spark, 12), tmp_path / "plain")))
    assert "Exchange" not in plain._jdf.queryExecution().toString()  # neither terms nor documents are shuffled


def plain_table(df, at):
    df.write.parquet(str(at / "train.parquet"))
    return at


def test_control_is_at_its_optimum(spark):
    t = frame(spark, 40).withColumn("rule_violation", F.when(F.col("row_id") % 10 < 2, 0).otherwise(1)).withColumn("body", F.concat(F.lit("plain topic "), (F.col("row_id") % 7).cast("string"), F.when(F.col("rule_violation") == 1, F.lit(" buy now")).otherwise(F.lit(" thanks all"))))
    fitted = model.fit(t, True)
    docs = tfidf.gathered(t, tfidf.COLUMNS, F.col("rule_violation").cast("double"))
    rows = model.entries(docs, fitted.terms, True).collect()
    w = fitted.model.coefficients.toArray()
    g = w / (model.C * len(rows))
    for r in rows:
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(r.indices, r.values, strict=True))))
        for i, v in zip(r.indices, r.values, strict=True):
            g[i] += (p - r.labels[0]) * v / len(rows)
    assert abs(g).max() < 1e-4 and w[-1] > 0.01  # the constant's weight is fitted too


def test_context_similarities_join_no_terms(spark, tmp_path):
    from moorline.plans import queries

    odd_cells(spark).write.parquet(str(tmp_path / "train.parquet"))
    t = spark.read.parquet(str(tmp_path / "train.parquet"))
    docs = tfidf.cells(t)
    tf = tfidf.counts(docs)
    w = tfidf.weights(tf, tfidf.vocabulary(tf, docs.count()))
    body = w.filter("field = 'body'").select("row_id", "term", F.col("w").alias("b"))
    want = {(r.row_id, r.field): r.s for r in w.filter("field <> 'body'").join(body, ["row_id", "term"]).groupBy("row_id", "field").agg(F.sum(F.col("w") * F.col("b")).alias("s")).collect()}
    got = queries.queries()["context_similarities"](spark, str(tmp_path))
    rows = got.collect()
    assert sorted(str(r.row_id) for r in rows) == sorted(str(r.row_id) for r in t.select("row_id").collect())  # a row for each row
    assert all(abs(r[f"similarity_{c}"] - want.get((r.row_id, c), 0.0)) < 2e-6 for r in rows for c in tfidf.COLUMNS[1:])
    plain = queries.queries()["context_similarities"](spark, str(plain_table(frame(spark, 12), tmp_path / "plain")))
    assert "Exchange" not in plain._jdf.queryExecution().toString()


def test_scan(spark):
    df = spark.createDataFrame([(1, "password = 'abcdefghijkl123'"), (2, "see hxxps://a.b/c and <img src=//x.y>"), (3, None)], "id bigint, t string")
    assert {(r.id, r.finding) for r in scan.findings(df, "id", "t").collect()} == {(1, "secret"), (2, "link"), (2, "remote_asset")}
    assert scan.links(df, "id", "t").first().host == "a.b"
    files = spark.createDataFrame([("a/../b.js", 5), ("ok.html", 2_000_000), ("x.exe", 1)], "path string, bytes bigint")
    assert {r.problem for r in scan.folder_problems(files, (".js", ".html")).collect()} == {"path: a/../b.js", "size: ok.html", "suffix: x.exe", "too large"}


def test_events(spark):
    log = spark.createDataFrame([(1, "r", "2025-01-01 00:00:00", "2025-01-01 00:00:01", "fit", "start"), (1, "r", "2025-01-01 00:00:00", "2025-01-01 00:09:01", "fit", "start"), (2, "r", "2025-01-01 00:00:30", "2025-01-02 00:00:01", "fit", "finish"), (3, None, None, None, None, None)], "log_id bigint, run_id string, logged_at string, received_at string, stage string, event_name string")
    log = log.withColumn("logged_at", F.col("logged_at").cast("timestamp_ntz")).withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
    r = events.stage_elapsed(log).collect()
    assert len(r) == 1 and r[0].events == 2 and r[0].seconds == 30.0 and not r[0].failed
    assert {(x.event_name, x.late) for x in events.window_counts(log).collect()} == {("start", 0), ("finish", 1)}
    assert events.latest_run(log).first().run_id == "r"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi",\nplease', 0.5), (2, "null", 0.25)], "row_id bigint, body string, p double")
    Store(spark, str(tmp_path)).put_csv(df, ["row_id"], "x.csv")
    from pyspark.sql import types as T

    back = tables.read_csv(spark, str(tmp_path / "x.csv"), T.StructType([T.StructField("row_id", T.LongType()), T.StructField("body", T.StringType()), T.StructField("p", T.DoubleType())]))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path)).put_json({"a": float("nan")}, "n.json")
    assert not (tmp_path / "n.json").exists()


def test_synthetic_input_and_inventory(spark, tmp_path):
    tables.synthetic(spark, str(tmp_path))
    train, test, sample = tables.load(spark, str(tmp_path))
    assert (train.count(), test.count(), sample.count()) == (96, 8, 8)
    with pytest.raises(FileExistsError):
        tables.synthetic(spark, str(tmp_path))
    files = {r.path: r for r in tables.inventory(spark, str(tmp_path)).collect()}
    import hashlib

    data = (tmp_path / "SYNTHETIC.txt").read_bytes()
    assert files["SYNTHETIC.txt"].sha256 == hashlib.sha256(data).hexdigest() and files["SYNTHETIC.txt"].git_sha1 == hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


def test_stages(spark, tmp_path):
    from moorline import runtime

    log, calls = runtime.Log(Store(spark, str(tmp_path / "run"))), []
    act = lambda d: (calls.append(d), Store(spark, d).put("x", "a.txt"), spark.range(3).write.parquet(f"{d}/rows"))
    at = runtime.stage(log, "s", act)
    assert runtime.stage(log, "s", act) == at and len(calls) == 1 and runtime.checked(log.store, "s")[0] == at
    Store(spark, at).put("changed", "a.txt")
    with pytest.raises(ValueError, match="changed a.txt"):
        runtime.checked(log.store, "s")
    assert runtime.stage(log, "s", act) != at and len(calls) == 2 and runtime.checked(log.store, "s")
    with pytest.raises(ValueError):
        runtime.stage(log, "empty", lambda d: None)
    with pytest.raises(ZeroDivisionError):
        runtime.stage(log, "broken", lambda d: (Store(spark, d).put("x", "half.txt"), 1 / 0))
    assert runtime.committed(log.store, "broken") is None and runtime.stage(log, "broken", act)
    with runtime.watched(log, "slow", every=0.1):
        import time

        time.sleep(0.5)
    by = {(r.stage, r.event): r.n for r in log.table().groupBy("stage", "event").agg(F.count("*").alias("n")).collect()}
    assert by["s", "reused"] == 1 and by["s", "recomputing"] == 1 and by["empty", "failed"] == 1 and by["broken", "failed"] == 1 and by["slow", "heartbeat"] >= 2 and by["slow", "completed"] == 1
    store = log.store
    name = store.names("manifests", "s")[0]
    told = store.json("manifests", "s", name)
    told["files"][0]["path"] = "../../secret"
    store.put_json(told | {"finished_at": "9999"}, "manifests", "s", name)
    with pytest.raises(ValueError, match="unsafe"):
        runtime.checked(store, "s")
    with runtime.held(store, "x"), pytest.raises(TimeoutError):
        runtime.held(store, "x", 0.2).__enter__()
    with pytest.raises(ValueError):
        store.path("../up")


def test_identity_changes_with_inputs(spark, tmp_path):
    from moorline import runtime

    store = Store(spark, str(tmp_path))
    store.put("1", "a.csv")
    store.put("2", "b.csv")
    first = runtime.identity(spark, str(tmp_path), {"seed": 1})[0]
    assert len(first) == 20 and runtime.identity(spark, str(tmp_path), {"seed": 1})[0] == first != runtime.identity(spark, str(tmp_path), {"seed": 2})[0]
    store.put("2", "a.csv")
    store.put("1", "b.csv")
    assert runtime.identity(spark, str(tmp_path), {"seed": 1})[0] != first


def test_cached_scores(spark, tmp_path):
    from moorline.runtime import cached_scores

    seen = []

    def score(df):
        seen.append(df.count())
        return df.select("text_hash", F.length("text").cast("double").alias("score"))

    one_ = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    cache = str(tmp_path / "c")
    assert cached_scores(one_, cache, score).count() == 2
    assert cached_scores(one_.union(spark.createDataFrame([("ccc",)], "text string")), cache, score).count() == 3 and seen == [2, 1]
    with pytest.raises(ValueError, match="contract"):
        cached_scores(one_, cache, score, "another model")
    with pytest.raises(ValueError, match="finite"):
        cached_scores(one_, str(tmp_path / "d"), lambda df: df.select("text_hash", F.lit(float("nan")).alias("score")))
    part = next((tmp_path / "c" / "stages" / "scores").glob("*/rows/part-*"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="changed"):
        cached_scores(one_, cache, score)


def test_program_resumes_and_is_reviewed(spark, tmp_path, monkeypatch):
    """The whole evaluation once, a second run that fits nothing, and reviews that train nothing and notice changes."""
    from moorline.plans import baseline

    root = str(tmp_path)
    monkeypatch.setattr(baseline, "PROTOCOLS", ("heldout_rule",))
    tables.synthetic(spark, root + "/data")
    run = baseline.run_baseline(spark, root, root + "/data", folds=2)
    monkeypatch.setattr(baseline.model, "fit", lambda *a, **k: pytest.fail("fitted again"))
    monkeypatch.setattr(baseline.model, "out_of_fold", lambda *a, **k: pytest.fail("fitted again"))
    assert baseline.run_baseline(spark, root, root + "/data", folds=2) == run
    with pytest.raises(FileNotFoundError):
        baseline.review_run(spark, root)
    found = baseline.review_run(spark, root, allow_synthetic=True)
    assert len(found["results"]) == 2 and run.endswith(found["run_id"])
    with pytest.raises(ValueError):
        baseline.select_run(spark, root, "../x")
    page = next((tmp_path / "runs" / found["run_id"] / "stages" / "review").glob("*/report.html")).read_text()
    assert "<svg" in page and "Synthetic" in page
    result = next((tmp_path / "runs" / found["run_id"] / "stages" / "review").glob("*/results.json"))
    for crc in result.parent.glob(".*.crc"):
        crc.unlink()
    result.write_text(result.read_text().replace("0.", "0.1", 1))
    with pytest.raises(ValueError, match="changed"):
        baseline.review_run(spark, root, found["run_id"], True)


def test_stream_windows(spark, tmp_path):
    from moorline.streaming import log

    spark.createDataFrame([(1, "2025-01-01 00:10:00", "a"), (1, "2025-01-01 00:10:00", "a"), (2, "2025-01-01 00:20:00", "a"), (3, "2025-01-05 00:00:00", "b")], "log_id bigint, t string, name string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    w = log.windowed(log.table_stream(spark, str(tmp_path / "in")), "t", "name", key="log_id")
    log.replay(w, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.name, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2)}


def test_streamed_windows_to_the_end(spark, tmp_path):
    from moorline.plans import queries

    rows = [(1, "2025-01-01 00:10:00", "a"), (1, "2025-01-01 00:10:00", "a"), (2, "2025-01-01 00:20:00", "a"), (3, "2025-01-01 05:00:00", "b"), (None, "2025-01-01 05:00:00", None)]
    spark.createDataFrame(rows, "log_id bigint, t string, event_name string").select("log_id", F.col("t").cast("timestamp_ntz").alias("logged_at"), "event_name").write.parquet(str(tmp_path / "run_log.parquet"))
    got = {(str(r.window_start), r.event_name, r.events) for r in queries.streamed_windows(spark, str(tmp_path)).select(F.col("window_start").cast("string"), "event_name", "events").collect()}
    assert got == {("2025-01-01 00:00:00", "a", 2), ("2025-01-01 05:00:00", "b", 1), ("2025-01-01 05:00:00", None, 1)}


def test_imports_without_optional_part():
    code = "import sys; sys.modules['moorline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n[0] == 'p' and n[1].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
