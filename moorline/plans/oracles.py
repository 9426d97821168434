"""SQL that another engine runs on the same tables, with the same rows and names as the registered queries."""

from __future__ import annotations

from moorline.functions.text import STOP_WORDS
from moorline.operators.scan import PATTERNS
from moorline.plans.queries import STUDY_RULE

_full = "".join(map(chr, range(0xFF01, 0xFF5F)))
_half = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_ws = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ex = ["positive_example_1", "positive_example_2", "negative_example_1", "negative_example_2"]
_word = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*"
_stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def K(x: str) -> str:
    """NFKC as far as the tables need it."""
    return f"translate(nfc_normalize({x}), '{_full}　   ', '{_half}    ')"


def N(x: str) -> str:
    return f"replace(replace(lower(trim(regexp_replace({K(x)}, '{_ws}', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({K(x)}), '{_word}')"


def content(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: NOT list_contains({_stop}, w))"


def grams(ws: str) -> str:
    return f"list_concat({ws}, list_transform(range(1, greatest(len({ws}), 1)), lambda i: {ws}[i] || ' ' || {ws}[i + 1]))"


def _blank(c: str) -> str:
    return f"({c} IS NULL OR regexp_replace({c}, '{_ws}', '', 'g') = '')"


def _contract(t: str, labelled: bool) -> str:
    cols = ["body", "rule", "subreddit", *_ex]
    parts = [("row_id_null", "count(*) FILTER (row_id IS NULL)"), ("row_id_repeated", "count(row_id) - count(DISTINCT row_id)"), ("empty", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"), *((f"{c}_blank", f"count(*) FILTER ({_blank(c)})") for c in cols)]
    if labelled:
        parts.append(("label_invalid", "count(*) FILTER (rule_violation IS NULL OR rule_violation NOT IN (0, 1))"))
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{n}' AS \"check\", CAST({e} AS BIGINT) AS violations FROM {t}" for n, e in parts)


_cands = " UNION ALL ".join(
    ["SELECT body, rule, CAST(rule_violation AS INTEGER) AS rule_violation, 'train_body' AS source FROM train"]
    + [f"SELECT {c}, rule, {int(c.startswith('positive'))}, '{s}' FROM {t}" for t, s in (("train", "train_support"), ("test", "available_support")) for c in _ex]
)


def _statuses(cands: str, forbidden: str) -> str:
    return f"""c AS (SELECT *, {N('body')} AS normalized_body, {N('rule')} AS normalized_rule FROM ({cands}) WHERE body IS NOT NULL AND rule IS NOT NULL),
    f AS (SELECT DISTINCT k FROM ({forbidden}) WHERE k IS NOT NULL),
    b AS (SELECT c.*, f.k IS NOT NULL AS bad FROM c LEFT JOIN f ON c.normalized_body = f.k),
    m AS (SELECT *, CASE WHEN bad THEN 'forbidden' WHEN min(rule_violation) OVER w < max(rule_violation) OVER w THEN 'conflict'
        WHEN row_number() OVER (PARTITION BY bad, normalized_rule, normalized_body ORDER BY source, body, rule, rule_violation) > 1 THEN 'duplicate' ELSE 'retained' END AS status
        FROM b WINDOW w AS (PARTITION BY bad, normalized_rule, normalized_body))"""


_marked = "WITH " + _statuses(_cands, f"SELECT {N('body')} AS k FROM test")
_pairs = "WITH " + _statuses(_cands, "SELECT NULL AS k WHERE false") + f", k AS (SELECT DISTINCT {N('rule')} AS r FROM train WHERE rule IS NOT NULL), p AS (SELECT m.*, CASE WHEN k.r IS NULL THEN 2 ELSE 1 END AS repeat FROM m LEFT JOIN k ON m.normalized_rule = k.r WHERE status = 'retained')"
_known = " UNION ".join(f"SELECT {N(c)} AS k FROM train WHERE {c} IS NOT NULL" for c in _ex)
_novel = f"SELECT row_id, body, rule FROM train WHERE body IS NOT NULL AND {N('body')} NOT IN ({_known})"
_texts = " UNION ".join(f"SELECT row_id, {N(c)} AS k FROM train WHERE {c} IS NOT NULL" for c in ["body", *_ex])
_purged = f"SELECT DISTINCT b.rule AS fold_rule, t.row_id FROM ({_texts}) t JOIN train r ON r.row_id = t.row_id JOIN (SELECT DISTINCT rule, {N('body')} AS k FROM train WHERE body IS NOT NULL AND rule IS NOT NULL) b ON b.k = t.k WHERE r.rule IS DISTINCT FROM b.rule"
_rule_q = STUDY_RULE.replace("'", "''")
_study_c = " UNION ALL ".join([f"SELECT body, rule, CAST(rule_violation AS INTEGER) AS rule_violation, 'train_body' AS source FROM train WHERE rule <> '{_rule_q}'"] + [f"SELECT {c}, rule, {int(c.startswith('positive'))}, '{s}' FROM train{w}" for s, w in (("train_support", f" WHERE rule <> '{_rule_q}'"), ("available_support", "")) for c in _ex])

# TF-IDF of the control: cells, term counts, vocabulary, unit weights.
_cells = " UNION ALL ".join(f"SELECT row_id, '{c}' AS field, {c} AS text FROM train WHERE {c} IS NOT NULL" for c in ["body", "rule", *_ex])
_ctrl = rf"""WITH d AS ({_cells}), w AS (SELECT row_id, field, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS ws FROM d),
t AS (SELECT row_id, field, unnest({grams('ws')}) AS term FROM w), tf AS (SELECT row_id, field, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df, ln((1.0 + (SELECT count(*) FROM d)) / (count(*) + 1.0)) + 1 AS idf FROM tf GROUP BY term ORDER BY n DESC, term LIMIT 40000),
x AS (SELECT row_id, field, term, (1 + ln(tf)) * idf AS w FROM tf JOIN v USING (term)), nn AS (SELECT row_id, field, sqrt(sum(w * w)) AS norm FROM x GROUP BY ALL),
u AS (SELECT row_id, field, term, w / norm AS w FROM x JOIN nn USING (row_id, field))"""


def _lexical(table: str) -> str:
    """The engine per query: supports without copies of the query, their vocabulary, cosine, two nearest a label."""
    ok = lambda c, most: f"(length(trim({c})) > 0 AND length(trim({c})) + length(regexp_replace(trim({c}), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) <= {most} AND len({words(c)}) > 0)"
    return f"""WITH p AS (SELECT policy_id AS context_id, rule, violation, allowed, array_to_string({words('rule')}, ' ') AS rk, {content('rule')} AS rule_words FROM policies),
    raw AS (SELECT context_id, 'violation' AS label, generate_subscripts(violation, 1) AS place, unnest(violation) AS text FROM p UNION ALL SELECT context_id, 'allowed', 100 + generate_subscripts(allowed, 1), unnest(allowed) FROM p),
    s0 AS (SELECT *, array_to_string({words('text')}, ' ') AS key, row_number() OVER (PARTITION BY context_id, array_to_string({words('text')}, ' ') ORDER BY place) AS nth FROM raw),
    dup AS (SELECT context_id, count(*) FILTER (nth > 1) AS duplicates FROM s0 GROUP BY ALL),
    q0 AS (SELECT row_id AS query_id, p.context_id, body AS text, array_to_string({words('body')}, ' ') AS key FROM {table} t JOIN p ON array_to_string({words('t.rule')}, ' ') = p.rk),
    q AS (SELECT *, coalesce({ok('text', 1200)}, false) AS fine FROM q0),
    s AS (SELECT q.query_id, s0.context_id, s0.label, s0.text, s0.label || '-' || CAST(row_number() OVER (PARTITION BY q.query_id, s0.context_id ORDER BY s0.place) - 1 AS VARCHAR) AS support_id FROM q JOIN s0 ON q.context_id = s0.context_id AND s0.nth = 1 AND s0.key <> q.key WHERE q.fine),
    n AS (SELECT query_id, context_id, count(*) AS n, count(DISTINCT label) AS labels FROM s GROUP BY ALL),
    ss AS (SELECT *, {content('text')} AS ws FROM s), st AS (SELECT query_id, context_id, support_id, unnest({grams('ws')}) AS term FROM ss),
    stf AS (SELECT query_id, context_id, support_id, term, count(*) AS tf FROM st GROUP BY ALL),
    vocab AS (SELECT query_id, context_id, term, ln((1.0 + any_value(n.n)) / (1.0 + count(*))) + 1 AS idf, CASE WHEN len(list_filter(string_split(term, ' '), lambda w: NOT list_contains(any_value(p.rule_words), w))) = 0 THEN 1.5 ELSE 1.0 END AS boost FROM stf JOIN n USING (query_id, context_id) JOIN p USING (context_id) GROUP BY query_id, context_id, term),
    sw AS (SELECT query_id, context_id, support_id, term, (1 + ln(tf)) * idf * boost AS w FROM stf JOIN vocab USING (query_id, context_id, term)),
    sn AS (SELECT query_id, context_id, support_id, sqrt(sum(w * w)) AS norm FROM sw GROUP BY ALL),
    qq AS (SELECT query_id, context_id, {content('text')} AS ws FROM q WHERE fine), qt AS (SELECT query_id, context_id, unnest({grams('ws')}) AS term FROM qq),
    qtf AS (SELECT query_id, context_id, term, count(*) AS tf FROM qt GROUP BY ALL),
    qw AS (SELECT query_id, context_id, term, boost, (1 + ln(tf)) * idf * boost AS w FROM qtf JOIN vocab USING (query_id, context_id, term)),
    qn AS (SELECT query_id, context_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY ALL),
    con AS (SELECT query_id, context_id, support_id, term, qw.w / qn.norm * sw.w / sn.norm AS contribution, boost FROM qw JOIN qn USING (query_id, context_id) JOIN sw USING (query_id, context_id, term) JOIN sn USING (query_id, context_id, support_id)),
    sim AS (SELECT query_id, context_id, support_id, sum(contribution) AS similarity FROM con GROUP BY ALL),
    ev AS (SELECT s.query_id, s.context_id, s.support_id, s.label, coalesce(similarity, 0.0) AS similarity FROM s JOIN n USING (query_id, context_id) LEFT JOIN sim USING (query_id, context_id, support_id) WHERE n.labels = 2),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id, context_id, label ORDER BY round(similarity, 12) DESC, support_id) AS place FROM ev QUALIFY place <= 2),
    agg AS (SELECT query_id, context_id, avg(similarity) FILTER (label = 'violation') AS vs, avg(similarity) FILTER (label = 'allowed') AS al, max(similarity) AS strongest FROM near GROUP BY ALL),
    qd AS (SELECT query_id, context_id, list_distinct(ws) AS ws FROM qq), kn AS (SELECT query_id, context_id, list(term) AS terms FROM vocab GROUP BY ALL),
    cov AS (SELECT query_id, context_id, len(ws) AS query_words, len(list_intersect(ws, terms)) AS matched_words FROM qd JOIN kn USING (query_id, context_id) JOIN n USING (query_id, context_id) WHERE n.labels = 2),
    cv AS (SELECT *, CASE WHEN query_words > 0 THEN matched_words / query_words ELSE 0.0 END AS coverage FROM cov),
    res AS (SELECT q.query_id, q.context_id, vs, al, vs - al AS margin, coverage, strongest, agg.query_id IS NULL AS failed, CASE WHEN agg.query_id IS NULL THEN NULL ELSE CAST(s0c.hit AS BIGINT) END AS purged, CASE WHEN agg.query_id IS NULL THEN NULL ELSE CAST(dup.duplicates AS BIGINT) END AS duplicates,
        CASE WHEN agg.query_id IS NULL THEN NULL WHEN round(strongest, 12) < 0.08 OR round(coverage, 12) < 0.15 THEN 'NO_EVIDENCE' WHEN abs(round(vs - al, 12)) < 0.04 THEN 'BALANCED' WHEN round(vs - al, 12) > 0 THEN 'VIOLATION_MATCH' ELSE 'ALLOWED_MATCH' END AS state
        FROM q LEFT JOIN agg USING (query_id, context_id) LEFT JOIN cv USING (query_id, context_id) LEFT JOIN dup USING (context_id) LEFT JOIN (SELECT q.query_id, q.context_id, count(s0.key) AS hit FROM q LEFT JOIN s0 ON q.context_id = s0.context_id AND s0.nth = 1 AND s0.key = q.key GROUP BY ALL) s0c USING (query_id, context_id))"""


_sc = "WITH sc AS (SELECT DISTINCT * FROM oof WHERE probability IS NOT NULL AND isfinite(probability) AND probability BETWEEN 0 AND 1 AND rule_violation IN (0, 1))"


def _auc(by: str) -> str:
    return f"""r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY probability) + (count(*) OVER (PARTITION BY {by}, probability) - 1) / 2.0 AS rk FROM sc),
    a AS (SELECT {by}, CASE WHEN sum(rule_violation) * sum(1 - rule_violation) = 0 THEN NULL ELSE (sum(rk) FILTER (rule_violation = 1) - sum(rule_violation) * (sum(rule_violation) + 1) / 2.0) / (CAST(sum(rule_violation) AS DOUBLE) * sum(1 - rule_violation)) END AS auc FROM r GROUP BY {by})"""


_point = """SELECT model, protocol, rows, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, tn, fp, fn, tp, round(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM (SELECT model, protocol, count(*) AS rows, avg(-(rule_violation * ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, probability))) + (1 - rule_violation) * ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, probability))))) AS log_loss, avg((probability - rule_violation) * (probability - rule_violation)) AS brier,
count(*) FILTER (probability < 0.5 AND rule_violation = 0) AS tn, count(*) FILTER (probability >= 0.5 AND rule_violation = 0) AS fp, count(*) FILTER (probability < 0.5 AND rule_violation = 1) AS fn, count(*) FILTER (probability >= 0.5 AND rule_violation = 1) AS tp FROM {src} GROUP BY ALL)"""
_bins = "SELECT model, protocol, least(CAST(floor(probability * 10) AS BIGINT), 9) AS bin, avg(probability) AS mp, avg(rule_violation) AS oy, count(*) AS n FROM sc GROUP BY ALL"
_log = "WITH l AS (SELECT * FROM run_log QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY received_at NULLS FIRST, logged_at NULLS FIRST) = 1)"
_elapsed = _log + ", e AS (SELECT run_id, stage, count(*) AS events, max(logged_at) AS ended_at, round((epoch_us(max(logged_at)) - epoch_us(min(logged_at))) / 1e6, 3) AS seconds, bool_or(coalesce(event_name = 'failed', false)) AS failed FROM l WHERE run_id IS NOT NULL AND stage IS NOT NULL GROUP BY ALL)"
_lse = lambda a: f"(list_max({a}) + ln(list_sum(list_transform({a}, lambda x: exp(x - list_max({a}))))))"
_vec = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_toks = r"list_filter(regexp_split_to_array({c}, '[ \t\n\x{{0B}}\f\r]+'), lambda x: x <> '')"
_rank = lambda k: f"(rank() OVER (PARTITION BY label ORDER BY embedding[{k}]) + (count(*) OVER (PARTITION BY label, embedding[{k}]) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY label)"
_rate = lambda a, b: f"CASE WHEN {b} = 0 THEN NULL ELSE round(CAST({a} AS DOUBLE) / {b}, 6) END"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["normalize_keys"] = f"SELECT row_id, {N('body')} AS body_key FROM train"
    q["canonical_keys"] = f"SELECT row_id, array_to_string({words('body')}, ' ') AS body_key FROM train"
    q["content_digest"] = "SELECT row_id, sha256(body) AS sha256 FROM train"
    q["escaped_bodies"] = r"""SELECT row_id, replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, CAST(len(list_filter(regexp_split_to_array(body, '\r?\n'), lambda x: trim(x) <> '')) AS BIGINT) AS lines FROM train"""
    q["contract_violations"] = _contract("train", True) + " UNION ALL " + _contract("test", False)
    q["submission_alignment"] = """SELECT 'row_id_null' AS "check", count(*) FILTER (row_id IS NULL) AS violations FROM sample_submission UNION ALL SELECT 'row_id_repeated', count(row_id) - count(DISTINCT row_id) FROM sample_submission
        UNION ALL SELECT 'not_a_probability', count(*) FILTER (rule_violation IS NULL OR NOT isfinite(rule_violation) OR rule_violation NOT BETWEEN 0 AND 1) FROM sample_submission UNION ALL SELECT 'misaligned', count(*) FROM sample_submission s FULL JOIN test t ON s.row_id = t.row_id WHERE s.row_id IS DISTINCT FROM t.row_id"""
    q["shared_ids"] = "SELECT count(*) AS shared FROM (SELECT row_id FROM train INTERSECT SELECT row_id FROM test)"
    q["audit_summary"] = f"""SELECT (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM test) AS test_rows, (SELECT count(body) - count(DISTINCT {N('body')}) FROM train) AS duplicate_bodies,
        (SELECT count(*) FROM (SELECT {N('body')} FROM train WHERE body IS NOT NULL INTERSECT SELECT {N('body')} FROM test WHERE body IS NOT NULL)) AS body_overlap, (SELECT round(avg(rule_violation), 6) FROM train) AS prevalence, (SELECT count(DISTINCT rule) FROM train) AS train_rules, (SELECT count(DISTINCT rule) FROM test) AS test_rules"""
    q["audit_by_rule"] = "SELECT rule, count(*) AS rows, round(avg(rule_violation), 6) AS prevalence FROM train GROUP BY rule"
    q["duplicate_bodies"] = f"SELECT row_id, row_number() OVER (PARTITION BY {N('body')} ORDER BY row_id) > 1 AS duplicate FROM train"
    q["train_test_overlap"] = f"SELECT {N('body')} AS body_key FROM train WHERE body IS NOT NULL INTERSECT SELECT {N('body')} FROM test WHERE body IS NOT NULL"
    q["support_pairs"] = _marked + " SELECT body, rule, rule_violation, source, normalized_body, normalized_rule FROM m WHERE status = 'retained'"
    q["support_audit"] = _marked + " SELECT count(*) AS candidate_occurrences, count(*) FILTER (status = 'forbidden') AS forbidden_text_occurrences, (SELECT count(*) FROM (SELECT DISTINCT normalized_rule, normalized_body FROM m WHERE status = 'conflict')) AS conflicting_pairs, count(*) FILTER (status = 'conflict') AS conflicting_occurrences, count(*) FILTER (status = 'duplicate') AS duplicate_occurrences, count(*) FILTER (status = 'retained') AS retained_pairs, " + ", ".join(f"count(*) FILTER (status = 'retained' AND source = '{x}') AS {x}" for x in ("available_support", "train_body", "train_support")) + " FROM m"
    q["adaptation_repeats"] = _pairs + " SELECT normalized_rule, CAST(repeat AS BIGINT) AS repeat, count(*) AS pairs, CAST(sum(repeat) AS BIGINT) AS occurrences FROM p GROUP BY ALL"
    cells = lambda t, columns: " + ".join(f"(SELECT count(*) FROM {t} WHERE rule IS NOT NULL AND {c} IS NOT NULL)" for c in columns)
    q["support_invariants"] = _marked + f", n AS (SELECT (SELECT count(*) FROM m) AS candidates, {cells('train', ['body', *_ex])} + {cells('test', _ex)} AS cells, (SELECT count(*) FROM m WHERE status IN ('forbidden', 'conflict', 'duplicate', 'retained')) AS parts) SELECT candidates, CAST(cells AS BIGINT) AS cells, parts, candidates = cells AND candidates = parts AS holds FROM n"
    q["epoch_order"] = "SELECT row_id, row_number() OVER (ORDER BY md5('2025:1:' || CAST(row_id AS VARCHAR)), row_id) - 1 AS place FROM train"
    q["kept_last"] = _log + " SELECT run_id, stage, log_id FROM l QUALIFY row_number() OVER (PARTITION BY run_id, stage ORDER BY logged_at DESC NULLS LAST, log_id DESC NULLS LAST) <= 2"
    q["streamed_windows"] = _log + " SELECT date_trunc('hour', logged_at) AS window_start, event_name, count(*) AS events FROM l WHERE logged_at IS NOT NULL GROUP BY ALL"
    units = "flatten(list_transform(regexp_extract_all(body, '(?s).'), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END))"
    q["fingerprint_fnv1a"] = f"SELECT row_id, CASE WHEN body IS NULL THEN NULL ELSE lpad(lower(to_hex(list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform({units}, lambda u: CAST(u AS BIGINT))), lambda h, u: (xor(h, u) * 16777619) & 4294967295))), 8, '0') END AS fingerprint FROM train"
    kept = "WITH " + _statuses(_cands.replace("FROM test", "FROM train"), "SELECT NULL AS k WHERE false")
    own = " UNION ALL ".join(f"SELECT {c} AS body, rule, {int(c.startswith('positive'))} AS rule_violation, 'x' AS source FROM train" for _ in range(2) for c in _ex)
    q["study_audit"] = kept.replace("WITH c AS", "WITH RECURSIVE c AS") + f""", kp AS (SELECT normalized_rule AS r, normalized_body AS b FROM m WHERE status = 'retained'), fo AS (SELECT DISTINCT {N('rule')} AS fold_rule FROM train WHERE rule IS NOT NULL),
        ow AS (SELECT r AS fold_rule, count(*) AS own FROM (SELECT {N('rule')} AS r, {N('body')} AS b FROM ({own}) WHERE body IS NOT NULL AND rule IS NOT NULL GROUP BY r, b HAVING min(rule_violation) = max(rule_violation)) GROUP BY r),
        tx AS (SELECT DISTINCT {N('rule')} AS fold_rule, {N('body')} AS b FROM (SELECT train.* FROM train JOIN ({_novel}) USING (row_id)) WHERE rule IS NOT NULL),
        pr AS (SELECT fold_rule, count(*) AS pairs FROM fo JOIN kp ON kp.r <> fo.fold_rule WHERE NOT EXISTS (SELECT 1 FROM tx WHERE tx.fold_rule = fo.fold_rule AND tx.b = kp.b) GROUP BY fold_rule)
        SELECT fold_rule, coalesce(pairs, 0) + coalesce(own, 0) AS training_pairs, coalesce(own, 0) AS new_rule_training_pairs, coalesce(pairs, 0) + 2 * coalesce(own, 0) AS epoch_occurrences FROM fo LEFT JOIN pr USING (fold_rule) LEFT JOIN ow USING (fold_rule)"""
    q["replicated_rows"] = _pairs + " SELECT rule_violation, CAST(sum(repeat) AS BIGINT) AS rows FROM p GROUP BY ALL"
    q["new_rules"] = f"SELECT {N('rule')} AS rule FROM test WHERE rule IS NOT NULL EXCEPT SELECT {N('rule')} FROM train WHERE rule IS NOT NULL"
    q["purged_rows"] = _purged
    q["heldout_purge"] = f"WITH g AS ({_purged}), r AS (SELECT rule AS fold_rule, count(*) AS valid_rows FROM train WHERE rule IS NOT NULL GROUP BY ALL), x AS (SELECT fold_rule, count(*) AS purged_rows FROM g GROUP BY ALL) SELECT fold_rule, (SELECT count(*) FROM train) - valid_rows AS train_rows, valid_rows, coalesce(purged_rows, 0) AS purged_rows, (SELECT count(*) FROM train) - valid_rows - coalesce(purged_rows, 0) AS kept_rows FROM r LEFT JOIN x USING (fold_rule)"
    q["seen_group_folds"] = f"WITH r AS (SELECT row_id, md5(coalesce({N('body')}, '')) AS g, coalesce(rule, '') || '::' || CAST(rule_violation AS VARCHAR) AS s FROM train), gr AS (SELECT g, min(s) AS s FROM r GROUP BY g), d AS (SELECT g, (row_number() OVER (PARTITION BY s ORDER BY md5('2025:' || g), g) - 1) % 3 AS fold FROM gr) SELECT row_id, CAST(fold AS BIGINT) AS fold FROM r JOIN d USING (g)"
    q["novel_queries"] = f"SELECT row_id, rule FROM ({_novel})"
    q["study_counts"] = f"WITH nv AS (SELECT rule, count(*) AS k FROM ({_novel}) GROUP BY rule), r AS (SELECT rule, count(*) AS n FROM train WHERE rule IS NOT NULL GROUP BY rule) SELECT rule, n AS candidate_query_rows, coalesce(k, 0) AS novel_query_rows, n - coalesce(k, 0) AS known_support_overlap_excluded FROM r LEFT JOIN nv USING (rule)"
    q["study_training"] = "WITH " + _statuses(_study_c, f"SELECT {N('body')} AS k FROM ({_novel}) WHERE rule = '{_rule_q}'") + f" SELECT body, rule, rule_violation, CAST(CASE WHEN normalized_rule = {N(chr(39) + _rule_q + chr(39))} THEN 2 ELSE 1 END AS BIGINT) AS repeat FROM m WHERE status = 'retained'"
    q["lexical_terms"] = f"WITH w AS (SELECT row_id, {content('body')} AS ws FROM train WHERE body IS NOT NULL), t AS (SELECT row_id, unnest({grams('ws')}) AS term FROM w), tf AS (SELECT row_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS documents, round(ln((1.0 + (SELECT count(*) FROM w)) / (count(*) + 1.0)) + 1, 6) AS idf FROM tf GROUP BY term"
    q["vocabulary_top"] = _ctrl + " SELECT term, n AS occurrences, df AS documents, round(idf, 6) AS idf FROM v"
    q["tfidf_documents"] = _ctrl + " SELECT row_id, field, count(*) AS terms, round(max(w), 6) AS greatest, round(sum(w), 6) AS total FROM u GROUP BY ALL"
    sims = ", ".join(f"coalesce(sum(a.w * b.w) FILTER (a.field = '{c}'), 0.0) AS {c}" for c in ["rule", *_ex])
    q["context_similarities"] = _ctrl + f", dd AS (SELECT row_id, {sims} FROM u a JOIN (SELECT row_id, term, w FROM u WHERE field = 'body') b USING (row_id, term) WHERE a.field <> 'body' GROUP BY ALL), z AS (SELECT train.row_id, " + ", ".join(f"coalesce(dd.{c}, 0.0) AS {c}" for c in ["rule", *_ex]) + " FROM train LEFT JOIN dd ON train.row_id = dd.row_id) SELECT row_id, " + ", ".join(f"round({c}, 6) AS similarity_{c}" for c in ["rule", *_ex]) + f", round(greatest({_ex[0]}, {_ex[1]}), 6) AS max_positive_similarity, round(greatest({_ex[2]}, {_ex[3]}), 6) AS max_negative_similarity, round(greatest({_ex[0]}, {_ex[1]}) - greatest({_ex[2]}, {_ex[3]}), 6) + 0.0 AS similarity_margin FROM z"
    q["lexical_margin"] = _lexical("test") + " SELECT query_id, context_id, round(vs, 6) AS violation_similarity, round(al, 6) AS allowed_similarity, round(margin, 6) AS margin, round(CASE WHEN failed THEN NULL ELSE coverage END, 6) AS coverage, state, coalesce(purged, 0) AS purged, coalesce(duplicates, 0) AS duplicates, failed FROM res"
    q["lexical_evidence"] = _lexical("test") + " SELECT query_id, context_id, label, place, support_id, round(similarity, 6) AS similarity FROM near"
    q["lexical_contributions"] = _lexical("test") + " SELECT query_id, context_id, support_id, term, round(contribution, 6) AS contribution, CAST(boost AS DOUBLE) AS boost FROM con JOIN n USING (query_id, context_id) WHERE n.labels = 2"
    q["query_coverage"] = _lexical("test") + " SELECT query_id, context_id, query_words, matched_words, round(coverage, 6) AS coverage FROM cv"
    q["challenge_grouping_sets"] = _lexical("train") + f""", z AS (SELECT context_id AS policy, lower(trim(t.subreddit)) AS slice, CASE WHEN t.rule_violation = 1 THEN 'violation' ELSE 'allowed' END AS expected, CASE state WHEN 'VIOLATION_MATCH' THEN 'violation' WHEN 'ALLOWED_MATCH' THEN 'allowed' ELSE 'abstain' END AS decision FROM res JOIN train t ON t.row_id = res.query_id WHERE NOT failed),
        y AS (SELECT slice, policy, (CASE WHEN grouping(slice) = 0 THEN 'slice' ELSE '' END) || (CASE WHEN grouping(policy) = 0 THEN 'policy' ELSE '' END) AS level, count(*) AS cases, count(*) FILTER (expected = decision) AS correct, count(*) FILTER (expected <> decision) AS failures, count(*) FILTER (expected <> 'abstain') AS labeled_cases, count(*) FILTER (expected <> 'abstain' AND decision <> 'abstain') AS decided_labeled_cases, count(*) FILTER (expected <> 'abstain' AND decision = expected) AS rt,
        count(*) FILTER (expected = 'allowed' AND decision = 'violation') AS false_violations, count(*) FILTER (expected = 'violation' AND decision = 'allowed') AS false_allowances, count(*) FILTER (expected = 'abstain') AS unsupported_cases, count(*) FILTER (expected = 'abstain' AND decision = 'abstain') AS unsupported_abstentions FROM z GROUP BY GROUPING SETS ((), (slice), (policy)))
        SELECT slice, policy, level, cases, correct, failures, {_rate('correct', 'cases')} AS agreement, labeled_cases, decided_labeled_cases, {_rate('decided_labeled_cases', 'labeled_cases')} AS decision_coverage, {_rate('rt', 'decided_labeled_cases')} AS selective_agreement, false_violations, false_allowances, unsupported_cases, unsupported_abstentions FROM y"""
    q["per_rule_auc"] = _sc + ", " + _auc("model, protocol, rule") + " SELECT model, protocol, rule, round(auc, 6) AS auc FROM a"
    q["macro_auc"] = _sc + ", " + _auc("model, protocol, rule") + " SELECT model, protocol, round(avg(auc), 6) AS macro_auc FROM a GROUP BY ALL"
    q["pooled_auc"] = _sc + ", " + _auc("model, protocol") + " SELECT model, protocol, round(auc, 6) AS auc FROM a"
    q["average_precision"] = _sc + ", g AS (SELECT model, protocol, probability, sum(rule_violation) AS pos, count(*) AS n FROM sc GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY model, protocol) AS n1 FROM g WINDOW w AS (PARTITION BY model, protocol ORDER BY probability DESC)) SELECT model, protocol, round(sum(CAST(pos AS DOUBLE) / n1 * (CAST(tp AS DOUBLE) / k)), 6) AS average_precision FROM c GROUP BY ALL"
    q["pointwise_metrics"] = _sc + " " + _point.format(src="sc")
    q["ece10"] = _sc + f" SELECT model, protocol, round(sum(n * abs(oy - mp)) / sum(n), 6) AS ece FROM ({_bins}) GROUP BY ALL"
    q["calibration_table"] = _sc + f" SELECT model, protocol, bin, round(mp, 6) AS mean_probability, round(oy, 6) AS observed_rate, n AS rows FROM ({_bins})"
    q["error_review"] = _sc + ", m AS (SELECT row_id, model, protocol, abs(max(rule_violation) - max(probability)) AS e FROM sc GROUP BY row_id, model, protocol) SELECT row_id, model, protocol, round(e, 6) AS absolute_error FROM m"
    q["policy_ranks"] = _sc + " SELECT row_id, model, protocol, rule, fold, round(probability, 6) AS probability, round((rank() OVER (PARTITION BY model, protocol, rule ORDER BY probability) + (count(*) OVER (PARTITION BY model, protocol, rule, probability) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY model, protocol, rule), 6) AS rank FROM sc"
    q["rank_blend"] = f"SELECT vec_id, round(0.5 * {_rank(1)} + 0.25 * {_rank(2)} + 0.25 * {_rank(3)}, 6) AS blended FROM embeddings"
    q["oof_coverage"] = "WITH i AS (SELECT DISTINCT row_id FROM train), g AS (SELECT model, protocol, o.row_id, count(*) AS n, any_value(i.row_id) AS known FROM oof o LEFT JOIN i ON o.row_id = i.row_id GROUP BY ALL) SELECT model, protocol, count(*) AS predicted, count(*) FILTER (n > 1) AS repeated, (SELECT count(*) FROM i) - count(known) AS missing, count(*) FILTER (known IS NULL) AS unknown FROM g GROUP BY ALL"
    q["grid_coverage"] = "WITH e AS (SELECT * FROM (VALUES ('comment_only', 'seen_rule'), ('comment_only', 'new_rule'), ('rule_examples', 'seen_rule'), ('rule_examples', 'new_rule')) t(model, protocol)), o AS (SELECT DISTINCT model, protocol FROM oof) SELECT *, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM o EXCEPT SELECT * FROM e)"
    q["head_tail_truncate"] = f"WITH t AS (SELECT row_id, {_toks.format(c='body')} AS w FROM train WHERE body IS NOT NULL) SELECT row_id, CAST(len(w) AS BIGINT) AS tokens, array_to_string(CASE WHEN len(w) > 40 THEN list_concat(w[1:30], w[len(w) - 9:len(w)]) ELSE w END, ' ') AS kept FROM t"
    q["prompt_budget"] = "WITH t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, len({_toks.format(c=c)}) AS n, {384 if c == 'body' else 96 if c == 'rule' else 192} AS most FROM train WHERE {c} IS NOT NULL" for c in ["body", "rule", *_ex]) + ") SELECT field, count(*) FILTER (n > most) AS truncated, CAST(max(n) AS BIGINT) AS longest FROM t GROUP BY field"
    q["score_batches"] = f"WITH t AS (SELECT row_id, CAST(len({_toks.format(c='body')}) AS BIGINT) AS n FROM train WHERE body IS NOT NULL) SELECT row_id, n, CAST(floor((row_number() OVER (ORDER BY n, row_id) - 1) / 4) AS BIGINT) AS batch FROM t"
    a, b = f"{_vec}[1:3]", f"{_vec}[4:6]"
    q["logit_scores"] = f"WITH t AS (SELECT vec_id, {_lse(a)} AS no, {_lse(b)} AS yes, {_lse(_vec)} AS z FROM embeddings) SELECT vec_id, round(1 / (1 + exp(no - yes)), 6) AS probability, round(yes - no, 6) AS margin, round((exp(no) + exp(yes)) / exp(z), 6) AS mass FROM t"
    q["decision_loss"] = f"SELECT vec_id, round({_lse(_vec)} - CAST(embedding[label + 1] AS DOUBLE), 6) AS loss FROM embeddings"
    q["centroid_readout"] = f"WITH e AS (SELECT vec_id, label, {_vec} AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e), l AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM u), m AS (SELECT label, i, avg(x) AS x FROM l GROUP BY ALL), cc AS (SELECT label AS lab, list(x ORDER BY i) AS c FROM m GROUP BY ALL), s AS (SELECT vec_id, label, lab, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 9) AS s FROM u, cc) SELECT vec_id, label, lab AS predicted, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, lab) = 1"
    q["warmup_schedule"] = "SELECT range AS step, round(least((range + 1) / 100.0, greatest(0.0, (1000.0 - range) / 900.0)), 6) AS factor FROM range(1000)"
    q["publication_scan"] = " UNION ALL ".join(f"SELECT row_id, '{n}' AS finding, CAST(len(regexp_extract_all(body, '{p.replace(chr(39), chr(39) * 2)}')) AS BIGINT) AS hits FROM train WHERE len(regexp_extract_all(body, '{p.replace(chr(39), chr(39) * 2)}')) > 0" for n, p in PATTERNS.items())
    q["asset_links"] = "WITH u AS (SELECT row_id, unnest(list_distinct(regexp_extract_all(body, '" + PATTERNS["link"].replace("'", "''") + "'))) AS url FROM train) SELECT row_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host FROM u"
    q["stage_elapsed"] = _elapsed + " SELECT run_id, stage, events, seconds, failed FROM e"
    q["latest_run"] = _elapsed + " SELECT stage, run_id FROM e WHERE NOT failed QUALIFY row_number() OVER (PARTITION BY stage ORDER BY ended_at DESC, run_id DESC) = 1"
    q["event_since_start"] = _log + " SELECT log_id, run_id, stage, round((epoch_us(logged_at) - min(epoch_us(logged_at)) OVER (PARTITION BY run_id, stage)) / 1e6, 3) AS since_stage, round((epoch_us(logged_at) - min(epoch_us(logged_at)) OVER (PARTITION BY run_id)) / 1e6, 3) AS since_run FROM l WHERE run_id IS NOT NULL AND stage IS NOT NULL AND logged_at IS NOT NULL"
    q["event_window_counts"] = _log + " SELECT date_trunc('hour', logged_at) AS window_start, event_name, count(*) AS events, count(*) FILTER (epoch_us(received_at) - epoch_us(logged_at) > 3600000000) AS late FROM l WHERE logged_at IS NOT NULL GROUP BY ALL"
    q["click_windows"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY ALL"
    return q
