"""Problem 3: abusive, hateful or sexual content, a score for every row and a rate for every source.

Method: a classifier chain. Linear models of the categories sexual, threat, contempt and insult are asked one after
another, each with the probabilities of those before it as features, and a last link says whether a sentence is toxic
at all. While fitting, a link gets the out-of-fold predictions of the links before it. A row's score is that of its
worst sentence. Labels are of whole rows: in fitting, a toxic row stands for the sentence that the model so far finds
worst, starting from sentences with a seed word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.llm.forms import consistent
from moorline.session import table

#: At most so many labelled rows are fitted on, those with the least hash; the corpus itself is scored in full.
MAX_LABELLED = 4000
FOLDS, ROUNDS, STEPS, RIDGE = 3, 3, 50, 3e-5
#: Sentences of fewer features weigh as if they had so many.
SHORT = 8
THRESHOLD = 0.4

# Seed words of the categories; they only tell which category a labelled example belongs to.
SEEDS = {
    "sexual": "sex sext sexy porn nude nudes naked horny kink kinky tits boobs ass panties undress cock pussy thighs moaning bang strip webcam erotic wet hard bed ride come",
    "threat": "kill break smash burn burns beat hurt die dead stab shoot bat slap park find regret watch lesson bones neck legs teeth house spit rope",
    "contempt": "breed vermin cockroaches subhuman plague animals infested infest folk believers migrants foreigners temples rats cages thieving blood liars dirty lazy ban feed starve town infidels people faith disease",
    "insult": "idiot moron stupid filthy pig clown coward loser halfwit dimwit worthless freak parasite imbecile scumbag jackass degenerate garbage pathetic rotten disgusting brainless spineless liar clueless useless joke brick brain mother mouth shame rock mummy opinion",
}
LINKS = (*SEEDS, "toxic")

_disguised = re.compile(r"[a-z][0134578@$*+]|[0134578@$*+][a-z]|(?<![^\W_])[^\W_][ ._*-][^\W_][ ._*-][^\W_](?![^\W_])|([a-z])\1\1|[a-z]!+[a-z]|[a-z][._-][a-z][._-]")
_spaced = re.compile(r"(?<![^\W_])[^\W_](?:[ ._*-][^\W_]){2,}(?![^\W_])")
_mixed = re.compile(r"[\w@$!*+]*[a-z][\w@$!*+]*")
_leet = str.maketrans("0134578@$!+", "oieastbasit")
_again = re.compile(r"([a-z])\1{2,}")
_ends = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\n+")
_words = re.compile(r"[^\W_][\w*]*(?:'[a-z]+)?")


def _plain(m: re.Match) -> str:
    w = m.group()
    tail = len(w) - len(w.rstrip("!+*"))
    head, rest = (w[: len(w) - tail], w[len(w) - tail :]) if tail else (w, "")
    return (head if head.isalpha() else head.translate(_leet)) + rest


def undisguised(text: str) -> str:
    """The consistent form in lower case, with spaced, starred (kept as *), doubled and digit spellings undone."""
    s = consistent(text).casefold()
    if _disguised.search(s):
        s = _spaced.sub(lambda m: re.sub(r"[ ._*-]", "", m.group()), s)
        s = _mixed.sub(_plain, s)
        s = _again.sub(r"\1", s)
    return s


WINDOW, STRIDE = 16, 8


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence; longer stretches without an end are cut into overlapping windows."""
    out = []
    for part in _ends.split(undisguised(text)):
        w = _words.findall(part)
        if not w:
            continue
        if len(w) <= 2 * WINDOW - STRIDE:
            out.append(w)
        else:
            out += [w[i : i + WINDOW] for i in range(0, len(w) - STRIDE, STRIDE)]
    return out


class Model:
    """Vocabulary and weights of the chain; a few MB at most."""

    def __init__(self, words: dict[str, int], pairs: dict[int, int], weights: np.ndarray, bias: np.ndarray, chain: np.ndarray) -> None:
        self.words, self.pairs, self.weights, self.bias, self.chain = words, pairs, weights, bias, chain
        self.starred: dict[str, str] = {}

    def _read(self, w: str) -> str:
        """A starred word as the heaviest known word that it can stand for."""
        if w not in self.starred:
            p = re.compile(re.escape(w).replace(r"\*", "[a-z]") + "$")
            fits = [x for x in self.words if len(x) == len(w) and p.match(x)]
            self.starred[w] = max(fits, key=lambda x: (self.weights[self.words[x], -1], x), default=w)
        return self.starred[w]

    def features(self, sentence: list[str]) -> list[int]:
        get = self.words.get
        ids = [get(self._read(w) if "*" in w else w, -1) for w in sentence]
        pair = self.pairs.get
        out = [i for i in ids if i >= 0]
        out += [p for a, b in zip(ids, ids[1:], strict=False) if a >= 0 and b >= 0 and (p := pair(a << 24 | b)) is not None]
        return out

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """Probability of each link for each sentence; 0 for a sentence without a known word."""
        lens = np.array([len(r) for r in rows])
        z = np.zeros((len(rows), len(LINKS)))
        if lens.sum():
            flat = np.concatenate([np.array(r, np.int64) for r in rows if r])
            at = np.cumsum(lens[lens > 0]) - lens[lens > 0]
            z[lens > 0] = np.add.reduceat(self.weights[flat], at, axis=0) / np.sqrt(np.maximum(lens[lens > 0], SHORT))[:, None]
        p = np.zeros_like(z)
        for k in range(len(LINKS)):
            p[:, k] = 1 / (1 + np.exp(-np.clip(z[:, k] + self.bias[k] + p[:, :k] @ self.chain[:k, k], -30, 30)))
        p[lens == 0] = 0
        return p


def _link(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Ridge logistic regression by Adagrad on all rows; (weights, bias, weights of the dense features)."""
    n = len(y)
    w, b, d = np.zeros(size), -1.0, np.zeros(dense.shape[1])
    gw, gb, gd = np.full(size, 1e-8), 1e-8, np.full(dense.shape[1], 1e-8)
    total = weight.sum()
    for _ in range(STEPS):
        z = np.bincount(rows, w[cols], n) * scale + b + dense @ d
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / total
        g = np.bincount(cols, (e * scale)[rows], size) + RIDGE * w
        gw += g * g
        w -= 1.0 * g / np.sqrt(gw)
        gb += e.sum() ** 2
        b -= 0.5 * e.sum() / np.sqrt(gb)
        if len(d):
            q = dense.T @ e
            gd += q * q
            d -= 0.5 * q / np.sqrt(gd)
    return w, b, d


def fit(texts: list[str], labels: list[float]) -> Model:
    """The chain from labelled texts. Without a label of either kind the model says the seed words' category, weakly."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    texts, labels = [texts[i] for i in order], np.array([labels[i] for i in order], float)
    docs = [sentences(t) for t in texts]
    seen: dict[str, list] = {}
    for k, doc in enumerate(docs):
        for s in doc:
            for w in s:
                e = seen.setdefault(w, [0, -1])
                if e[1] != k:
                    e[0], e[1] = e[0] + 1, k
    seeds = {w: k for k, c in enumerate(SEEDS) for w in SEEDS[c].split()}
    words = {w: i for i, w in enumerate(sorted(w for w, e in seen.items() if "*" not in w and (e[0] > 1 or w in seeds)))}
    counts: dict[int, int] = {}
    ids = [[[words.get(w, -1) for w in s] for s in doc] for doc in docs]
    for doc in ids:
        for key in {a << 24 | b for s in doc for a, b in zip(s, s[1:], strict=False) if a >= 0 and b >= 0}:
            counts[key] = counts.get(key, 0) + 1
    pairs = {key: len(words) + i for i, key in enumerate(sorted(k for k, n in counts.items() if n > 1))}
    size = len(words) + len(pairs) or 1
    model = Model(words, pairs, np.zeros((size, len(LINKS))), np.full(len(LINKS), -3.0), np.zeros((len(LINKS), len(LINKS))))
    for w, k in seeds.items():
        if w in words:
            model.weights[words[w], [k, -1]] = 1.0
    feats = [[model.features(s) for s in doc] for doc in docs]
    flat = [f for doc in feats for f in doc]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    if not len(flat) or labels.min() == labels.max():
        return model
    lens = np.array([len(f) for f in flat])
    rows, cols = np.repeat(np.arange(len(flat)), lens), np.array([i for f in flat for i in f], np.int64)
    scale = 1 / np.sqrt(np.maximum(lens, SHORT))
    seed_of = np.zeros((len(flat), len(SEEDS)))
    for w, k in seeds.items():
        if w in words:
            seed_of[rows[cols == words[w]], k] += 1
    fold = owner % FOLDS
    toxic_row = labels[owner] >= 0.5
    none = np.zeros((len(flat), 0))
    # Which sentence of a toxic row is meant: seed words first, then the model fitted so far, always from other folds.
    worst = seed_of.sum(1) * 0.5 + np.random.default_rng(3).random(len(flat)) * 1e-3
    for r in range(ROUNDS):
        best = np.zeros(len(docs))
        np.maximum.at(best, owner, worst)
        pick = toxic_row & (worst >= best[owner] - 1e-12)
        used = pick | ~toxic_row
        # A sentence met in many clean rows is no reason for a label.
        for k in range(FOLDS):
            at = used & (fold != k)
            keep = at[rows]
            index = np.cumsum(at) - 1
            w, b, _ = _link(index[rows[keep]], cols[keep], scale[at], none[at], pick[at].astype(float), np.where(pick[at], 3.0, 1.0), size)
            out = fold == k
            z = np.bincount(rows, w[cols], len(flat)) * scale + b
            worst[out] = z[out] + (0.5 * seed_of.sum(1)[out] if r == 0 else 0)
    best = np.full(len(docs), -np.inf)
    np.maximum.at(best, owner, worst)
    pick = toxic_row & ((worst >= best[owner] - 1e-12) | (worst > 1.0)) & (worst > -1.5)
    used = pick | ~toxic_row
    category = seed_of.argmax(1)
    has = seed_of.max(1) > 0
    earlier = np.zeros((len(flat), 0))
    index = np.cumsum(used) - 1
    for link, name in enumerate(LINKS):
        y = pick.astype(float) if name == "toxic" else (pick & has & (category == link)).astype(float)
        weight = np.where(y > 0, 2.0, 1.0)
        oof = np.zeros(len(flat))
        for k in range(FOLDS):
            at = used & (fold != k)
            keep, ix = at[rows], np.cumsum(at) - 1
            w, b, d = _link(ix[rows[keep]], cols[keep], scale[at], earlier[at], y[at], weight[at], size)
            out = fold == k
            z = np.bincount(rows, w[cols], len(flat)) * scale + b + earlier @ d
            oof[out] = 1 / (1 + np.exp(-np.clip(z[out], -30, 30)))
        keep = used[rows]
        w, b, d = _link(index[rows[keep]], cols[keep], scale[used], earlier[used], y[used], weight[used], size)
        model.weights[:, link], model.bias[link], model.chain[:link, link] = w, b, d
        earlier = np.column_stack([earlier, oof])
    model.weights = model.weights.astype(np.float32)
    return model


def labelled(labels: DataFrame, rows: DataFrame) -> tuple[list[str], list[float]]:
    """Texts and mean labels of at most MAX_LABELLED judged rows, those with the least hash."""
    mean = labels.filter("toxic is not null").groupBy("row_id").agg(F.avg("toxic").alias("y"))
    few = mean.orderBy(F.xxhash64("row_id"), "row_id").limit(MAX_LABELLED)
    got = rows.select("row_id", "body").filter("body is not null").join(few, "row_id").select("body", "y").collect()
    return [r[0] for r in got], [r[1] for r in got]


def scored(df: DataFrame, model: Model, key: str = "row_id", body: str = "body") -> DataFrame:
    """key, score and the probability of each category (of the worst sentence) for every row; rows without words score 0."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [(key, pa.int64()), ("score", pa.float64())] + [(c, pa.float64()) for c in SEEDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                feats, n = [], []
                for x in batch.column(1).to_pylist():
                    f = [m.features(s) for s in sentences(x)] if x else []
                    feats += f
                    n.append(len(f))
                n = np.array(n)
                out = np.zeros((len(n), len(LINKS)))
                if feats:
                    p = m.probabilities(feats)
                    some = np.flatnonzero(n)
                    starts = (np.cumsum(n) - n)[some]
                    out[some] = np.maximum.reduceat(p, starts, axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[:, -1]), *(pa.array(out[:, k]) for k in range(len(SEEDS)))], schema=pa.schema(fields))

    return df.select(F.col(key).cast("bigint").alias(key), body).mapInArrow(run, f"{key} bigint, score double, " + ", ".join(f"{c} double" for c in SEEDS))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "train")
    return scored(train, fit(*labelled(table(spark, sf_dir, "toxic_labels"), train)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id of the rows that score at least THRESHOLD. Null and blank bodies never do."""
    return _scores(spark, sf_dir).filter(F.col("score") >= THRESHOLD).select("row_id").distinct()


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, score, sexual, threat, contempt, insult of every train row."""
    return _scores(spark, sf_dir)


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subreddit (trimmed, lower case, null kept), rows, toxic, rate, mean_score."""
    of = table(spark, sf_dir, "train").select("row_id", F.lower(F.trim("subreddit")).alias("subreddit"))
    hit = F.col("score") >= THRESHOLD
    return _scores(spark, sf_dir).join(of, "row_id").groupBy("subreddit").agg(F.count("*").alias("rows"), F.count_if(hit).alias("toxic"), F.avg(hit.cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
