"""Problem 6: splits that keep rows together whose body is the same or names the same account or web site.

Method: components of the relation, then largest differencing: per rule, the two partial divisions with the most
uneven bins are combined, heaviest bin on lightest, until one division into BINS about equal bins is left; whole bins
go to the splits by their target shares. A rule's components are dealt to parts; each part makes a partial division of
its own, and the parts' divisions are combined by the same operation.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.llm.forms import consistent
from moorline.llm.graph import components
from moorline.llm.records import canonical, hashed, split_repeats, squeeze
from moorline.session import table, written

SPLITS = (("train", 0.8), ("valid", 0.1), ("test", 0.1))
BINS = 40
#: Components of one part, about; the divisions of up to so many parts are combined in one task, level by level.
PART, FAN = 20_000, 500

# Endings of a bare host name beside the two-letter ones, general ones and those kept for examples.
TLDS = ("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx app dev page blog site online store shop tech space website "
        "web cloud digital live life world today news media press agency network systems solutions services support software design studio art games game fun club social community "
        "chat email link click top xyz icu vip win bid loan work works zone city town house land farm garden kitchen restaurant cafe bar pub beer wine pizza coffee fit run fish "
        "guru expert coach academy school college university institute foundation ngo ong charity church bible health care clinic dental doctor hospital pharmacy fitness yoga bank finance "
        "financial fund money credit insurance tax trade market markets capital holdings ventures company business enterprises group team video photo photos pictures gallery film movie music band "
        "radio tv show theater tickets events party wedding gift gifts toys fashion clothing shoes jewelry watch beauty hair style auto cars bike taxi flights hotel holiday vacations tours cruises "
        "plus one green blue red pink black gold ink wiki how reviews report science energy solar eco bio organic build builders construction contractors estate homes rent rentals properties apartments "
        "test example invalid localhost onion local").split()
# The country codes that are in use as endings.
COUNTRIES = ("ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu "
             "fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md "
             "me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su "
             "sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw").split()
#: Endings that are words too: with a capital after a full stop they begin a sentence.
WORDS = set("am as at be by do id in is it me my no so to us one name news work world live life run care show plus how art day house home group game best click".split())
_dot = r"(?:\.|\s*\[\s*\.\s*\]\s*|\s*\(\s*\.\s*\)\s*|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)"
_label = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_host = rf"{_label}(?:{_dot}{_label})+"
_mail = re.compile(rf"[\w.+-]+(?:\s*@\s*|\s*[\[({{]\s*at\s*[\])}}]\s*|\s+at\s+){_host}")
# A host after a scheme, or one that stands alone, is not part of a longer word and ends in an ending; a further dot and label would make it longer.
_site = re.compile(rf"\b(?:h(?:tt|xx)ps?|ftp)\s*(?::|\[:\])\s*//\s*({_host})|(?<![\w@.-])({_label}(?:{_dot}{_label})*{_dot}(?:{'|'.join(TLDS + COUNTRIES)}))(?![\w-])(?!{_dot}{_label})")
_joint = re.compile(r"[a-z]\.([A-Z][a-z]*)(?![\w.-])")
_dots = re.compile(_dot)
_account = re.compile(r"(?<![\w.@/])/?u/([a-z0-9_-]*[a-z0-9_])|(?<![\w.@+-])@([a-z0-9_](?:[a-z0-9_-]*[a-z0-9_])?)")
_any = re.compile(r"@|u/|://|\bdot\b|\.(?=[a-z\])])|\[at|\(at", re.I)


def names_in(text: str) -> set[str]:
    """The accounts (u:name) and web sites (w:last two labels of the host) that a text names. E-mail addresses name neither."""
    cased = consistent(text)
    if not _any.search(cased):
        return set()
    cased = _joint.sub(lambda m: m.group()[0] + ". " + m.group()[2:] if m[1].lower() in WORDS else m.group(), cased)
    s = cased.casefold()
    s = _mail.sub(" ; ", s)
    out = {"u:" + (m[1] or m[2]) for m in _account.finditer(s)}
    for m in _site.finditer(s):
        labels = _dots.sub(".", m[1] or m[2]).split(".")
        out.add("w:" + ".".join(labels[-2:]))
    return out


def relation_keys(df: DataFrame, key: str = "row_id", body: str = "body") -> DataFrame:
    """key, k: one row per body (in the sense of problem 1), account and site of a row, as 64-bit hashes."""
    schema = pa.schema([(key, pa.int64()), ("k", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ks = [], []
            for i, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = canonical(b) if b else ""
                if c:
                    found = names_in(b)
                    found.add("b:" + c)
                    ids += [i] * len(found)
                    ks += map(hashed, found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int64())], schema=schema)

    return df.select(F.col(key).cast("bigint").alias(key), body).mapInArrow(run, f"{key} bigint, k bigint")


def related(df: DataFrame, key: str = "row_id", body: str = "body") -> DataFrame:
    """node, component of every row related to another. Null and blank bodies are related to nothing.

    A key that a third of all rows name is a star around its first row: its least row is found by partial minima, and no
    pair of its rows is made.
    """
    keys = written(relation_keys(df, key, body), "relations")
    repeat, _ = split_repeats(keys, "k")
    repeat = written(repeat, "repeats")
    firsts = repeat.groupBy("k").agg(F.min(key).alias("first"), F.max(key).alias("last")).filter("first < last").drop("last")
    return components(repeat.join(firsts, "k").filter(F.col(key) > F.col("first")).select(F.col(key).alias("a"), F.col("first").alias("b")), "related")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_row_id, row_id: each member of a set of related rows beside the set's smallest row_id."""
    found = related(table(spark, sf_dir, "train"))
    return found.filter("node <> component").select(F.col("component").alias("first_row_id"), F.col("node").alias("row_id"))


def largest_differencing(weights: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each item by the multiway differencing method; ties go by position."""
    if not len(weights):
        return np.zeros(0, int)
    heap: list[tuple[float, int, np.ndarray, list[list[int]]]] = []
    for i in np.argsort(-weights, kind="stable"):
        sums = np.zeros(bins)
        sums[-1] = weights[i]
        heap.append((-float(weights[i]), int(i), sums, [[] for _ in range(bins - 1)] + [[int(i)]]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        s = a + b[::-1]
        z = [p + q for p, q in zip(x, y[::-1], strict=True)]
        order = np.argsort(s, kind="stable")
        s = s[order]
        heapq.heappush(heap, (-float(s[-1] - s[0]), i, s, [z[o] for o in order]))
    out = np.zeros(len(weights), int)
    for k, items in enumerate(heap[0][3]):
        out[items] = k
    return out


def combined(sums: np.ndarray) -> np.ndarray:
    """The bin of the whole that each bin of each partial division (parts x bins) goes to, by the same operation; ties go by position."""
    parts, bins = sums.shape
    heap = []
    for k in range(parts):
        order = np.argsort(sums[k], kind="stable")
        heap.append((-float(sums[k].max() - sums[k].min()), k, sums[k][order], [[(k, int(b))] for b in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        s = a + b[::-1]
        z = [p + q for p, q in zip(x, y[::-1], strict=True)]
        order = np.argsort(s, kind="stable")
        heapq.heappush(heap, (-float(s[order[-1]] - s[order[0]]), i, s[order], [z[o] for o in order]))
    out = np.zeros((parts, bins), int)
    for whole, members in enumerate(heap[0][3]):
        for k, b in members:
            out[k, b] = whole
    return out


def divide(sums: np.ndarray) -> np.ndarray:
    """The split (its place in SPLITS) of each bin of one rule: the heaviest bin first, to the split that lacks most."""
    missing = np.array([share for _, share in SPLITS]) * sums.sum()
    of = np.zeros(len(sums), int)
    for k in np.argsort(-sums, kind="stable"):
        of[k] = int(np.argmax(missing))
        missing[of[k]] -= sums[k]
    return of


def grouped_splits(df: DataFrame, key: str = "row_id", body: str = "body", rule: str = "rule") -> DataFrame:
    """key, split of every row: related rows share one, each rule (after problems 1 and 2) is divided by the shares of SPLITS.

    A component counts for the rule that most of its rows have (ties: the smaller). A component heavier than a split
    goes to the split with most room. Rows with null bodies stand alone; repeated ids share their split.
    """

    @F.pandas_udf("string")
    def rule_key(s: pd.Series) -> pd.Series:
        return s.map({x: squeeze(consistent(x)) if x else "" for x in s.unique()})

    rows = df.select(F.col(key).cast("bigint").alias("node"), F.coalesce(rule_key(rule), F.lit("")).alias("rule"))
    rows = written(rows.join(related(df, key, body), "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    per = rows.groupBy("component", "rule").agg(F.count("*").alias("n"))
    comp = written(per.groupBy("component").agg(F.sum("n").alias("n"), F.max_by("rule", F.struct("n", "rule")).alias("rule")), "components")
    parts = comp.groupBy("rule").agg(F.greatest(F.lit(1), F.round(F.count("*") / PART)).cast("int").alias("parts"))
    names = [name for name, _ in SPLITS]

    def begin(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "component"], ascending=[False, True])
        return group.assign(bin=largest_differencing(group.n.to_numpy(float), BINS).astype(np.int32))[["rule", "part", "component", "bin", "n"]]

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        sums = group.pivot_table(index="part", columns="bin", values="n", aggfunc="sum", fill_value=0).reindex(columns=range(BINS), fill_value=0).sort_index()
        bins = combined(sums.to_numpy(float))
        place = {p: k for k, p in enumerate(sums.index)}
        return group.assign(whole=[int(bins[place[p], b]) for p, b in zip(group.part, group.bin, strict=True)])[["rule", "up", "part", "bin", "whole"]]

    dealt = comp.join(parts, "rule").withColumn("part", F.pmod(F.xxhash64("component"), "parts").cast("int")).drop("parts")
    place = written(dealt.groupBy("rule", "part").applyInPandas(begin, "rule string, part int, component bigint, bin int, n bigint"), "bins")
    most = parts.agg(F.max("parts")).first()[0] or 1
    while True:
        level = place.groupBy("rule", "part", "bin").agg(F.sum("n").alias("n")).withColumn("up", F.floor(F.col("part") / FAN).cast("int"))
        moved = level.groupBy("rule", "up").applyInPandas(combine, "rule string, up int, part int, bin int, whole int")
        place = written(place.join(moved, ["rule", "part", "bin"]).select("rule", F.col("up").alias("part"), "component", F.col("whole").alias("bin"), "n"), "bins")
        most = -(-most // FAN)
        if most == 1:
            break

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        return group.assign(split=[names[k] for k in divide(group.n.to_numpy(float))])[["rule", "bin", "split"]]

    splits_ = place.groupBy("rule", "bin").agg(F.sum("n").alias("n")).groupBy("rule").applyInPandas(assign, "rule string, bin int, split string")
    return rows.join(place.join(splits_, ["rule", "bin"]).select("component", "split"), "component").select(F.col("node").alias(key), "split")


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, split of every train row."""
    return grouped_splits(table(spark, sf_dir, "train"))
