"""Problems 1, 2, 4, 5, 6 and 9 against brute force on small fixtures, with nulls, blanks, repeats, ties and clashing columns."""

import collections
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from moorline.llm import forms, graph, leaks, near, overlap, records, splits
from moorline.session import written

WORDS = "amber birch cedar delta ember fjord grove harbor island jungle kettle lantern meadow nectar orchid pepper quartz river summit timber umber valley willow yonder zephyr".split()


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))


def groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(find(x), x) for x in parent if find(x) != x}


def test_consistent_forms():
    assert forms.consistent("Тhe ｃafé  is​ he­re") == "The café  is here"
    assert forms.consistent("👩‍💻 ok") == "👩‍💻 ok" and forms.consistent(None) is None and forms.consistent("") == ""
    assert forms.consistent("ᎪᏴᎢ ꓐаnk") == "ABT Bank" and len(forms.LOOK_ALIKES) > 250
    yes = ["pᎪypal", "ꓐаnk", "ｆull", "café", "a​b", "so­ft", "a b", "wоrd", "Тһе dog"]
    no = ["café “quoted” — dash", "привет, друзья", "ラーメン", "👨‍👩‍👧 ❤️", "a\tb\nc", "ευχαριστώ πολύ", None, "", "plain"]
    assert [forms.needs_form(x) for x in yes] == [True] * len(yes) and [forms.needs_form(x) for x in no] == [False] * len(no)


def test_p2_query(spark, tmp_path):
    write(spark, tmp_path, "train", [(1, "a b", "r"), (2, "ok", "rulе"), (3, None, None), (3, None, None), (4, "", "x" * 100_000)], "row_id bigint, body string, rule string")
    assert {tuple(r) for r in forms.p2_found(spark, str(tmp_path)).collect()} == {(1, "body"), (2, "rule")}
    assert forms.p2_groups(spark, str(tmp_path)).count() == 0 and forms.p2_forms(spark, str(tmp_path)).count() == 6


def test_fields_in_any_layout():
    texts = ['{"title": "Old lamp", "price": "9 coins"}', "price = 9 coins | title = Old lamp", "Title: Old Lamp\nPrice: 9 coins.", "[Price] 9 coins [Title] old lamp", "- [Title] old  lamp [Price] 9 coins"]
    assert len({records.canonical(t) for t in texts}) == 1
    assert records.canonical("One. Two!") != records.canonical("Two! One.") and records.canonical("a-b c") == records.canonical("AB, c")


def test_copies(spark, tmp_path):
    r = random.Random(2)
    base = [" ".join(r.choices(WORDS, k=8)) for _ in range(60)]
    rows = [(i, r.choice((str.upper, str.title, str))(base[r.randrange(60)]) + r.choice(("", "!", " ")), r.choice(("Rule one.", "rule ONE")), 1) for i in range(300)]
    rows += [(1000, None, "Rule one", 1), (1001, "  ", "Rule one", 1), (1002, base[0], None, 1), (0, rows[0][1], rows[0][2], 1), (1003, "same", "r", 1), (1004, "SAME", "r", 1)]
    rows += [(2000 + i, "Copy me", "r", 1) for i in range(150)]
    write(spark, tmp_path, "train", rows, "row_id bigint, body string, rule string, h bigint")
    by = collections.defaultdict(set)
    for i, b, rule, _ in rows:
        if b and records.canonical(b):
            by[(records.squeeze(rule) if rule else "", records.canonical(b))].add(i)
    want = {(min(s), x) for s in by.values() for x in s if x != min(s)}
    assert {tuple(x) for x in records.p1_found(spark, str(tmp_path)).collect()} == want
    got = {x.first_row_id: x.copies for x in records.p1_records(spark, str(tmp_path)).collect()}
    assert set(got) == {min(s) for s in by.values()} and sum(got.values()) == sum(bool(b) and b.strip() != "" for _, b, _, _ in rows)


def test_filter_misses_no_repeat(spark):
    r = np.random.default_rng(0)
    h = r.integers(-(2**63), 2**63 - 1, 20_000)
    h = np.concatenate([h, h[:500]])
    df = written(spark.createDataFrame([(int(x),) for x in h], "h bigint").repartition(5), "t")
    may, not_ = records.split_repeats(df)
    seen = {x.h for x in may.collect()}
    assert set(h[:500].tolist()) <= seen and may.count() + not_.count() == len(h) and not_.count() > 18_000


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (100, 200), (None, 5)]
    got = {(r.component, r.node) for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect() if r.component != r.node}
    assert got == groups([(a, b) for a, b in chain if a is not None and a != b])
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def bodies(seed, n=120):
    r = random.Random(seed)
    pool = [w + s for w in WORDS for s in ("", "s", "ed", "ing", "er", "ly", "ness", "ful")]
    base = [r.choices(pool, k=r.randint(26, 60)) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice(([r.choice(pool)], [], [w[k], "extra"]))
        if r.random() < 0.3:
            r.shuffle(w)
        out.append(" ".join(w))
    return out


def brute_near(a, b):
    x, y = collections.Counter(near.words_of(a)), collections.Counter(near.words_of(b))
    m = max(x.total(), y.total())
    return min(x.total(), y.total()) >= 25 and (x & y).total() >= 0.8 * m - 1e-9


def test_near_groups(spark, tmp_path):
    texts = bodies(4)
    rows = [(i, t, "r", i) for i, t in enumerate(texts)] + [(500, None, "r", 1), (501, "", "r", 1), (502, "short text", "r", 1), (503, "short text", "r", 1), (504, "x " * 60_000, "r", 1), (505, "x " * 60_000, "r", 1)]
    rows += [(600 + i, texts[0], "r", 1) for i in range(40)]
    write(spark, tmp_path, "train", rows, "row_id bigint, body string, rule string, toks bigint")
    links = [(a[0], b[0]) for a, b in itertools.combinations([x for x in rows if x[1]], 2) if (a[1] == b[1] and len(near.words_of(a[1])) >= 25) or brute_near(a[1], b[1])]
    assert {tuple(x) for x in near.p4_found(spark, str(tmp_path)).collect()} == groups(links)
    write(spark, tmp_path, "train", [(1, None, "r", 1)], "row_id bigint, body string, rule string, toks bigint")
    assert near.p4_found(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("hot", [4096, 5])
def test_near_on_one_frame(spark, tmp_path, monkeypatch, hot):
    """Bodies that share a frame of common words and have more than 16 words of their own; blocks above HOT are split."""
    monkeypatch.setattr(near, "HOT", hot)
    r = random.Random(8)
    frame = [f"frame{k}" for k in range(92)]
    own = lambda i, n: [f"own{i}x{k}" for k in range(n)]
    rows = [(i, " ".join([*frame, *own(i, 20)][: 112 - i % 3])) for i in range(20)]
    rows += [(100 + i, " ".join([*frame[:30], *own(100 + i, 60)])) for i in range(10)]
    rows += [(200 + i, " ".join(r.choices(WORDS, k=40))) for i in range(30)]
    write(spark, tmp_path, "train", rows, "row_id bigint, body string")
    want = groups([(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if brute_near(a[1], b[1])])
    assert {(0, i) for i in range(1, 20)} <= want
    assert {tuple(x) for x in near.p4_found(spark, str(tmp_path)).collect()} == want


def test_near_at_the_bound(spark):
    """200 pairs of which exactly four fifths of the words are shared, all edits on words of their own: none is lost."""
    frame = [f"frame{k}" for k in range(60)]
    rows = []
    for i in range(200):
        own = [f"own{i}x{k}" for k in range(40)]
        rows += [(2 * i, " ".join(frame + own)), (2 * i + 1, " ".join(frame + own[:20] + [f"new{i}x{k}" for k in range(20)]))]
    got = {tuple(x) for x in near.near_groups(spark.createDataFrame(rows, "row_id bigint, body string")).filter("row_id > first_row_id").collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(200)}


def test_near_groups_compare_one_copy_of_a_body(spark, monkeypatch):
    """A table repeated with shifted keys: the copies stand in other partitions, and one of them is compared."""
    texts = bodies(4, 40)
    rows = [(1000 * k + i, t) for k in range(8) for i, t in enumerate(texts)] + [(7777, texts[0]), (7777, "word " * 30), (3, "word " * 30), (None, texts[1])]
    compared = []
    links = near.near_links
    monkeypatch.setattr(near, "near_links", lambda toks, key, hot: compared.append(toks.filter("size(toks) > 0").count()) or links(toks, key, hot))
    df = spark.createDataFrame(rows, "row_id bigint, body string").repartitionByRange(8, "row_id")
    got = {tuple(x) for x in near.near_groups(df).filter("row_id > first_row_id").collect()}
    known = [x for x in rows if x[0] is not None]
    same = [(a[0], b[0]) for a, b in itertools.combinations(known, 2) if brute_near(a[1], b[1])]
    assert got == groups(same)
    assert compared == [len({tuple(sorted(near.words_of(t))) for _, t in rows if len(near.words_of(t)) >= 25})]


@pytest.mark.parametrize("far", [1, 1 << 40])
@pytest.mark.parametrize("size", [3, 30])
def test_pairs_of_many_blocks_are_sent_once(far, size):
    """Bodies that meet in 40 blocks of one task are one pair of it, whatever the distance of their ids."""
    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, ddl):  # noqa: N802
            self.run = run
            return self

        select = repartition = sortWithinPartitions = distinct = lambda self, *_: self

    ids = [i * far for i in range(size)]
    columns = {"k": np.repeat(np.arange(40), size), "row_id": ids * 40, "n": pa.array([30] * 40 * size, pa.int32()), "place": pa.array([0] * 40 * size, pa.int32()), "code": [b"\1" * 16] * 40 * size, "side": pa.array([0] * 40 * size, pa.int32())}
    found = [p for batch in near.block_pairs(Rows(), "row_id", alone=True).run(pa.table(columns).to_batches(max_chunksize=100)) for p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert sorted(found) == list(itertools.combinations(ids, 2))


def test_near_groups_verify_each_body_once_where_they_are_alike(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = [(g * 100 + k, " ".join([f"g{g}{w}" for w in words] + [f"own{g}x{k}"])) for g in range(3) for k in range(20)]
    chain = [(1000 + k, " ".join([*(f"c{j}" for j in range(5 * k, 5 * k + 50))])) for k in range(6)]  # only neighbours are near
    seen, verified = [], near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, *x: seen.append(pairs.count()) or verified(pairs, *x))
    got = {tuple(x) for x in near.near_groups(spark.createDataFrame(rows + chain, "row_id bigint, body string")).filter("row_id > first_row_id").collect()}
    assert got == groups([(a[0], b[0]) for a, b in itertools.combinations(rows + chain, 2) if brute_near(a[1], b[1])])
    assert sum(seen) < 80  # of over 570 pairs



@pytest.mark.parametrize(("whole", "at_a_time"), [(1, 80_000), (100, 1500)])
def test_near_groups_in_passes(spark, monkeypatch, whole, at_a_time):
    """Large blocks in one task or in cells, in several passes: the same groups, and few pairs with a block's first are verified."""
    for name, value in (("HOT", 6), ("WHOLE", whole), ("ROWS", at_a_time)):
        monkeypatch.setattr(near, name, value, raising=False)
    r = random.Random(5)
    base = bodies(9, 60)
    rows = [*enumerate(base)] + [(100 + i, " ".join([*r.sample(WORDS, 20), *r.choices(WORDS, k=15)])) for i in range(150)]
    rows += [(300 + 20 * g + i, " ".join([*(f"f{g}x{k}" for k in range(60)), *(f"own{g}x{i}x{k}" for k in range(10))])) for g in range(2) for i in range(20)]
    rows += [(5, "frame " * 10 + " ".join(WORDS)), (5, base[7])]
    seen, verified, asked, made = [], near.verified, [], near.blocks
    monkeypatch.setattr(near, "verified", lambda pairs, *x: seen.append(pairs.count()) or verified(pairs, *x))
    monkeypatch.setattr(near, "blocks", lambda *x, **y: asked.append(y.get("turn", (0, 1))) or made(*x, **y))
    got = {tuple(x) for x in near.near_groups(spark.createDataFrame(rows, "row_id bigint, body string")).filter("row_id > first_row_id").collect()}
    want = groups([(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if brute_near(a[1], b[1])])
    assert want and got == want
    assert seen[0] < 300 and (whole == 1 or max(n for _, n in asked) > 1)


def test_shuffle_files_go_with_the_table(spark, tmp_path):
    """What was shuffled for a written table is removed when it is there; the session's setting stays."""
    from pathlib import Path

    def shuffled():
        return sum(1 for p in Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data"))

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = shuffled(), spark.conf.get(key)
    for k in range(3):
        made = written(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), f"t{k}")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and spark.conf.get(key) == kept and made.count() == 7


@pytest.mark.parametrize("hot", [None, 3])
def test_cross_split_blocks_of_any_size(spark, hot):
    texts = bodies(6, 90)
    train = [(i, t, "r") for i, t in enumerate(texts[:60])]
    test = [(1000 + i, t, "R") for i, t in enumerate(texts[60:])]
    of = lambda rows: spark.createDataFrame(rows, "row_id bigint, body string, rule string")
    want = {(a[0], b[0]) for a in train for b in test if brute_near(a[1], b[1])}
    assert want and {tuple(x) for x in overlap.cross_split_pairs(of(train), of(test), hot).collect()} == want


@pytest.mark.parametrize(("hot", "few"), [(None, 1000), (None, 0), (3, 1000)])
def test_cross_split_pairs_of_rows_with_one_id(spark, monkeypatch, hot, few):
    """The tables' ids may meet: near bodies are a pair also where both rows have the same id."""
    monkeypatch.setattr(near, "FEW", few, raising=False)
    texts = bodies(11, 40)
    train = [(i, t, "r") for i, t in enumerate(texts)]
    test = [(i, t + " more", "r") for i, t in enumerate(texts)]
    of = lambda rows: spark.createDataFrame(rows, "row_id bigint, body string, rule string")
    want = {(a[0], b[0]) for a in train for b in test if brute_near(a[1], b[1])}
    assert (0, 0) in want and {tuple(x) for x in overlap.cross_split_pairs(of(train), of(test), hot).collect()} == want


def test_filters_by_range(spark):
    r = np.random.default_rng(1)
    h = r.integers(-(2**63), 2**63 - 1, 30_000)
    rows = written(spark.createDataFrame([(int(x), i) for i, x in enumerate(np.concatenate([h, h[:700], h[:1].repeat(9000)]))], "h bigint, i bigint").repartition(4), "t")
    may, not_ = records.split_repeats(rows, max_words=1 << 12)  # ten ranges or so
    seen = {x.h for x in may.select("h").distinct().collect()}
    assert set(h[:700].tolist()) <= seen and len(seen) < 1500 and may.count() + not_.count() == 39_700


def test_cross_split_pairs(spark, tmp_path):
    texts = bodies(5, 80)
    train = [(i, t, "Rule A" if i % 2 else "rule b") for i, t in enumerate(texts[:50])] + [(90, "tiny thing", "Rule A"), (91, None, "Rule A"), (92, texts[0], None)]
    test = [(1000 + i, t, "RULE a." if i % 2 else "Rule B", "valid", "s") for i, t in enumerate(texts[50:] + texts[:6])] + [(2000, "Tiny  THING!", "rule a", "public", None), (2001, "", None, None, None)]
    write(spark, tmp_path, "train", train, "row_id bigint, body string, rule string")
    write(spark, tmp_path, "test", test, "row_id bigint, body string, rule string, eval_split string, subreddit string")
    key = lambda x: records.squeeze(x) if x else ""
    want = {(a[0], b[0]) for a in train for b in test if a[1] and b[1] and key(a[2]) == key(b[2]) and (records.canonical(a[1]) == records.canonical(b[1]) or brute_near(a[1], b[1]))}
    assert {tuple(x) for x in overlap.p5_found(spark, str(tmp_path)).collect()} == want and (90, 2000) in want
    assert overlap.p5_report(spark, str(tmp_path)).agg(F.sum("pairs")).first()[0] == len(want)


def test_names():
    assert splits.names_in("see u/Some_One and /u/x1, [u/y_2], @Zed. mail a.b@site.example") == {"u:some_one", "u:x1", "u:y_2", "u:zed"}
    assert splits.names_in("hxxps://m.shop-a.test/p?q=1, www.shop-b.invalid; SHOP-C[.]example, shop-d dot test, write to me at box dot example") == {"w:shop-a.test", "w:shop-b.invalid", "w:shop-c.example", "w:shop-d.test"}
    assert splits.names_in("Meet @ noon. It ended.Then nothing. We left.So did it.It was late. See file.txt, v1.2.3 and 3.5") == set()
    assert splits.names_in("see foo.com.br now, foo.nz, foo.me. And hxxp://a[.]b[.]museum/x, shop．example") == {"w:com.br", "w:foo.nz", "w:foo.me", "w:b.museum", "w:shop.example"}


def test_related_and_splits(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, f"text {i} from u/user{r.randrange(60)}" if i % 3 else f"plain number {i}", f"rule {i % 2}") for i in range(400)]
    rows += [(1000 + i, f"hot {i} @hub", "rule 0") for i in range(200)] + [(2000, None, None), (2001, "", "rule 1"), (2002, "Plain NUMBER 3", "other")]
    write(spark, tmp_path, "train", rows, "row_id bigint, body string, rule string")
    keys = {i: {*splits.names_in(b), "b:" + records.canonical(b)} for i, b, _ in rows if b}
    first, links = {}, []
    for i, ks in keys.items():
        for k in ks:
            links.append((first.setdefault(k, i), i))
    want = groups(links)
    assert {tuple(x) for x in splits.p6_found(spark, str(tmp_path)).collect()} == want
    got = {x.row_id: x.split for x in splits.p6_splits(spark, str(tmp_path)).collect()}
    assert set(got) == {x[0] for x in rows} and all(got[a] == got[b] for a, b in want)
    share = collections.Counter(got[i] for i, _, rule in rows if rule == "rule 1")
    n = sum(share.values())
    assert abs(share["train"] / n - 0.8) < 0.05 and share["valid"] > 0 and share["test"] > 0


def test_differencing_is_even():
    w = np.array([random.Random(1).randint(1, 50) for _ in range(400)], float)
    sums = np.bincount(splits.largest_differencing(w, 10), w, 10)
    assert sums.max() - sums.min() <= 2 and len(splits.largest_differencing(np.zeros(0), 4)) == 0


def test_divisions_of_parts_combine(monkeypatch, spark, tmp_path):
    """Partial divisions of many parts, combined level by level, are as even as one; groups stay whole."""
    monkeypatch.setattr(splits, "PART", 40)
    monkeypatch.setattr(splits, "FAN", 3)
    r = random.Random(9)
    rows = [(i, f"row {i} by u/user{r.randrange(700)}", "Rule") for i in range(1500)]
    write(spark, tmp_path, "train", rows, "row_id bigint, body string, rule string")
    got = {x.row_id: x.split for x in splits.p6_splits(spark, str(tmp_path)).collect()}
    user = {}
    assert all(user.setdefault(b.split("/")[1], got[i]) == got[i] for i, b, _ in rows) and len(got) == 1500
    share = collections.Counter(got.values())
    assert abs(share["train"] - 1200) < 15 and abs(share["valid"] - 150) < 15 and abs(share["test"] - 150) < 15
    sums = np.random.default_rng(2).integers(0, 50, (30, 8)).astype(float)
    whole = splits.combined(sums)
    total = np.bincount(whole.ravel(), sums.ravel(), 8)
    assert all(sorted(x) == list(range(8)) for x in whole.tolist()) and total.max() - total.min() <= 10


def test_leaks_are_weighed(spark):
    """An item in full is wholly alike, a passage less, a frame of fewer than RUN words is none; shingles of many items weigh less."""
    r = random.Random(12)
    frame = "in this question you are asked to read the text and to choose".split()
    items = [(k, " ".join(frame + r.choices([w + x for w in WORDS for x in ("", "s", "ed", "er")], k=60))) for k in range(4)]
    passage = " ".join(items[1][1].split()[20:45])
    docs = [(1, "before it " + items[0][1] + " and after"), (2, "some of it: " + passage + " and no more"), (3, " ".join(frame + r.choices(WORDS, k=100)))]
    of = lambda rows, a: spark.createDataFrame(rows, f"{a} bigint, text string")
    got = {(g.doc_id, g.item_id): (g.words, g.alike) for g in leaks.leaks(of(docs, "doc_id"), of(items, "item_id")).collect()}
    assert set(got) == {(1, 0), (2, 1)} and got[1, 0] == (73, 1.0) and got[2, 1][0] == 25 and got[2, 1][1] < 0.8
    x = leaks.Index([(k, np.arange(30, dtype=np.uint64) + np.uint64(100 * (k // 2))) for k in range(4)])
    assert x.alike(0, x.items[0]) == 1.0 and x.weights(leaks.shingles(x.items[0])).max() == 0.5


def test_leaks(spark, tmp_path):
    r = random.Random(6)
    items = [(k, " ".join(r.choices(WORDS, k=40))) for k in range(8)] + [(90, None), (91, "too short")]
    docs = []
    for i in range(60):
        w = r.choices(WORDS, k=50)
        k = r.randrange(8)
        n = r.choice((5, 14, 15, 20, 40))
        if i % 2:
            w[10:10] = items[k][1].split()[:n]
        docs.append((i, "\n> ".join([" ".join(w[:15]), ", ".join(w[15:30]).upper(), " &amp; ".join([" ".join(w[30:])])]), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, " ".join(["pad"] * 50_000) + " " + items[0][1], "x")]
    write(spark, tmp_path, "documents", docs, "doc_id bigint, text string, item_id string")
    write(spark, tmp_path, "eval_items", items, "item_id bigint, text string")
    run = lambda x: {tuple(x[i : i + 15]) for i in range(len(x) - 14)}
    iw = {k: run(leaks.plain_words(t)) for k, t in items if t}
    want = {(i, k) for i, t, _ in docs if t for k in iw if iw[k] & run(leaks.plain_words(t))}
    assert {tuple(x) for x in leaks.p9_found(spark, str(tmp_path)).collect()} == want and (102, 0) in want
    old = leaks.ITEM_WORDS
    try:
        leaks.ITEM_WORDS = 100
        assert {tuple(x) for x in leaks.p9_found(spark, str(tmp_path)).collect()} == want
    finally:
        leaks.ITEM_WORDS = old
    assert {x.item_id for x in leaks.p9_report(spark, str(tmp_path)).collect()} == {k for _, k in want}


@pytest.mark.parametrize("n", [0, 14, 15, 40])
def test_simhash_windows(n):
    ids = np.arange(n, dtype=np.uint64)
    assert len(leaks.simhashes(ids)) == max(0, n - 14)
