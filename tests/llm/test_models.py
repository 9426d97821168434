"""Problems 3, 7, 8 and 10: held-out accuracy, gradients, exact packing."""

import itertools
import random

import numpy as np
import pytest

from moorline.llm import areas, packing, personal, tagger, toxic


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))


def test_disguises():
    assert toxic.undisguised("You 1d10t, p o r n, fffilthy, br@1nl3$$") == "you idiot, porn, filthy, brainless"
    assert toxic.sentences("One two. Three!\nfour") == [["one", "two"], ["three"], ["four"]] and toxic.sentences("") == []


def toxic_rows(n, seed):
    r = random.Random(seed)
    calm = ["the vote ended {} to {}", "we keep the thread open after {} days of {}", "posts by number {} are held back {}", "someone wrote you filthy parasite to {} and that comment {} is gone", "a tapeworm is a parasite of {} in {}"]
    bad = ["only an idiot like you would write {} {}", "i will find you and break your neck {} {}", "never trust migrants, thieving is in their blood {} {}", "send me nudes {} {}"]
    rows = []
    for i in range(n):
        s = [r.choice(calm).format(r.randint(1, 99), r.randint(1, 99)) for _ in range(r.randint(1, 5))]
        y = r.random() < 0.4
        if y:
            s.insert(r.randrange(len(s) + 1), r.choice(bad).format(r.randint(1, 9), r.randint(1, 9)))
        rows.append((i, ". ".join(x.capitalize() for x in s) + ".", y))
    return rows


def test_toxic_chain(spark, tmp_path):
    rows = toxic_rows(600, 1)
    train = [(i, b, "Sub" if i % 2 else None) for i, b, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (5002, "fine words " * 20_000, "x")]
    write(spark, tmp_path, "train", train, "row_id bigint, body string, subreddit string")
    write(spark, tmp_path, "toxic_labels", [(i, int(y), "a") for i, _, y in rows[:300]] + [(1, None, "b"), (2, int(rows[2][2]), "b")], "row_id bigint, toxic int, annotator string")
    found = {r.row_id for r in toxic.p3_found(spark, str(tmp_path)).collect()}
    held = rows[300:]
    right = sum((i in found) == y for i, _, y in held)
    assert right / len(held) > 0.95 and not found & {5000, 5001, 5002}
    assert toxic.p3_scores(spark, str(tmp_path)).count() == len(train) and toxic.p3_rates(spark, str(tmp_path)).count() == 3
    write(spark, tmp_path, "toxic_labels", [], "row_id bigint, toxic int, annotator string")
    assert toxic.p3_scores(spark, str(tmp_path)).count() == len(train)


def test_tagger_gradients():
    t = tagger.Tagger(12, 5, width=4, hidden=3, seed=1)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    r = np.random.default_rng(2)
    ids, y = r.integers(0, 12, (3, 6)), r.integers(0, 5, (3, 6))
    _, grad = t.loss(ids, y)
    for k, g in grad.items():
        at = tuple(r.integers(0, s) for s in g.shape)
        eps, keep = 1e-3, t.p[k][at]
        t.p[k][at] = keep + eps
        a = t.loss(ids, y)[0]
        t.p[k][at] = keep - eps
        b = t.loss(ids, y)[0]
        t.p[k][at] = keep
        assert abs((a - b) / (2 * eps) - g[at]) < 2e-3, k


def test_tagger_learns_and_reconciles():
    r = random.Random(0)
    texts = ["".join(r.choice("abc") for _ in range(60)) for _ in range(300)]
    ids = np.array([[personal.char_ids(t)[i] for i in range(60)] + [0] * 4 for t in texts])
    y = np.array([[int(c == "b") for c in t] + [0] * 4 for t in texts])
    t = tagger.Tagger(personal.CHARS, 2, hidden=8)
    losses = t.fit(ids, y, 12, batch=16, rate=2e-2)
    assert losses[-1] < losses[0] / 4
    long = "".join(r.choice("abc") for _ in range(200))
    got = t.decode([personal.char_ids(long), np.zeros(0, int)])
    (tags, sure), (none, _) = got
    assert np.mean(tags == np.array([c == "b" for c in long])) > 0.97 and len(none) == 0 and len(sure) == 200 and 0.5 < sure.mean() <= 1


@pytest.fixture(scope="module")
def small_model():
    old = personal.EXAMPLES, personal.EPOCHS
    yield
    personal.EXAMPLES, personal.EPOCHS = old


def test_places_and_plain_text():
    common = {"call", "me", "on", "or", "write", "to", "the", "dog", "signed"}
    hit = lambda t: bool(personal.possible_places(t, common))
    assert all(map(hit, ["call me on 555-010-9999", "write to a@b.test", "a at b dot test", "five five five, zero one", "to 12 Elm Road", "Elmstraße 4", "Signed, Rosa Ulbika", "signed, Rosa R.", "call Me Dog"]))
    text, common_name = "I met John Smith today", {"i", "met", "john", "smith", "today"}
    assert personal.possible_places(text, common_name)
    tags = np.array([0] * 6 + [9] + [10] * 9 + [0] * 6)
    of = lambda p: personal.spans(text, tags, np.full(len(text), p), common_name)
    assert of(0.99) == [(6, 16, "name")] and of(0.8) == [] and personal.spans(text, tags, np.full(len(text), 0.8), {"met"}) == [(6, 16, "name")]
    assert not any(map(hit, ["the dog", "", "Call me on 12 or 14", "the Pigohe dog"]))
    p, at = personal.plain("ca​fé Тom")
    assert p == "cafe Tom" and at == [0, 1, 3, 4, 5, 6, 7, 8]
    ids, tags = personal.examples(["A calm line here.", "Another one there."], 50)
    assert ids.shape == tags.shape == (50, tagger.LENGTH) and tags.max() > 0


def test_personal_information(spark, tmp_path, small_model):
    r = random.Random(9)
    calm = ["The vote ended 14 to 82, and the dog agreed.", "Thread 41 is off topic today.", "We keep the old thread open until May.", "Ticket ID 52336 is still open."]
    rows, want = [], set()
    for i in range(160):
        kind = r.randrange(6)
        value = [None, personal._email(r), personal._phone(r), "".join(personal._id(r)), personal._address(r), personal._name(r)][kind]
        frame = ["", "Contact: {}", "Call me on {}.", "They asked for my {}.", "He lives at {}.", "I went to school with {}."][kind]
        rows.append((i, r.choice(calm) + " " + frame.format(value) + " " + r.choice(calm), "k"))
        if kind:
            want.add((i, personal.KINDS[kind - 1]))
    rows += [(900, None, "k"), (901, "", "k"), (902, "long text " * 30_000, "k")]
    write(spark, tmp_path, "train", rows, "row_id bigint, body string, kind string")
    personal.EXAMPLES, personal.EPOCHS = 2500, 6
    found = {tuple(x) for x in personal.p7_found(spark, str(tmp_path)).collect()}
    assert len(found & want) / len(want) > 0.75 and len(found & want) / max(1, len(found)) > 0.85
    spans = personal.p7_spans(spark, str(tmp_path)).collect()
    text = {i: b for i, b, _ in rows}
    assert all(text[s.row_id][s.start : s.start + s.length] == s.value for s in spans)
    red = {x.row_id: x.body for x in personal.p7_redacted(spark, str(tmp_path)).collect()}
    assert set(red) == set(text) and red[900] is None and red[902] == text[902] and any("[PHONE]" in (b or "") for b in red.values())


def test_packing_is_exact(spark, tmp_path):
    r = random.Random(4)
    docs = [(i, " ".join(r.choices(["tree", "house", "river stone"], k=r.randint(3, 900))), "k") for i in range(200)] + [(900, "word " * 9000, "k"), (901, None, "k"), (902, "", "k"), (0, "repeat me", "k")]
    write(spark, tmp_path, "documents", docs, "doc_id bigint, text string, tokens string")
    rows = packing.p8_containers(spark, str(tmp_path)).collect()
    enc = packing.encoder()
    size = {}
    load, places = {}, {}
    for x in rows:
        size[x.doc_id] = size.get(x.doc_id, 0) + x.tokens
        load[x.container] = load.get(x.container, 0) + x.tokens
        places.setdefault(x.container, []).append(x.position)
    for i, t, _ in docs:
        if i:
            assert size[i] == (len(enc.encode_ordinary(t)) if t else 0)
    assert max(load.values()) <= packing.CAPACITY and all(sorted(p) == list(range(len(p))) for p in places.values())
    pieces = [x for x in rows if x.doc_id == 900]
    assert len(pieces) > 1 and all(x.tokens == packing.CAPACITY for x in pieces if x.piece < len(pieces) - 1)
    assert len(load) <= -(-sum(load.values()) // packing.CAPACITY) + 2
    write(spark, tmp_path, "documents", [], "doc_id bigint, text string, tokens string")
    assert packing.p8_containers(spark, str(tmp_path)).count() == 0


def test_step_groups_balance():
    loads = np.random.default_rng(1).integers(1, 2048, 64)
    g = packing.step_groups(loads)
    sums = np.bincount(g, loads)
    assert len(sums) == 8 and sums.max() / sums.min() < 1.2


def test_areas(spark, tmp_path):
    r = random.Random(8)
    topics = {"law": "court judge contract lawyer appeal verdict".split(), "cooking": "oven dough recipe garlic butter soup".split()}
    other = "post thread rule reply moderator sidebar".split()
    docs, want, labels = [], set(), []
    for i in range(240):
        mix = r.choice((["law"], ["cooking"], ["law", "cooking"], [], []))
        s = [" ".join(r.sample(topics[t], 3) + [f"n{r.randrange(300)}"]) for t in mix for _ in range(3)] + [" ".join(r.sample(other, 3) + [f"n{r.randrange(300)}"]) for _ in range(2)]
        r.shuffle(s)
        docs.append((i, ". ".join(s) + ".", "x"))
        want |= {(i, t) for t in mix}
        if i < 40:
            labels += [(i, t) for t in mix] or [(i, "none")]
    docs += [(900, None, "x"), (901, "", "x"), (902, "one two", "x")]
    write(spark, tmp_path, "documents", docs, "doc_id bigint, text string, subject string")
    write(spark, tmp_path, "subject_labels", [*labels, (None, "law"), (1, None)], "doc_id bigint, subject string")
    write(spark, tmp_path, "subjects", [("law", "Courts and the work of a lawyer."), ("cooking", "Food and a recipe.")], "subject string, description string")
    found = {tuple(x) for x in areas.p10_found(spark, str(tmp_path)).collect()}
    assert len(found & want) / len(want) > 0.95 and len(found & want) / len(found) > 0.95


def test_any_number_of_subjects(spark):
    names = [f"s{k:04}" for k in range(1500)]
    docs = spark.createDataFrame([(k, f"The w{k}a and w{k}b met. A w{k}b saw w{k}a here.") for k in range(1500)] + [(5000 + k, f"Later w{k}a came with w{k}b again.") for k in range(1500)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, names[k]) for k in range(1500)], "doc_id bigint, subject string")
    found = {(r.doc_id, r.subject) for r in areas.subject_shares(docs, labels, spark.createDataFrame([(n, "") for n in names], "subject string, description string")).filter("share >= 0.2").collect()}
    assert sum((5000 + k, names[k]) in found for k in range(1500)) > 1400 and len(found) < 3100


def test_graph_labels_are_clamped(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.5)], "a bigint, b bigint, w double")
    seeds = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (4, 2, 1.0)], "node bigint, label int, p double")
    got = {(r.node, r.label): r.p for r in areas.propagated(edges, seeds).collect()}
    assert got[1, 0] == got[1, 1] == 0.5 and got[4, 2] == 1.0 and got[2, 0] == got[2, 1] > 0.1 and got[3, 2] > got[3, 0] > 0



def test_labels_reach_all_documents_of_a_word(spark):
    cell = areas._Cells()
    words = [[f"s{k % 2}", *(f"own{k}x{j}" for j in range(12))] for k in range(400)]  # each pair of documents of a side shares one word
    rows = [(k, [13], [cell[w] for w in x], [k] if k < 2 else None, [1.0] if k < 2 else None) for k, x in enumerate(words)] + [(1000 + k, [1], [cell[f"o{k}"]], None, None) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lens array<int>, cells array<int>, allowed array<int>, q array<double>")
    frequency, n = areas.document_frequencies(docs)
    got = {r.doc_id: dict(zip(r.label, r.p, strict=True)) for r in areas.reached(docs, frequency, n, 2, 1).collect()}
    assert got[0] == {0: 1.0} and got[1] == {1: 1.0}
    assert all(got[k].get(k % 2, 0) > 0.5 and len(got[k]) == 1 for k in range(2, 400)) and not got[1000]


def test_tagger_reads_without_a_tape():
    """What decodes texts gives the scores that the model was fitted with, and the best path of each text."""
    m, r = tagger.Tagger(personal.CHARS, 5), np.random.default_rng(2)
    m.p["A"], m.p["S"] = r.standard_normal((5, 5)).astype(np.float32), r.standard_normal(5).astype(np.float32)
    ids = r.integers(0, 99, (7, 64))
    assert np.allclose(m.scores(ids), m.emissions(ids), atol=1e-5)
    texts = [r.integers(1, 99, n) for n in (5, 1, 3, 5, 0)]
    for x, (path, sure) in zip(texts, m.decode(texts), strict=True):
        assert len(path) == len(sure) == len(x)
        if len(x):
            e = m.emissions(np.pad(x, (0, 64 - len(x)))[None])[: len(x), 0]
            value = lambda p: m.p["S"][p[0]] + e[np.arange(len(x)), list(p)].sum() + sum(m.p["A"][a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
            assert tuple(path) == max(itertools.product(range(5), repeat=len(x)), key=value)
