"""Each operator against brute force, a round trip or held-out accuracy, and its edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arcloom.llm import bpe, chat, common, exact_topk, fingerprints, labelled, mixing, near_dedup, quality, substring_dedup, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
EXTRA = "score double, group_id long, rep string, key string, toxicity string, spans string, tokens string, weight int"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x" for _ in range(n)]


def table(spark, rows, extra=False):
    """rows of (doc_id, text, source)."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    if extra:
        return spark.createDataFrame([(*r, 0.5, 1, "a", "b", "c", "d", "e", 3) for r in full], f"{DOCS}, {EXTRA}")
    return spark.createDataFrame(full, DOCS)


AWKWARD = [
    (None, "no id but text " * 20, "a"), (1, None, "a"), (2, "", "b"), (3, "   \n ", None), (4, "one", "b"), (5, "two words", "a"),
    (6, "!!! ???", "a"), (7, " ".join(words(1, 30_000)), "b"), (8, "x" * 50_000, "a"), (9, "dup text here for all to see", "a"),
    (9, "dup text here for all to see", "a"), (10, "dup text here for all to see", "c"), (11, "été 中文 \U0001f600 " * 30, "c"),
]


@pytest.fixture(params=[False, True], ids=["plain", "clashing"])
def awkward(request, spark):
    return table(spark, AWKWARD, request.param)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1: near dedup -----------------------------------------------------------


def jaccard(a, b, k=near_dedup.SHINGLE):
    s = lambda w: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)


def planted(n=40):
    """Groups of near copies of very different sizes, among documents that are alone."""
    texts, r = [], random.Random(5)
    for g in range(n):
        base = words(1000 + g, r.choice([12, 40, 200, 900]), 5000)
        for c in range(r.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(len(w) // 60 * (c > 0)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            texts.append(w)
    return texts


def test_near_duplicates_against_brute_force(spark):
    texts = planted()
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(table(spark, [(i, " ".join(w), "a") for i, w in enumerate(texts)])).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= near_dedup.THRESHOLD}
    hit = sum(i in got and got.get(i) == got.get(j) for i, j in want)
    assert len(want) > 20 and hit >= 0.9 * len(want)
    for i, g in got.items():  # no group without a pair that proves it
        assert i == g or any(jaccard(texts[i], texts[j]) >= near_dedup.THRESHOLD for j in range(len(texts)) if j != i)


def test_large_group_keeps_one(spark):
    base = words(3, 100, 3000)
    rows = [(i, " ".join(base if i % 2 else [*base[:-1], f"t{i}"]), "a") for i in range(600)] + [(10_000, " ".join(words(4, 100, 3000)), "a")]
    left = near_dedup.deduplicate(table(spark, rows)).select("doc_id").collect()
    assert sorted(r[0] for r in left) == [0, 10_000]


def test_star_of_copies_around_a_middle_id_against_brute_force(spark):
    """Copies that reach the threshold with their original alone, which is neither least nor a neighbour."""
    base, r = words(77, 240, 5000), random.Random(8)
    texts = []
    for i in range(300):
        w = list(base)
        for at in r.sample(range(len(w)), r.randrange(18, 21) if i != 150 else 0):
            w[at] = f"edit{r.randrange(10**6)}"
        texts.append(w)
    texts += [words(900 + i, 100, 5000) for i in range(20)]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    near = [(i, j) for i in range(300) for j in range(i) if jaccard(texts[i], texts[j]) >= near_dedup.THRESHOLD]
    assert len([p for p in near if 150 not in p]) < 30 and sum(150 in p for p in near) > 290
    for i, j in near:
        a, b = root(i), root(j)
        top[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(table(spark, [(i, " ".join(w), "a") for i, w in enumerate(texts)])).collect()}
    of = {i: root(i) for i in range(len(texts))}
    assert got == {i: g for i, g in of.items() if list(of.values()).count(g) > 1}


def test_near_dedup_awkward(awkward):
    got = {(r["doc_id"], r["group_id"]) for r in near_dedup.near_duplicates(awkward).collect()}
    assert got == {(9, 9), (10, 9)}
    left = near_dedup.deduplicate(awkward)
    assert left.columns == awkward.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(ids, key=lambda x: -1 if x is None else x) == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11]


def test_near_dedup_versions_of_an_id_tie_groups(spark):
    a, b = " ".join(words(1, 60, 3000)), " ".join(words(2, 60, 3000))
    got = {(r["doc_id"], r["group_id"]) for r in near_dedup.near_duplicates(table(spark, [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x")])).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
    assert near_dedup.deduplicate(table(spark, [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x")])).count() == 1


def test_near_dedup_of_text_ids(spark):
    texts = planted(12)
    name = lambda i: f"d{i:04d}"
    df = spark.createDataFrame([(name(i), " ".join(w)) for i, w in enumerate(texts)] + [(None, "x y z")], "doc_id string, text string")
    plain = near_dedup.near_duplicates(table(spark, [(i, " ".join(w), "a") for i, w in enumerate(texts)])).collect()
    assert {tuple(r) for r in near_dedup.near_duplicates(df).collect()} == {(name(r[0]), name(r[1])) for r in plain}
    gone = sum(r[0] != r[1] for r in plain)
    assert gone and near_dedup.deduplicate(df).count() == len(texts) + 1 - gone


def test_a_hot_bucket_makes_no_pairs_within_a_group(spark):
    buckets = spark.createDataFrame([(1, i) for i in range(2000)] + [(2, 1), (2, 5000)], "key long, doc_id long")
    labels = spark.createDataFrame([(i, 0) for i in range(1999)], "node long, label long")
    got = near_dedup._untried(buckets, labels)
    assert got.count() == 1999 + 1 and got.where("a >= b").count() == 0


def test_near_dedup_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.deduplicate(empty).columns == empty.columns


def test_hyperminhash_estimate_and_correction():
    rng = np.random.default_rng(0)
    for n, share in ((2000, 0.5), (2000, 0.0), (300, 0.8)):
        common_ = rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64) * np.uint64(2)
        errors = []
        for _ in range(20):
            sets = [np.concatenate([common_, rng.integers(0, 1 << 63, n - len(common_)).astype(np.uint64) * np.uint64(2) + np.uint64(1)]) for _ in range(2)]
            reg = [near_dedup.registers(common.mix(s), np.zeros(n, int), 1) for s in sets]
            size = np.array([float(n)])
            errors.append(near_dedup.estimate(*reg, size, size)[0][0] - len(common_) / (2 * n - len(common_)))
        assert abs(np.mean(errors)) < 0.05


def test_collisions_are_what_disjoint_sets_have():
    rng = np.random.default_rng(1)
    n, equal = 5000, []
    for _ in range(300):
        a, b = (near_dedup.registers(common.mix(rng.integers(0, 1 << 63, n).astype(np.uint64)), np.zeros(n, int), 1) for _ in range(2))
        equal.append(((a == b) & (a != 0)).sum())
    want = near_dedup.expected_collisions(np.array([float(n)]), np.array([float(n)]))[0]
    assert abs(np.mean(equal) - want) < 4 * np.sqrt(want / 300) + 0.01


# --- 2: toxicity -------------------------------------------------------------


def toxic_corpus(n, seed):
    r = random.Random(seed)
    bad = ["grobnik", "vlatzer", "sorkhead"]
    out = []
    for i in range(n):
        w = words(seed * 10_000 + i, r.choice([20, 80, 400]), 900)
        y = i % 2
        for _ in range(y * max(2, len(w) // 60)):
            w[r.randrange(len(w))] = r.choice(bad)
        out.append((" ".join(w), y))
    return out


def test_toxicity_held_out_and_misspellings():
    train, test = toxic_corpus(300, 1), toxic_corpus(200, 2)
    model = toxicity.fit([t for t, _ in train], np.array([y for _, y in train]))
    score = model.score(pa.array([t for t, _ in test]))
    y = np.array([y for _, y in test])
    assert (score[y == 1] >= model.threshold).mean() > 0.95 and (score[y == 0] >= model.threshold).mean() < 0.02
    wrong = model.score(pa.array(["w1x w2x grobniik w4x", "w1x w2x sorkheadd w4x", "w1x w2x w3x w4x"]))
    assert min(wrong[:2]) > 0.5 > wrong[2]


def test_toxicity_of_a_short_insult_in_a_long_text():
    train = toxic_corpus(300, 1)
    model = toxicity.fit([t for t, _ in train], np.array([y for _, y in train]))
    long = words(77, 20_000, 900)
    long[15_000:15_002] = ["vlatzer", "sorkhead"]
    assert model.score(pa.array([" ".join(long)]))[0] >= model.threshold


def slow_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor % (1 << 64)
    return x


def slow_rows(word):
    """Rows of the table that a word (bytes) has, gram by gram."""
    v, p = b"<" + word + b">", 0x100000001B3
    h = lambda part: sum(c * pow(p, j, 1 << 64) for j, c in enumerate(part)) % (1 << 64)
    rows = [slow_mix((h(v[i : i + n]) + n) % (1 << 64)) % toxicity.BUCKETS for n in toxicity.NGRAMS for i in range(len(v) - n + 1)]
    return [*rows, slow_mix(h(v) ^ 0x5851F42D4C957F2D) % toxicity.BUCKETS]


def slow_toxicity(model, text):
    """The worst segment's probability, word by word."""
    w = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())
    size = toxicity.SEGMENT // 2
    halves = [w[i : i + size] for i in range(0, len(w), size)]
    worst = None
    for a, b in zip(halves, halves[1:]) if len(halves) > 1 else [(h, []) for h in halves]:
        gain = sum(float(model.weight[r]) for half in (a, b) for x in set(half) for r in slow_rows(x))
        logit = gain / sum(len(slow_rows(x)) for x in [*a, *b]) + model.bias
        worst = logit if worst is None else max(worst, logit)
    return 0.0 if worst is None else 1 / (1 + np.exp(-worst))


def test_toxicity_against_brute_force(spark):
    train = toxic_corpus(120, 5)
    model = toxicity.fit([t for t, _ in train], np.array([y for _, y in train]))
    texts = [t for t, _ in toxic_corpus(20, 6)] + ["", "one", "grobnik grobnik grobnik", "A b, c! d? e", "\u00e9t\u00e9 vlatzerr"]
    want = [slow_toxicity(model, t) for t in texts]
    assert np.allclose(model.score(pa.array(texts)), want, atol=1e-9)
    docs = table(spark, [(i, t, "a") for i, (t, _) in enumerate(train)] + [(1000 + i, t, "a") for i, t in enumerate(texts)])
    known = labels(spark, [(i, 1, y) for i, (_, y) in enumerate(train)])
    fitted = toxicity.train(docs, known)
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, known).collect()}
    for i, t in enumerate(texts):
        s = slow_toxicity(fitted, t)
        assert abs(rows[1000 + i]["toxicity"] - s) < 1e-5
        assert rows[1000 + i]["toxic"] == (rows[1000 + i]["toxicity"] >= fitted.threshold)
    kept = {r["doc_id"] for r in toxicity.remove_toxic(docs, known).collect()}
    assert kept == {i for i, r in rows.items() if not r["toxic"]}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_awkward(spark, awkward):
    train = toxic_corpus(120, 3)
    docs = awkward.unionByName(table(spark, [(100 + i, t, "a") for i, (t, _) in enumerate(train)]), allowMissingColumns=True)
    known = labels(spark, [(100 + i, 1, y) for i, (_, y) in enumerate(train)] + [(None, 1, 1), (100, None, None), (5000, 0, 1)])
    got = toxicity.toxicity(docs, known)
    assert got.columns == ["doc_id", "toxicity", "toxic"] and got.count() == docs.count()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["toxicity"] is None and not rows[1]["toxic"]
    assert rows[2]["toxicity"] == 0 and not rows[2]["toxic"]
    left = toxicity.remove_toxic(docs, known)
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert {None, 1, 2, 3, 4, 6, 7, 9, 10} <= ids and left.where("doc_id >= 100").count() <= 66


def test_toxicity_without_labels(spark, awkward, empty):
    none = labels(spark, [])
    assert toxicity.toxicity(awkward, none).where("toxicity is not null or toxic").count() == 0
    assert toxicity.remove_toxic(awkward, none).count() == awkward.count()
    one = labels(spark, [(4, 1, 0), (5, 1, 0)])
    assert toxicity.remove_toxic(awkward, one).count() == awkward.count()
    assert toxicity.toxicity(empty, one).count() == 0


def test_labelled_sample_is_bounded_and_balanced(spark):
    docs = table(spark, [(i, f"t{i}", "a") for i in range(50)])
    got = labelled.labelled_sample(docs, labels(spark, [(i, 1, int(i % 5 == 0)) for i in range(50)]), "toxic", 7).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 7, 1: 7}


def test_labelled_rows_are_bounded_and_ids_of_any_type(spark):
    known = spark.createDataFrame([("a", 1, 1), ("b", 0, 0)], "doc_id string, quality int, toxic int")
    docs = spark.createDataFrame([("a", f"version {i}") for i in range(500)] + [("b", "other")], "doc_id string, text string")
    assert sorted(map(tuple, labelled.labelled_sample(docs, known, "toxic", 5).collect())) == [("a", "version 0", 1), ("b", "other", 0)]
    numbers = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id int, quality int, toxic int")
    for kind in ("string", "long", "decimal(10,0)"):
        docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, text string").select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
        assert labelled.labelled_sample(docs, numbers, "toxic", 5).count() == 2
        assert quality.quality(docs, numbers).schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert toxicity.toxicity(docs, numbers).count() == 2


# --- 3: chat -----------------------------------------------------------------


def test_rotation(spark):
    rows = [(1, 2, "bo|b", "third"), (1, 0, "ann", "hi"), (1, 1, "bo|b", "you"), (2, 0, "ann", "é\U0001f600"), (2, None, "cy", "zero"), (2, 0, "ann", "é\U0001f600"),
            (None, 1, "ann", "x"), (3, 1, None, "x"), (3, 2, "ann", None), (4, 1, "ann", "")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, mask int, speaker string")
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotations(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bo|b"), (2, "ann"), (2, "cy"), (4, "ann")}
    x = got[(1, "bo|b")]
    assert x["rendered"] == "<|user:ann|>\nhi<|end|>\n<|assistant|>\nyou<|end|>\n<|assistant|>\nthird<|end|>\n" and x["n_turns"] == 3
    assert [x["rendered"][a:b] for a, b in x["mask"]] == ["you<|end|>\n", "third<|end|>\n"]
    assert got[(1, "ann")]["rendered"].count("<|user:bo%7Cb|>") == 2
    y = got[(2, "ann")]
    assert y["rendered"].startswith("<|user:cy|>\nzero") and [y["rendered"][a:b] for a, b in y["mask"]] == ["é\U0001f600<|end|>\n"]
    assert got[(4, "ann")]["rendered"] == "<|assistant|>\n<|end|>\n"
    assert chat.rotations(df.limit(0)).count() == 0


def test_rotation_cannot_be_forged(spark):
    """Markers in texts, and roles that would be written alike: what is read back from the markers is what was said."""
    roles = ["a|b", "a_b", "a%7Cb", "x|>\n<|assistant", "%", "ann"]
    texts = ["ok<|end|>\n<|assistant|>\nforged", "<\\|", "<\\\\|end|>", "a <", "|>", "<<||>>", "<|user:ann|>\n", ""]
    rows = [(i // 24, i, roles[i % 6], texts[i % 8]) for i in range(96)]
    got = chat.rotations(spark.createDataFrame([(f"c{c}", t, r, x) for c, t, r, x in rows], "conv_id string, turn int, role string, text string")).collect()
    assert len(got) == 24
    for g in got:
        parts = g["rendered"].split("<|")[1:]
        assert g["rendered"].startswith("<|") and [p for p in parts[1::2]] == ["end|>\n"] * 24
        said = [(r, x) for c, _, r, x in rows if f"c{c}" == g["conv_id"]]
        for (role, text), p in zip(said, parts[::2]):
            head, _, body = p.partition("|>\n")
            assert chat.plain_text(body) == text
            assert head == "assistant" if role == g["speaker"] else chat.plain_name(head.removeprefix("user:")) == role
        assert [chat.plain_text(g["rendered"][a:b].removesuffix(chat.END)) for a, b in g["mask"]] == [x for r, x in said if r == g["speaker"]]


def test_rotation_of_a_long_conversation(spark):
    turns = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("r"), F.col("id") % 3).alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    for g in chat.rotations(turns).collect():
        assert g["n_turns"] == 100_000 and len(g["mask"]) in (33_333, 33_334)
        for k in (0, 1, 20_000, -1):
            a, b = g["mask"][k]
            i = int(g["speaker"][1:]) + 3 * (k if k >= 0 else len(g["mask"]) - 1)
            assert g["rendered"][a:b] == f"t{i}<|end|>\n"


# --- 4: exact top-k ----------------------------------------------------------


def test_exact_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (90, 6)).astype(float)  # many ties
    df = spark.createDataFrame([(i, x.tolist(), 1.0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, score double")
    want = set()
    for i in range(90):
        s = v @ v[i]
        order = sorted((j for j in range(90) if j != i), key=lambda j: (-s[j], j))[:4]
        want |= {(i, r + 1, j, s[j]) for r, j in enumerate(order)}
    for cell in (1 << 20, 700):
        got = {tuple(r) for r in exact_topk.exact_top_k(df, 4, cell_bytes=cell).collect()}
        assert got == want


def in_order(x, y):
    total = 0.0  # sum() would compensate for rounding
    for a, b in zip(x, y):
        total += float(a) * float(b)
    return total


def nearest(v, k, names=None):
    """(query, rank, neighbour) by sums in the order of the components."""
    names, out = names or list(range(len(v))), set()
    for i, x in enumerate(v):
        s = [in_order(x, y) for y in v]
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[j], names[j]))[:k]
        out |= {(names[i], r + 1, names[j], s[j]) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("case", ["small", "large", "near ties", "mixed"])
def test_exact_top_k_of_any_size_of_vectors(spark, case, monkeypatch):
    monkeypatch.setattr(exact_topk, "TILE", 16)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(60, 4))
    if case == "small":
        v *= 1e-4
    elif case == "large":
        v *= 1e4
    elif case == "near ties":
        v = v[:1] + rng.normal(size=(60, 4)) * 1e-9
    else:
        v *= 10.0 ** rng.integers(-6, 6, (60, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for rows in (1000, 9):
        assert {tuple(r) for r in exact_topk.exact_top_k(df, 5, block_rows=rows).collect()} == nearest(v, 5)


def test_exact_top_k_ids_of_text_repeated_vectors_and_infinity(spark):
    v = [[1.0, 2.0]] * 20 + [[0.5, 0.0]]
    names = [f"v{i:02d}" for i in range(21)]
    rows = [*zip(names, v), ("w", [float("inf"), 0.0]), ("x", [0.0, float("-inf")])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    for n in (1000, 4):
        assert {tuple(r) for r in exact_topk.exact_top_k(df, 3, block_rows=n).collect()} == nearest(v, 3, names)
    huge = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e200, -1e200]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in exact_topk.exact_top_k(huge, 2).collect()}
    assert got[1, 1] == (3, 2e200) and got[1, 2] == (2, float("-inf"))


def test_exact_top_k_awkward(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in exact_topk.exact_top_k(df, 5).collect())
    assert got == [(1, 1, 8, 2.0), (1, 2, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 8, 0.0), (8, 1, 1, 2.0), (8, 2, 2, 0.0)]
    assert exact_topk.exact_top_k(df.limit(0), 5).count() == 0 and exact_topk.exact_top_k(df, 0).count() == 0


# --- 5: substring dedup ------------------------------------------------------


def brute_repeats(texts, window):
    """Spans by the definition, with documents in order of id."""
    owner, out = {}, []
    for i, w in sorted(texts.items()):
        hits = [p for p in range(len(w) - window + 1) if owner.get(tuple(w[p : p + window]), i) != i]
        for p in range(len(w) - window + 1):
            owner.setdefault(tuple(w[p : p + window]), i)
        spans = []
        for p in hits:
            o = owner[tuple(w[p : p + window])]
            if spans and p - spans[-1][3] <= window:
                spans[-1][1:] = [p + window, min(spans[-1][2], o), p]
            else:
                spans.append([p, p + window, o, p])
        out += [(i, a, b, o) for a, b, o, _ in spans]
    return sorted(out)


def repeating_corpus(seed, n, window):
    r = random.Random(seed)
    shared = [words(seed * 77 + i, r.randrange(window - 3, 3 * window), 60) for i in range(6)]
    out = {}
    for i in range(n):
        w = []
        for _ in range(r.randrange(1, 5)):
            w += r.choice(shared) if r.random() < 0.5 else words(seed * 999 + i * 13 + len(w), r.randrange(1, 40), 60)
        if r.random() < 0.1:
            w += ["again"] * (2 * window)
        out[i] = w
    return out


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_repeats_against_brute_force(spark, batches):
    texts = repeating_corpus(batches, 60, 12)
    df = table(spark, [(i, " ".join(w), "a") for i, w in texts.items()])
    got = sorted(tuple(r) for r in substring_dedup.repeated_passages(df, window=12, gram=6, batches=batches).collect())
    assert got == brute_repeats(texts, 12)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_index_compacts_survives_and_is_extended(spark, kind):
    """Five calls on one folder, each as a new job would open it."""
    texts = repeating_corpus(9, 50, 12)
    path = common.shared_dir(spark, "index")
    name = (lambda i: f"doc{i:03d}") if kind == "string" else (lambda i: i)
    spans = []
    for b in range(5):
        batch = spark.createDataFrame([(name(i), " ".join(w)) for i, w in texts.items() if i // 10 == b], f"doc_id {kind}, text string")
        spans += [tuple(r) for r in substring_dedup.repeated_passages(batch, window=12, gram=6, batches=1, index=path).collect()]
        for r in spark.catalog.listTables():  # a new job's session knows no tables
            if r.name.startswith("arcloom_"):
                spark.sql(f"DROP TABLE {r.name}")
    assert sorted(spans) == [(name(i), x, y, name(o)) for i, x, y, o in brute_repeats(texts, 12)]
    index = substring_dedup.FingerprintIndex(spark, path, 12, 6)
    for kind_ in substring_dedup.RUNS:
        assert index.runs(kind_) == [(0, 3), (4, 4)]


def test_a_batch_lost_half_way_is_done_again(spark, monkeypatch):
    texts = repeating_corpus(10, 40, 12)
    path = common.shared_dir(spark, "index")
    half = [spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items() if i // 20 == b], "doc_id long, text string") for b in (0, 1)]
    first = substring_dedup.repeated_passages(half[0], window=12, gram=6, batches=1, index=path).collect()
    with monkeypatch.context() as m:
        m.setattr(substring_dedup.FingerprintIndex, "_islands", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            substring_dedup.repeated_passages(half[1], window=12, gram=6, batches=1, index=path)
    second = substring_dedup.repeated_passages(half[1], window=12, gram=6, batches=1, index=path).collect()
    assert sorted(map(tuple, first + second)) == brute_repeats(texts, 12)


def test_history_is_neither_shuffled_nor_sorted(spark):
    texts = repeating_corpus(11, 30, 12)
    index = substring_dedup.FingerprintIndex(spark, common.shared_dir(spark, "index"), 12, 6)
    index.add(table(spark, [(i, " ".join(w), "a") for i, w in texts.items()]).select("doc_id", "text"))
    new = spark.createDataFrame([(1, 100)], "fp long, doc_id long")
    with index._planned():
        plan = index._state(new, "bigint")._jdf.queryExecution().executedPlan().toString()
        union = index._read("fp", (0, 0), "bigint").union(index._read("fp", (0, 0), "bigint")).groupBy("fp").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Bucketed: true" in plan
    assert "Exchange" not in union


def test_registered_batches_compact_and_index_the_last(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    monkeypatch.setattr(substring_dedup, "shared_dir", lambda *_: path)
    rows = [(i, " ".join([*words(i, 60), *words(4321, 55)]), "a") for i in range(24)]
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert sorted((r["doc_id"], r["owner_id"]) for r in got) == [(i, 0) for i in range(1, 24)]
    last = substring_dedup.BATCHES - 1
    for kind in ("fp", "win"):
        runs = substring_dedup.FingerprintIndex(spark, path).runs(kind)
        assert any(b > a for a, b in runs) and runs[-1][1] == last


def test_remove_repeats(spark):
    shared = " ".join(words(1, 60, 3000))
    rows = [(1, "Head one. " + shared + " tail.", "a"), (2, "Other start, " + shared + "! Other end", "a"), (3, "clean é text", "a"), (4, shared, "b")]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(table(spark, rows)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1]
    assert got[2]["text"] == "Other start, Other end" and got[2]["n_chars"] == len("Other start, Other end")


def test_substring_awkward(awkward, empty):
    assert substring_dedup.repeated_passages(awkward).count() == 0
    left = substring_dedup.remove_repeats(awkward)
    assert left.columns == awkward.columns and left.count() == awkward.count()
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(map(str, awkward.select("doc_id", "text").collect()))
    assert substring_dedup.repeated_passages(empty).count() == 0 and substring_dedup.remove_repeats(empty).count() == 0


def test_versions_of_an_id_do_not_repeat_each_other(spark):
    shared = " ".join(words(1, 80, 3000))
    df = table(spark, [(1, shared, "a"), (1, "x " + shared, "a"), (1, shared, "a"), (2, "y " + shared, "a")])
    assert [tuple(r) for r in substring_dedup.repeated_passages(df, batches=1).collect()] == [(2, 1, 81, 1)]


# --- 6: mixing ---------------------------------------------------------------


def brute_mix(rows, weights, budget, seed="mix-1"):
    import hashlib

    by = {}
    for i, t, s in rows:
        key = hashlib.md5((("" if i is None else str(i)) + f"/{seed}/" + (t or "")).encode()).hexdigest()
        by.setdefault(s, []).append((key, -1 if i is None else i, len((t or "").split())))
    timed = []
    for s, items in by.items():
        w = weights.get(s, 1.0)
        if w <= 0:
            continue
        upto = 0
        for key, i, n in sorted(items):
            upto += n
            timed.append((upto / w, "" if s is None else s, key, i, n))
    out, total = [], 0
    for x in sorted(timed):
        total += x[4]
        if total > budget:
            break
        out.append(x)
    return out


def test_mix_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["t"] * r.randrange(0, 50)), r.choice("aaabc")) for i in range(400)]
    weights = {"a": 1.0, "b": 3.0, "c": 0.5}
    df = table(spark, rows)
    total = sum(len(t.split()) for _, t, _ in rows)
    for budget in (0, total // 3, total, 10 * total):
        want = brute_mix(rows, weights, budget)
        got = mixing.schedule(df, weights, budget_tokens=budget).collect()
        assert [(x["virtual_finish"], x["source"], x["doc_id"], x["tokens"]) for x in got] == [(v, s, i, n) for v, s, _, i, n in want]
        assert [x["doc_id"] for x in mixing.mix(df, weights, budget_tokens=budget).collect()] == [x[3] for x in want]


def test_mix_counts_rows_that_are_alike_each(spark):
    """Null ids of one text and of many, and zero tokens at one time, at any budget."""
    rows = [(None, "ten " * 10, "a")] * 1000 + [(None, "x " * (i % 7), "b") for i in range(50)] + [(7, "one two", "c")] * 3
    df = table(spark, rows)
    total = sum(len(t.split()) for _, t, _ in rows)
    for budget in (0, 15, total // 2, total - 1, total):
        want = brute_mix(rows, {"b": 2.0}, budget)
        got = mixing.schedule(df, {"b": 2.0}, budget_tokens=budget).collect()
        assert [(x["virtual_finish"], x["source"], x["tokens"]) for x in got] == [(v, s, n) for v, s, _, _, n in want]
        mixed = mixing.mix(df, {"b": 2.0}, budget_tokens=budget).collect()
        assert [(x["source"], len(x["text"].split())) for x in mixed] == [(s, n) for _, s, _, _, n in want]
    assert 400 < len(brute_mix(rows, {"b": 2.0}, total // 2)) < 600


def test_mix_cut_among_rows_of_one_time(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    rows = [(i, "" if i % 5 else "a b c", f"s{i % 4}") for i in range(40)]
    for budget in range(0, 26):
        want = [x[3] for x in brute_mix(rows, {}, budget)]
        assert [x["doc_id"] for x in mixing.schedule(table(spark, rows), {}, budget_tokens=budget).collect()] == want


def test_mix_small_bins_find_the_same_cut(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, " ".join(["t"] * r.randrange(0, 50)), r.choice("ab")) for i in range(300)]
    want = [x["doc_id"] for x in mixing.schedule(table(spark, rows), {"a": 2.0}).collect()]
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    monkeypatch.setattr(mixing, "BINS", 4)
    assert [x["doc_id"] for x in mixing.schedule(table(spark, rows), {"a": 2.0}).collect()] == want


def test_mix_awkward(awkward, empty):
    got = mixing.schedule(awkward, {"a": 1.0, "b": 0.0}, budget_tokens=10**9)
    assert got.count() == awkward.where("source is null or source <> 'b'").count()
    left = mixing.mix(awkward, {"a": 1.0, "b": 0.0}, budget_tokens=10**9)
    assert left.columns == awkward.columns and left.count() == got.count()
    assert mixing.schedule(empty).count() == 0 and mixing.mix(empty).columns == empty.columns


def test_mix_follows_weights(spark):
    rows = [(i, "t " * 10, "ab"[i % 2]) for i in range(2000)]
    got = {r["source"]: r["count"] for r in mixing.schedule(table(spark, rows), {"a": 3.0}, share=0.5).groupBy("source").count().collect()}
    assert abs(got["a"] / got["b"] - 3) < 0.05


# --- 7 and 10: tokens --------------------------------------------------------

ALPHABET = ["a", "the", " ", "  ", "\n", "'", "'re", "é", "中", "12", "!!", "...", "\t", " \n ", "word", "'l", "l", "\U0001f600", "zzzz"]


def messy(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(ALPHABET) * r.choice([1, 1, 1, 6]) for _ in range(n))


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (16, 4), (64, 16)])
def test_stitching_gives_the_whole_texts_tokens(chunk, overlap):
    c = bpe.codec()
    for seed in range(150):
        text = messy(seed, random.Random(seed).randrange(1, 200))
        zones = [bpe.zones(c.boundaries(p, 0, len(p)), i, len(p), chunk, overlap) for i, p in bpe.cut(text, chunk, overlap)]
        cuts = bpe.stitch(c, text, [h for h, _ in zones], [t for _, t in zones], chunk, overlap)
        whole = c.encode(text)
        assert np.concatenate([c.encode(text[a:b]) for a, b in zip(cuts, cuts[1:])]).tolist() == whole.tolist()
        assert c.decode(whole).decode() == text


def test_no_boundary_in_a_chunk_joins_it():
    c = bpe.codec()
    text = "start " + "z" * 500 + " end of it"
    zones = [bpe.zones(c.boundaries(p, 0, len(p)), i, len(p), 32, 8) for i, p in bpe.cut(text, 32, 8)]
    cuts = bpe.stitch(c, text, [h for h, _ in zones], [t for _, t in zones], 32, 8)
    assert np.concatenate([c.encode(text[a:b]) for a, b in zip(cuts, cuts[1:])]).tolist() == c.encode(text).tolist()


def test_encode_count_decode_round_trip(spark, awkward):
    extra = [(200 + i, messy(i, 300), "a") for i in range(20)] + [(201, messy(1, 300), "a")]
    docs = awkward.unionByName(table(spark, extra), allowMissingColumns=True)
    c = bpe.codec()
    for kw in ({}, {"huge": 100, "chunk": 64, "overlap": 16}):
        enc = bpe.encode(docs, **kw)
        assert enc.columns == ["doc_id", "tokens"]
        key = lambda r: (str(r[0]), str(r[1]))
        back = sorted((tuple(r) for r in bpe.decode(enc).collect()), key=key)
        assert back == sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=key)
        want = sorted((str(r["doc_id"]), -1 if r["text"] is None else len(c.encode(r["text"]))) for r in docs.collect())
        assert sorted((str(r["doc_id"]), -1 if r["n_tokens"] is None else r["n_tokens"]) for r in token_counts.token_counts(docs, **kw).collect()) == want
        assert sorted((str(r["doc_id"]), -1 if r["tokens"] is None else len(r["tokens"])) for r in enc.collect()) == want


def test_tokens_match_the_vocabularys_own_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["Hello there, it's 2024!  New  lines\n\n ok", "é中\U0001f600 <|endoftext|>", messy(3, 100)]
    got = {r["doc_id"]: r["tokens"] for r in bpe.encode(table(spark, [(i, x, "a") for i, x in enumerate(texts)])).collect()}
    assert [got[i] for i in range(3)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_op10_gives_the_decoded_bytes(spark, awkward, sf_dir):
    from arcloom.llm import queries

    texts = {(r["doc_id"], None if r["text"] is None else r["text"].encode()) for r in awkward.collect()}
    assert {(r["doc_id"], None if r["decoded"] is None else bytes(r["decoded"])) for r in bpe.with_bytes(bpe.encode(awkward)).collect()} == texts
    assert "decoded" in queries.queries()["op10_bpe"](spark, sf_dir).columns


def test_tokens_empty(empty):
    assert bpe.encode(empty).count() == 0 and token_counts.token_counts(empty).count() == 0
    assert bpe.with_bytes(bpe.encode(empty)).count() == 0 and bpe.decode(bpe.encode(empty)).count() == 0


# --- 8: fingerprints ---------------------------------------------------------


def test_fingerprints_estimates(spark):
    a, b = words(1, 3000, 10**6), words(2, 3000, 10**6)
    rows = [(1, " ".join(a), "x"), (2, " ".join(a[:1500] + b[:1500]), "x"), (3, " ".join(a[:1000]), "y")]
    s = fingerprints.fingerprints(table(spark, rows), k=256).select("doc_id", "sketch", "n_distinct")
    got = {r["doc_id"]: r for r in s.collect()}
    assert abs(got[1]["n_distinct"] / 2997 - 1) < 0.25 and got[3]["sketch"] == sorted(got[3]["sketch"])
    x = s.toDF("a", "sa", "na").crossJoin(s.toDF("b", "sb", "nb")).select("a", "b", fingerprints.resemblance(F.col("sa"), F.col("sb"), 256).alias("r"), fingerprints.containment(F.col("sa"), F.col("sb"), 256).alias("c"))
    est = {(r["a"], r["b"]): r for r in x.collect()}
    assert abs(est[1, 2]["r"] - 1 / 3) < 0.12 and est[1, 1]["r"] == 1 and est[3, 1]["c"] > 0.95 and abs(est[1, 3]["c"] - 1 / 3) < 0.15


def test_sketches_merge(spark):
    rows = [(i, " ".join(words(i, 60)), "ab"[i % 2] if i else None) for i in range(20)]
    docs = table(spark, rows)
    s = fingerprints.fingerprints(docs).join(docs.select("doc_id", "source"), "doc_id")
    got = {r["source"]: r["sketch"] for r in fingerprints.merged(s, "source").collect()}
    for source in (None, "a", "b"):
        want = fingerprints.bottom({h for i, t, x in rows if x == source for h in fingerprints.shingle_hashes(t)[0]})
        assert got[source] == want


@pytest.mark.parametrize("block", [7, 1000])
def test_document_pairs_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(fingerprints, "AT_ONCE", 50)
    r, base = random.Random(4), words(31, 60, 300)
    rows = [(i, " ".join(base[: r.randrange(1, 60)] + words(700 + i, r.randrange(60), 300)), f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, rows[i][1], "s3") for i in range(5)] + [(100, rows[0][1], "s3"), (3, rows[9][1], None), (None, rows[1][1], "s1"), (200, "", "s1"), (201, None, "s4")]
    k = 16
    sketch = {(i, tuple(fingerprints.bottom(fingerprints.shingle_hashes(t)[0], k))) for i, t, _ in rows if i is not None and t}
    want = []
    for i, a in sketch:
        for j, b in sketch:
            if i < j and set(a) & set(b):
                u = set(sorted(set(a) | set(b))[:k])
                both, own, other = len(u & set(a) & set(b)), len(u & set(a)), len(u & set(b))
                want.append((i, j, both / len(u), both / own if own else None, both / other if other else None))
    docs = table(spark, rows)
    got = fingerprints.document_pairs(docs, k=k, block=block).collect()
    assert len(want) > 100 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    merged = {x["source"]: x["sketch"] for x in fingerprints.source_sketches(docs, k=k).collect()}
    for s in {s for _, _, s in rows}:
        assert merged[s] == fingerprints.bottom({h for _, t, x in rows if x == s and t for h in fingerprints.shingle_hashes(t)[0]}, k)


def test_document_pairs_and_source_sketches_are_registered(spark, empty, sf_dir):
    from arcloom.llm import queries

    assert {"op8_document_pairs", "op8_source_sketches"} <= set(queries.queries())
    assert fingerprints.document_pairs(empty).count() == 0 and fingerprints.source_sketches(empty).count() == 0
    assert queries.queries()["op8_document_pairs"](spark, sf_dir).where("resemblance = 1").count() > 0


def test_fingerprints_against_brute_force(spark, awkward):
    """The vectorised hashes against the definition, one shingle after the other."""
    docs = awkward.unionByName(table(spark, [(300 + i, messy(i, 200), "a") for i in range(20)]), allowMissingColumns=True)
    want = []
    for r in docs.select("doc_id", "text").collect():
        if r["text"] is None:
            want.append((r["doc_id"], None, None))
            continue
        h, half = fingerprints.shingle_hashes(r["text"])
        u, f, g = (set(fingerprints.bottom(x)) for x in (h, h[:half], h[half:]))
        want.append((r["doc_id"], sorted(u), len(u & f & g) / len(u) if f and g else None))
    got = [(r["doc_id"], r["sketch"], r["self_resemblance"]) for r in fingerprints.fingerprints(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_fingerprints_awkward(awkward, empty):
    rows = [r for r in fingerprints.fingerprints(awkward).collect()]
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["sketch"] is None and by[1]["n_distinct"] is None
    assert by[2]["sketch"] == [] and by[2]["n_distinct"] == 0 and by[2]["self_resemblance"] is None
    assert by[4]["n_distinct"] == 1 and by[4]["self_containment"] is None
    assert fingerprints.fingerprints(empty).count() == 0 and fingerprints.merged(fingerprints.fingerprints(empty), "doc_id").count() == 0


# --- 9: quality --------------------------------------------------------------


def quality_corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = words(seed * 1000 + i, r.choice([30, 200]))
        kind = i % 4
        if kind == 1:
            w = [x + r.choice(["!!", "###", "$$$"]) for x in w]
        elif kind == 2:
            w = [w[0]] * len(w)
        elif kind == 3:
            w = [x.upper() + " |" for x in w]
        out.append((" ".join(w), int(kind == 0)))
    return out


def test_quality_held_out():
    train, test = quality_corpus(300, 1), quality_corpus(300, 2)
    x = lambda rows: quality.features(*common.buffers(pa.array([t for t, _ in rows])))
    model = quality.fit(x(train), np.array([y for _, y in train]))
    s, y = quality.score(model, x(test)), np.array([y for _, y in test])
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.98


def test_quality_quantile_is_exact(spark):
    rows = quality_corpus(200, 3)
    docs = table(spark, [(i, t, "a") for i, (t, _) in enumerate(rows)])
    known = labels(spark, [(i, y, 0) for i, (_, y) in enumerate(rows)])
    got = quality.quality(docs, known).toPandas()
    assert abs((~got["keep"]).mean() - 0.75) < 0.03
    y = np.array([y for _, y in rows])
    assert got.sort_values("doc_id")["keep"].to_numpy()[y == 1].mean() > 0.97
    assert quality.quality(docs, known, quantile=0.0).where("not keep").count() == 0


def slow_features(text):
    b = text.encode()
    w = [m for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", b)]
    low = [m.group().lower() for m in w]
    n, total = max(len(w), 1), max(len(b), 1)
    chars = [bytes([c]) for c in b]
    upper, lower = sum(c.isupper() for c in chars), sum(c.islower() for c in chars)
    is_mark = [c[0] < 128 and not c.isalnum() and not c.isspace() and c not in (b"\x1c", b"\x1d", b"\x1e", b"\x1f") for c in chars]
    return [
        np.log1p(len(w)), sum(map(len, low)) / n, sum(is_mark) / total, upper / total / max((upper + lower) / total, 1e-6), sum(c.isdigit() for c in chars) / total,
        sum(c.isspace() for c in chars) / total, sum(c[0] > 127 for c in chars) / total, len(set(low)) / n / (1 + 0.1 * np.log(n)),
        sum(x == y for x, y in zip(low, low[1:])) / n, max((low.count(x) for x in set(low)), default=0) / n,
        sum(is_mark[i] and chars[i] == chars[i - 1] for i in range(1, len(chars))) / total, b.count(b"|") / total, np.log1p(b.count(b"\n") / n),
        sum(len(x) > 20 for x in low) / n, sum(m.group()[:2].isupper() and len(m.group()) > 1 and m.group()[:2].isalpha() for m in w) / n,
    ]


def test_quality_against_brute_force(spark):
    """Features one text at a time, the fit by plain gradient descent, the threshold from all scores in order."""
    rows = quality_corpus(80, 6)
    texts = [t for t, _ in rows] + ["A", "A!", "!! x", "B ||", "\u00e9 1 22 333\n\n", "x" * 30]
    y = np.array([y for _, y in rows])
    x = quality.features(*common.buffers(pa.array(texts, pa.large_string())))
    assert np.allclose(x, [slow_features(t) for t in texts])
    pairs = 1500
    model = quality.fit(x[: len(y)], y, pairs)
    rng = np.random.default_rng(0)
    mean, scale = x[: len(y)].mean(0), np.maximum(x[: len(y)].std(0), 1e-6)
    z = np.clip((x[: len(y)] - mean) / scale, -6, 6)
    d = z[rng.choice(np.flatnonzero(y == 1), pairs)] - z[rng.choice(np.flatnonzero(y == 0), pairs)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + quality.RIDGE / 2 * w @ w
    w = np.zeros(d.shape[1])
    for _ in range(4000):
        w -= 0.3 * (d.T @ (1 / (1 + np.exp(-(d @ w))) - 1) / pairs + quality.RIDGE * w)
    assert loss(model[2]) <= loss(w) + 1e-6 and np.corrcoef(z @ model[2], z @ w)[0, 1] > 0.99
    docs = table(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(2, texts[2], "b")] * 3)
    got = quality.quality(docs, labels(spark, [(i, int(v), 0) for i, v in enumerate(y)]), quantile=0.4, pairs=pairs).collect()
    cells = sorted(int(np.floor(r["score"] * quality.RES)) for r in got)
    at = max(c for c in cells if sum(other < c for other in cells) <= 0.4 * len(cells))
    assert [r["keep"] for r in got] == [int(np.floor(r["score"] * quality.RES)) >= at for r in got]  # those at the threshold stay
    direct = quality.score(model, x)
    assert all(abs(r["score"] - direct[r["doc_id"]]) < 1e-6 for r in got)


def test_quality_awkward(spark, awkward, empty):
    rows = quality_corpus(60, 4)
    docs = awkward.unionByName(table(spark, [(100 + i, t, "a") for i, (t, _) in enumerate(rows)]), allowMissingColumns=True)
    known = labels(spark, [(100 + i, y, 0) for i, (_, y) in enumerate(rows)] + [(None, 1, 0), (100, None, 0)])
    got = quality.quality(docs, known)
    assert got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["score"] is None and not by[1]["keep"] and by[2]["score"] is None
    assert quality.quality(awkward, labels(spark, [])).where("keep").count() == awkward.count()
    assert quality.quality(empty, known).count() == 0
