"""Cases in which an operator once did less than the whole job."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute  # noqa: E402
from reportlake.llm import common, components, decontaminate, language, lines, minhash, neighbours, packing, pii, quality, queries, suffixes
from reportlake.llm.common import WordRows, labelled_texts
from test_operators import docs_of, text_of

# ---- 7


def most_similar(text, item):
    """(overlap, total) of the most similar of all item-sized windows."""
    s, i = brute.shingles(text), brute.shingles(item)
    found = []
    for start in range(max(1, len(s) - len(i) + 1)):
        w = s[start : start + len(i)]
        both = sum((Counter(w) & Counter(i)).values())
        found.append((both / (len(w) + len(i) - both), both, len(w) + len(i) - both))
    return max(found)[1:]


def test_decontamination_compares_windows_that_no_shingle_aligns(spark):
    rng = random.Random(21)
    a, b = text_of(rng, 40).split(), text_of(rng, 104).split()
    near = b[:4] + ["x"] + b[5:52] + text_of(rng, 10).split() + b[52:99] + ["y"] + b[100:]
    bench = [" ".join(a), " ".join(b)]
    texts = [text_of(rng, 60) + " " + " ".join(a[20:] + a[:20]) + " " + text_of(rng, 60), " ".join(near), " ".join(a[20:] + a[:20])]
    for _ in range(40):
        w = list(rng.choice((a, b)))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = text_of(rng, rng.randint(1, 4)).split()
        texts.append(" ".join(text_of(rng, rng.randint(1, 9)).split() + w + text_of(rng, rng.randint(1, 9)).split()))
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    want = {(d, i): m for d, t in enumerate(texts) for i, x in enumerate(bench) if 100 * (m := most_similar(t, x))[0] >= 75 * m[1]}
    got = {(r.doc_id, r.item_id): (r.overlap, r.total) for r in decontaminate.find(docs_of(spark, texts), items).collect()}
    assert {(0, 0), (1, 1)} <= set(want) and got == want

# ---- 4


def test_neighbours_of_rows_repeated_often(spark):
    schema, rng = "vec_id long, embedding array<double>", np.random.default_rng(4)
    x = rng.normal(size=(6, 8)) + 3 * np.eye(8)[0]
    x[1] = x[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [k for k in np.lexsort((np.arange(6), -np.round(u @ u[0], 12))).tolist() if k != 0][:5]
    for often in (0, want[0], want[1]):  # the query's own row, one that equals it, another near one
        rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(10 if i == often else 1)]
        got = neighbours.nearest(spark.createDataFrame(rows, schema).coalesce(1), F.col("vec_id") == 0).toPandas().sort_values("rank")
        assert got["vec_id"].tolist() == want and got["rank"].tolist() == [1, 2, 3, 4, 5]
    # a query's id under ten vectors hides no other row
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, (x[0] + d * np.eye(8)[1]).tolist()) for d in np.arange(1, 10) / 1000]
    got = neighbours.nearest(spark.createDataFrame(rows, schema).coalesce(1), F.col("vec_id") == 0).toPandas()
    assert set(got["query_id"]) == {0} and got["rank"].max() == 5 and 0 not in set(got["vec_id"])


def most_joined(spark, run):
    """What run() returns, and the rows of the join that made the most meanwhile."""
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = {e.executionId() for e in listed(store.executionsList())}
    out, made = run(), [0]
    bus.waitUntilEmpty()
    for k in {e.executionId() for e in listed(store.executionsList())} - before:
        values, it = {}, store.executionMetrics(k).iterator()
        while it.hasNext():
            pair = it.next()
            values[pair._1()] = pair._2()
        for node in listed(store.planGraph(k).allNodes()):
            if "Join" in node.name():
                made += [int(values.get(m.accumulatorId(), "0").replace(",", "")) for m in listed(node.metrics()) if m.name() == "number of output rows"]
    return out, max(made)


def test_neighbours_join_rows_of_a_group_not_its_pairs(spark):
    schema, rng, joined = "vec_id long, embedding array<double>", np.random.default_rng(8), {}
    for size in (300, 900):
        x = np.concatenate([rng.normal(size=32) + 0.001 * rng.normal(size=(size, 32)), rng.normal(size=(200, 32))])
        u, n = x / np.linalg.norm(x, axis=1, keepdims=True), size
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], schema)
        got, joined[size] = most_joined(spark, lambda: neighbours.nearest(vectors, F.col("vec_id") % 5 == 0).toPandas().sort_values(["query_id", "rank"]))  # noqa: B023
        s = u[:n] @ u.T
        s[np.arange(n), np.arange(n)] = -2
        want = {q: np.argsort(-s[q])[:5].tolist() for q in range(0, n, 5)}
        found = {q: g["vec_id"].tolist() for q, g in got.groupby("query_id")}
        assert all(found[q] == w for q, w in want.items()) and len(found) == (n + 200) // 5
    assert joined[900] <= 4 * joined[300] and joined[900] < 900 * 180


def test_cells_dealt_into_blocks_lose_no_pair(spark, monkeypatch):
    for name, value in (("LIST", 20), ("ROWS", 7), ("QUERIES", 2)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(6, 32)), 50, axis=0) + rng.normal(size=(300, 32)) * rng.choice([0, 0.02, 0.1, 0.3], size=(300, 1))
    index, units = neighbours.learn(x), neighbours.unit(x)
    codes = index.codes(units)
    rows = neighbours.encoded(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>"), index).withColumn("row", F.col("k")).cache()
    close = {q: [r for r in range(300) if neighbours.hamming(codes[q], codes[r]) <= neighbours.first_radius()] for q in range(0, 300, 10)}
    for few in (False, True):
        got = neighbours.substring_search(rows, rows.where("k % 10 = 0"), 5, few).toPandas()
        assert not got.duplicated(["q", "vec_id"]).any()
        for q, g in got.groupby("q"):
            kept = set(g["vec_id"])
            best = sorted(close[q], key=lambda r: -round(units[q] @ units[r], 12))[:5]
            assert set(best) <= kept <= set(close[q]) and (few or len(kept) == len(close[q]))
        assert got["q"].nunique() == 30
        assert few == (len(got) < sum(map(len, close.values())))

# ---- 1


def test_pii_adds_addresses_and_passwords_without_a_digit(spark):
    rng = random.Random(31)
    held = {"john.doe (at) example.com": "email", "anna [at] site.org": "email", "password=correcthorse": "secret"}
    texts = [text_of(rng, 12) + " " + x + " " + text_of(rng, 12) for x in held]
    rows = pii.find(docs_of(spark, texts)).orderBy("doc_id").collect()
    got = [[(s.kind, t[s.start : s.end], s.base) for s in r.spans] for r, t in zip(rows, texts)]
    assert got == [[(kind, x, False)] for x, kind in held.items()]
    assert not pii.plausible(0, "wordat.word") and not pii.plausible(0, "thinanat")

# ---- 10


def plain_train(texts, labels, size):
    """quality.train with every text's counts in plain dicts, all held at once."""
    rng = np.random.default_rng(quality.SEED)
    vectors, weights, bias = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (size, quality.DIM)), np.zeros((quality.DIM, 2)), np.zeros(2)
    rows = []
    for text in texts:
        counts = Counter()
        for w, c in Counter((text or "").encode().split()).items():
            found = quality.buckets(w, size)
            for b in found if len(w) <= quality.LONG else found[:1] + sorted(found[1 : 1 + len(w)]) + sorted(found[1 + len(w) :]):
                counts[b] += c
        share = np.array(list(counts.values()), dtype=np.float64)
        rows.append((np.array(list(counts), dtype=np.int64), share / max(1.0, share.sum())))
    at = 0
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            lr = quality.RATE * (1 - at / (quality.EPOCHS * len(rows)))
            at += 1
            hidden = share @ vectors[ids]
            z = hidden @ weights + bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            p[labels[i]] -= 1
            back = weights @ p
            weights -= lr * np.outer(hidden, p)
            bias -= lr * p
            vectors[ids] -= lr * len(ids) ** 0.5 * share[:, None] * back
    return vectors, weights, bias


@pytest.mark.parametrize("kept_mb", [quality.KEPT_MB, 0.01, 0])
@pytest.mark.parametrize("run", [quality.RUN, 3])
def test_quality_learns_the_same_whatever_is_kept(monkeypatch, kept_mb, run):
    monkeypatch.setattr(quality, "KEPT_MB", kept_mb)
    monkeypatch.setattr(quality, "RUN", run)
    rng = random.Random(3)
    texts = [None, "", " \t\x0b\x0c\r\n", "a", "a\x1cb c\x85d é 漢字 \x00", "x" * 64 + " " + "x" * 65 + " y " + "xy" * 200 + " y"]
    texts += [" ".join("".join(rng.choices("abcé漢", k=rng.choice([1, 2, 3, 9, 70]))) for _ in range(rng.randrange(40))) for _ in range(40)]
    labels = [rng.randrange(2) for _ in texts]
    for size in (256, quality.BUCKETS):
        model = quality.train(texts, labels, size=size)
        for got, want in zip((model.vectors, model.weights, model.bias), plain_train(texts, labels, size)):
            assert np.abs(got - want).max() < 1e-9


def test_quality_trains_in_bounded_memory():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(800)) for _ in range(100)]
    tracemalloc.start()
    try:
        quality.train(texts, [i % 2 for i in range(100)], epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 << 20  # 85 MB when the buckets of each word were kept in a list


def test_quality_reads_long_words_to_their_end():
    rng = random.Random(10)
    word = "".join(rng.choice("abcé漢") for _ in range(90_000)).encode()
    assert sorted(quality.buckets(word)) == np.sort(np.concatenate(list(quality.pieces(word)))).tolist()
    good, bad = (["x" * 64 + "".join(rng.choice(letters) for _ in range(200)) for _ in range(30)] for letters in ("abcd", "mnop"))
    model = quality.train(good[:20] + bad[:20], [1] * 20 + [0] * 20)
    margin, bias = model.margins()
    scores = quality.score_texts(good[20:] + bad[20:], margin, bias, WordRows(2))
    assert scores[:10].min() > scores[10:].max() + 0.2
    text = "some words " + good[25] + " more " + good[25]
    ids = [b for w in text.encode().split() for b in quality.buckets(w)]
    assert abs(quality.score_texts([text], margin, bias, WordRows(2))[0] - 1 / (1 + np.exp(-bias - margin[ids].mean()))) < 1e-12

# ---- 8


def test_language_reads_the_middle_of_long_words():
    model = language.train([("aaaaa aaaaab", "a"), ("aaaaa aaaaab", "a"), ("bcbcb cbcbc", "b"), ("bcbcb cbcbc", "b")])
    word = "a" * 60 + "bc" * 200_000 + "a" * 60
    assert model.languages[int(model.of(word).argmax())] == "b"


# ---- ids, names, and tables that hold nothing

BIG = 2**60


def big(spark):
    """Ids beyond what a double holds, beside null ones, in one batch."""
    rng = random.Random(12)
    text, other = text_of(rng, 40), text_of(rng, 40)
    rows = [(BIG + 1, text), (BIG + 3, text + " x"), (None, text), (BIG + 5, other), (None, None), (BIG + 7, None), (7, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, lang_pred string"
    return spark.createDataFrame([(k, t, "en", "s", None if k is None else BIG + 1, "c", "c", "c") for k, t in rows], schema).coalesce(1)


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_ids_are_never_rounded(spark):
    docs = big(spark)
    want = ids(docs)
    model = quality.train(["a b", "c d"], [0, 1])
    speech = language.train([("a b c", "en"), ("d e f", "de")])
    for found in (pii.find(docs), minhash.near_duplicates(docs), suffixes.remove_repeats(docs), quality.score(docs, model), language.predict(docs, speech), lines.clean(docs)):
        assert ids(found) == want
    pieces = packing.pack(docs, queries.tokenizer())
    assert set(ids(pieces)) == set(want)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}[BIG + 3] == BIG + 1
    items = spark.createDataFrame([(1, docs.first().text)], "item_id long, text string")
    assert ids(decontaminate.find(docs, items)) == Counter([BIG + 1, BIG + 3, None])
    assert ids(decontaminate.clean(docs, items)) == Counter([BIG + 5, BIG + 7, None, 7][:4]) - Counter([None])
    vectors = spark.createDataFrame([(BIG, [1.0, 0.0]), (BIG + 1, [1.0, 0.1]), (None, [1.0, 0.0]), (BIG + 3, None)], "vec_id long, embedding array<double>").coalesce(1)
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(vectors, F.col("vec_id") == BIG).collect()] == [(BIG, BIG + 1)]


def test_pipeline_with_clashing_names_and_without_rows(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = big(spark)
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in cp.STAGES:
            now = stage(spark, now, sf)
            if name != "packing":
                assert now.columns == docs.columns and now.schema == docs.schema, name
                assert {r.n_chars for r in now.collect()} <= {None, BIG + 1, *range(3000)}
        assert now.count() == 0 or frame is docs
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Each stage against a plain version on its own input; the classifier's scores are compared one by one."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), lambda k: queries.fold(k, 5) != 0)
    margin, bias = model.margins()

    def plain_score(text):
        held = [b for w in (text or "").encode().split() for b in quality.buckets(w)]
        return 1 / (1 + np.exp(-(bias + (margin[held].mean() if held else 0.0))))

    def cleaned(rows):
        pages, held = Counter(r.source for r in rows), Counter()
        key = lambda line: line.strip(" \t\r")
        for r in rows:
            held.update({(r.source, key(x)) for x in (r.text or "").split("\n")} - {(r.source, "")})
        drop = {k for k, n in held.items() if n >= lines.LEAST and n > lines.RATIO * pages[k[0]]}
        return {r.doc_id: None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, key(x)) not in drop) for r in rows}

    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    now = docs
    for name, stage in cp.STAGES[:-1]:
        before, after = now.collect(), stage(spark, now, sf).collect()
        texts = {r.doc_id: r.text for r in before}
        got = {r.doc_id: r.text for r in after}
        assert len(after) == len(got)
        if name == "quality":
            assert set(got) == {k for k, t in texts.items() if plain_score(t) >= quality.THRESHOLD}
        if name == "lines":
            assert got == cleaned(before) and {r.doc_id: r.n_chars for r in after} == {r.doc_id: len(got[r.doc_id]) if got[r.doc_id] != r.text else r.n_chars for r in before}
        if name == "near_duplicates":
            assert set(got) == {k for k, (_, c) in brute.near_duplicates(list(texts.items())).items() if k == c}
        if name == "contamination":
            item_shingles = [(i.text, set(brute.shingles(i.text))) for i in items if brute.shingles(i.text)]
            bad = {k for k, t in texts.items() for x, s in item_shingles if s & set(brute.shingles(t)) and 100 * (m := most_similar(t, x))[0] >= 75 * m[1]}
            assert set(got) == set(texts) - bad
        now = spark.createDataFrame(after, docs.schema)


# ---- 9


def test_lines_of_pages_that_are_all_boilerplate(spark):
    rows = [(i, "menu\nfooter" if i < 40 else f"own {i}", "en", "s", 0) for i in range(50)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = lines.clean(spark.createDataFrame(rows, schema)).collect()
    assert sum(r["__n_removed"] for r in got) == 80 and {r.text for r in got if r.doc_id < 40} == {""}


def test_lines_of_repeated_ids_equal_their_sql(spark):
    import duckdb
    import pandas as pd

    rows = [(i % 5, "menu\nown" if i % 2 else f"menu\nx {i}", "en", "s", 0) for i in range(15)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    want = duckdb.connect().execute(f"select doc_id, text, n_lines, n_removed from ({lines.clean_sql('documents')})").fetchall()
    got = lines.clean(spark.createDataFrame(documents)).select("doc_id", "text", "__n_lines", "__n_removed").collect()
    assert Counter(map(tuple, got)) == Counter(want) and any(r[3] == 2 for r in want)


# ---- 7


def test_decontamination_ties_and_repeats(spark):
    rng = random.Random(3)
    item = text_of(rng, 20)
    text = " ".join([item] * 3)
    docs = spark.createDataFrame([(1, text), (1, text), (2, item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, item), (2, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.overlap, r.total) for r in decontaminate.find(docs, items).collect())
    assert got == [(d, i, 0, 16, 16) for d in (1, 2) for i in (1, 2)]


# ---- 8


def test_language_letters_and_ties():
    model = language.train([("aa bb", "x"), ("aa bb", "x"), ("aa cc", "y"), ("aa cc", "y")])
    langs, scores = language.predict_texts(["\u00bd \u00b2", "\u2167 \u2460", "aa", "漢"], model, WordRows(2))
    assert langs == ["und", "und", "x", "x"] and scores[:2] == [0.0, 0.0] and scores[2] == scores[3] == 0.5


def test_language_equals_a_plain_version():
    """Word first, then the longest known n-grams, word by word."""
    rng = random.Random(5)
    rows = [(" ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 6))) for _ in range(60)), lang) for lang, a in (("en", "abcdef"), ("de", "defghi"), ("fr", "aghijk")) for _ in range(4)]
    model = language.train(rows)
    counts = {lang: Counter(w for t, x in rows if x == lang for w in t.split()) for lang in model.languages}

    def logs(each):
        kept = {x for x, n in sum(each.values(), Counter()).items() if n >= 2}
        total = {k: sum(c.values()) + 0.5 * len(kept) + 1 for k, c in each.items()}
        table = {x: np.array([np.log((each[k][x] + 0.5) / total[k]) for k in model.languages]) for x in kept}
        return {x: v - v.mean() for x, v in table.items()}

    def grams(w, n):
        return [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]

    words = logs(counts)
    tables = {n: logs({k: sum((Counter({g: c * m for g, m in Counter(grams(w, n)).items()}) for w, c in ws.items()), Counter()) for k, ws in counts.items()}) for n in (5, 4, 3, 2, 1)}

    def of(w):
        if w in words:
            return words[w]
        for n in (5, 4, 3, 2, 1):
            if found := [tables[n][g] for g in grams(w, n) if g in tables[n]]:
                return np.mean(found, axis=0)
        return np.zeros(3)

    texts = [" ".join("".join(rng.choice("abcdefghijkz") for _ in range(rng.randint(1, 9))) for _ in range(9)) for _ in range(40)]
    langs, scores = language.predict_texts(texts, model, WordRows(3))
    for t, lang, s in zip(texts, langs, scores):
        z = np.sum([of(w) for w in t.split()], axis=0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(p.max() - s) < 1e-9 and model.languages[int(p.argmax())] == lang


# ---- training samples


def test_training_samples_are_bounded(spark):
    rows = [(i % 20, f"{i:03d} " + "x" * 5000) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = spark.createDataFrame([(i, i % 2) for i in range(20)], "k long, y int")
    got = labelled_texts(some, docs, 15, 40_000 / 2**20)
    assert len(got) == 7 and got["t"].tolist() == [f"{k:03d} " + "x" * 5000 for k in got["k"]]  # one text an id, the least
    assert len(labelled_texts(some, docs, 15, 1)) == 15 and len(labelled_texts(some, docs.limit(0), 15, 1)) == 0


# ---- components, storage, executors


def test_components_of_a_long_path(spark):
    n, rng = 5000, random.Random(1)
    order = list(range(n + 1))
    rng.shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    found = components.components(spark, links)
    assert found.count() == n + 1 and found.where("component <> 0").count() == 0


def test_saved_tables_are_deleted(spark):
    import os

    folder = common.shared_dir(spark).removeprefix("file:")
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "g h i j k l"])
    before = common.saved()
    minhash.near_duplicates(docs).collect()
    left = common.saved() - before
    assert len(left) <= 2 and all(os.path.isdir(p.removeprefix("file:")) for p in left) and folder


def test_operators_run_without_the_package_on_executors(tmp_path):
    """The driver finds the package by a path that Python workers do not get."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
spark.range(1).rdd.map(lambda x: 1).collect()
sys.path.insert(0, {root!r})
from reportlake.llm import queries
for name in ("op1_pii", "op4_neighbours", "op5_urls", "op8_language", "op10_quality"):
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("op") == 5
