import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute  # noqa: E402
from reportlake.llm.common import WordRows
from reportlake.llm import components, decontaminate, language, lines, minhash, neighbours, packing, pii, quality, queries, suffixes, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def letters(rng, n):
    return "".join(rng.choice("abcdefgh") for _ in range(n))


def text_of(rng, n):
    return " ".join(letters(rng, rng.randint(2, 7)) for _ in range(n))


def edited(rng, text, share):
    return " ".join(letters(rng, 5) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, white space, one word, repeated rows, a very long word and a very long text, and other alphabets."""
    rng = random.Random(1)
    long = text_of(rng, 30_000)
    return docs_of(spark, [None, "", " \n\t ", "word", "same text of six words here", "same text of six words here", "a" * 100_000, long, "Ünï cödé ñ 漢字 😀 x", long])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1


@settings(max_examples=300, deadline=None)
@given(st.text("ab@@..19 +-(é", max_size=24))
def test_pii_patterns(text):
    assert pii.base_spans(text) == brute.pii(text)


@pytest.mark.parametrize("text", ["a@b@c.d e@f", "x@y@z.com@w.org", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "001.02.3.4", "+1 (22) 333-4444 +", "4111 1111-1111 1111", "a@b.c@d.e"])
def test_pii_cases(text):
    assert pii.base_spans(text) == brute.pii(text)


def test_pii_network_on_unseen_examples():
    x, y = pii.examples(300, 160, np.random.default_rng(77))
    p = pii.trained()
    got = pii.viterbi(pii.emissions(p, x.T.copy()), p["trans"]).T
    for k in range(1, pii.K):
        assert (got[y == k] == k).mean() > 0.9 and (y[got == k] == k).mean() > 0.9


def test_pii_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    e, tr = rng.normal(size=(4, pii.K, 6)), np.where(pii.allowed(), rng.normal(size=(pii.K, pii.K)), -1e9)
    import itertools

    for col, labels in enumerate(pii.viterbi(e, tr).T):
        score = lambda path: sum(e[t, k, col] for t, k in enumerate(path)) + sum(tr[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
        assert abs(score(labels) - max(map(score, itertools.product(range(pii.K), repeat=4)))) < 1e-9


def whole_path(p, text):
    """The best path of a text's whole lattice, traced at once."""
    seen = [pii.classes(text)]
    e = np.concatenate([pii.part_emissions(p, seen, [q])[q[4] : q[5], :, 0] for q in pii.parts_of(seen)])
    assert len(e) == len(text)
    return pii.trace(p, [e])[0]


def test_pii_labels_are_the_best_path_of_the_whole_lattice():
    rng, r, p = random.Random(8), np.random.default_rng(8), pii.trained()
    for _ in range(12):  # other weights give long runs and many labels
        q = p | {"e0": p["e0"] + r.normal(0, 2, pii.K).astype(np.float32), "trans": (p["trans"] + r.normal(0, 1, p["trans"].shape)).astype(np.float32)}
        texts = ["" if rng.random() < 0.1 else text_of(rng, rng.randint(1, 500)) for _ in range(4)]
        got = pii.label_texts(q, texts)
        for i, t in enumerate(texts):
            assert not t or (got.get(i, np.zeros(len(t))) == whole_path(q, t)).all()


def test_pii_finds_a_span_at_every_offset_around_a_seam():
    rng, p = random.Random(5), pii.trained()
    base, end = text_of(rng, 120), text_of(rng, 150)
    for span, kind in [('token = "' + "0a1b9f3c" * 5 + '"', 5), ("jane.doe (at) corpsite.example.org", 1)]:
        texts = [base[:off] + " " + span + " " + end for off in range(340, 540, 3)]
        labels = pii.label_texts(p, texts)
        for i, t in enumerate(texts):
            assert [(k + 1, t[a:b]) for a, k, b in pii.added_spans(t, labels[i], [])] == [(kind, span)]


def test_pii_windows_cover_and_do_not_depend_on_neighbours(spark):
    rng = random.Random(3)
    for n in (1, 31, 511, 512, 513, 992, 993, 5000):
        parts = pii.windows_of(n)
        assert parts[0][0] == 0 and parts[-1][0] + parts[-1][1] >= n and all(b[0] - a[0] == pii.WINDOW - pii.OVERLAP for a, b in zip(parts, parts[1:]))
    text = text_of(rng, 90) + " token = \"" + "0a1b" * 10 + "\" " + text_of(rng, 90)
    p = pii.trained()
    alone, among = pii.label_texts(p, [text]), pii.label_texts(p, [text_of(rng, 50), "", text])
    assert (alone[0] == among[2]).all()
    rows = pii.find(docs_of(spark, [text, None, ""])).orderBy("doc_id").collect()
    assert [s.kind for s in rows[0].spans] == ["secret"] and rows[1].spans == rows[2].spans == []
    a, b = rows[0].spans[0].start, rows[0].spans[0].end
    assert text[a:b].startswith("token") and text[a:b].endswith('"')


def test_pii_query(spark, odd, none):
    assert pii.find(none).count() == 0 and pii.find(odd).count() == 10
    rows = queries.op1_pii(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        base = brute.pii(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        spans = set(r.spans.split(",")) - {""}
        assert {f"{brute.KINDS[k]}:{s}:{e}" for s, k, e in base} <= spans and r.n_all == len(spans)
        assert r.n_added_secret == sum(s.startswith("secret") for s in spans)


# ---- 2


def test_near_duplicates_equal_brute_force(spark, odd, none):
    rng = random.Random(4)
    base = [text_of(rng, 60) for _ in range(4)]
    texts = [edited(rng, rng.choice(base), rng.choice([0, 0.01, 0.03, 0.06])) for _ in range(160)] + ["a b c", "a b c", "a b c d", None, "", "x " * 40]
    for frame in (docs_of(spark, texts), odd.withColumn("component_id", F.lit("clash")).withColumn("key", F.lit(1)), none):
        want = brute.near_duplicates([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
        rows = minhash.near_duplicates(frame).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
        kept = minhash.keep_one(frame)
        assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {k for k, (_, c) in want.items() if k == c}


def test_near_duplicates_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in minhash.near_duplicates(df).collect()) == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(2)
    a = minhash.mix(np.arange(1000, dtype=np.uint64))
    b = np.concatenate([a[:750], minhash.mix(np.arange(5000, 5250, dtype=np.uint64))])
    x, y = (np.concatenate(minhash.min_max(s, *minhash.permutations())) for s in (a, b))
    assert abs((x == y).mean() - 0.6) < 0.15 and rng is not None


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for pair in links for x in pair)


# ---- 3


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    whole = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text")).repartition(3).withColumn("offset", F.lit("clash"))
    pieces = packing.pack(docs, path, with_ids=True).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, g in pieces.groupby("doc_id"):
        g = g.sort_values("start")
        ids = np.concatenate([np.asarray(x) for x in g["ids"]])
        assert ids.tolist() == [*whole.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        assert (g["start"] == g["length"].cumsum() - g["length"]).all() and (g["doc_tokens"] == len(ids)).all()
        assert [zlib.crc32(np.asarray(x, dtype="<u4").tobytes()) for x in g["ids"]] == g["ids_crc32"].tolist()
    assert set(pieces["doc_id"]) == set(texts)
    padding = 0
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        n = g["length"].sum()
        assert n <= 4096 and (g["offset"] == g["length"].cumsum() - g["length"]).all()
        padding += 4096 - n if n & (n - 1) else 0
    assert padding < 0.03 * pieces["length"].sum()
    assert packing.pack(none, path).count() == 0


def test_tokens_of_awkward_words():
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    whole, mine = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for s in ["it's  don't\x1cx <|endoftext|>x É é", "Σας ΣΑΣ 12", "The <|endoftext|> END. <|startoftext|>x!! a'll's élan, École--", "x\u0301. \u0130I ﬁn œuvre… 12.5, a1. ñ|| ", "THE%%% the,., \u00a0nbsp\u2028x"]:
        assert mine.ids([s])[0].tolist() == [*whole.encode(s, add_special_tokens=False).ids, 2], s


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=60))
def test_differencing_keeps_the_capacity(lengths):
    window = packing.assign(lengths)
    sums = np.bincount(window, weights=lengths) if lengths else np.zeros(0)
    assert len(window) == len(lengths) and (sums <= 4096).all()


# ---- 4


def nearest(x, ids, best=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, k in enumerate(ids):
        if k % 50 == 0:
            s = u @ u[i]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != k][:best]
            out[k] = [ids[j] for j in order]
    return out


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack([np.asarray(v, dtype=np.float64) for v in rows["embedding"]]), rows["vec_id"].to_numpy()
    want = nearest(x, ids)
    got = queries.op4_neighbours(spark, SF).toPandas().sort_values(["query_id", "rank"])
    hits = sum(len(set(want[k]) & set(g["vec_id"])) for k, g in got.groupby("query_id"))
    assert hits >= 0.9 * sum(map(len, want.values())) and all(g["rank"].tolist() == [1, 2, 3, 4, 5] for _, g in got.groupby("query_id"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    place = {k: i for i, k in enumerate(ids)}
    assert all(abs(u[place[q]] @ u[place[v]] - s) < 1e-12 for q, v, s in zip(got["query_id"], got["vec_id"], got["score"]))


def test_neighbours_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, rank string"
    rows = [(0, [1.0, 0.0], "c"), (50, [1.0, 0.0], "c"), (3, [1.0, 0.0], "c"), (2, [2.0, 0.0], "c"), (4, None, "c"), (5, [0.0, 0.0], "c"), (6, [None, 1.0], "c"), (7, [float("nan"), 1.0], "c"), (8, [0.0, 1.0], "c"), (9, [1.0], "c"), (3, [1.0, 0.0], "c"), (None, [1.0, 0.0], "c"), (100, None, "c")]
    got = neighbours.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    assert {q: g["vec_id"].tolist() for q, g in got.groupby("query_id")} == {0: [2, 3, 50, 8], 50: [0, 2, 3, 8]}
    assert neighbours.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    index, units = neighbours.learn(x), neighbours.unit(x)
    codes = index.codes(units)
    for radius in (3, 40, 90):
        found = neighbours.Search(index, np.arange(40), units[:40], codes[:40], radius, 500)
        found.add(np.arange(400), units, codes)
        found.reduce()
        close = neighbours.hamming(codes[:, None], codes[None, :40]) <= radius
        assert sorted(zip(found.r.tolist(), found.q.tolist())) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(close))))


def test_lists_by_substring_find_every_code_within_the_first_radius(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 20)  # so that lists are salted
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(12, 32)), 25, axis=0) + rng.normal(size=(300, 32)) * rng.choice([0, 0.02, 0.1, 0.3], size=(300, 1))
    index, units = neighbours.learn(x), neighbours.unit(x)
    codes = index.codes(units)
    rows = neighbours.encoded(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>"), index)
    index_rows, asked = rows.select("k", "u", "c", "sub", F.col("k").alias("row")).cache(), rows.where("k % 10 = 0").select("k", "u", "c", "sub").cache()
    got = neighbours.substring_search(index_rows, asked, 5).toPandas()
    want = {(q, r) for q in range(0, 300, 10) for r in range(300) if neighbours.hamming(codes[q], codes[r]) <= neighbours.first_radius()}
    assert len(got) == len(want) > 300 and set(zip(got["q"], got["vec_id"])) == want
    assert all(abs(units[q] @ units[r] - s) < 1e-12 for q, r, s in got[["q", "vec_id", "score"]].itertuples(index=False))


def test_neighbours_of_clusters_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 70)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    rng = np.random.default_rng(7)
    near = np.repeat(rng.normal(size=(20, 24)), 20, axis=0) + 0.05 * rng.normal(size=(400, 24))  # done by lists
    far = rng.normal(size=(100, 24))  # done by blocks
    x, ids = np.concatenate([near, far]), np.arange(500)
    got = neighbours.nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    want = nearest(x, ids)
    assert sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id")) >= 0.9 * 50 and len(got) == 50


# ---- 5


def test_urls(spark):
    cases = [("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"), ("x://b.com/", "b.com", "/", "com/", "allow"), ("x://b.com", "b.com", "", None, "allow"), ("x://c.net/es/2", "c.net", "/es/2", "net/es/", "block"), ("x://cnet/es/", "cnet", "/es/", None, "allow"), ("x://cheapcasino.example.org/de/", "cheapcasino.example.org", "/de/", None, "block"), ("x://citymuseum.example.org?a=/b", "citymuseum.example.org", "", None, "allow"), ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("://", "", "", None, "allow")]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, verdict string")
    rows = urls.judge(df, text=None).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [c[1:] for c in cases]
    assert urls.judge(df.limit(0), text=None).count() == 0
    odd = spark.createDataFrame([(None, "x://a.org/" + "poker" * 3000, None), (2**60 + 1, "x://a.org/q", "<p>alpha beta alpha</p>"), (2**60 + 3, None, "")] * 2, "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.verdict) for r in urls.judge(odd).collect()) == sorted([("None", "block"), (str(2**60 + 1), "allow"), (str(2**60 + 3), "allow")] * 2)


def test_urls_learn_from_rules_and_texts(spark):
    rules = [("allow", "com", "/"), ("block", "net", "/"), ("block", "a.com", "/x/"), ("allow", "c.a.com", "/x/")]
    assert urls.rule_of("b.c.a.com", "/x/y", rules) == ("c.a.com/x/", "allow", "b.", "y")
    made = [f"s://{'good' if v == 'com' else 'evil'}{w}.{v}/{w}/{i}" for v in ("com", "net") for w in ("red", "blue", "green", "grey", "black", "white", "pink", "brown") for i in range(3)]
    made += ["s://evilblue.org/1", "s://goodblue.org/1", None, "s://evilthing.net/"]
    words = " ".join(["good evil red blue green grey black white pink brown thing"] * 40)
    df = spark.createDataFrame([(i, u, f"<p class='goodred'>{words}</p> www.goodred.com <script>evilred evilred</script>") for i, u in enumerate(made)], "page_id long, url string, html string")
    counts = urls.counted(df, "html")
    assert counts["evil"] == 40 * len(made) and "goodred" not in counts and "evilred" not in counts and "p" not in counts
    # all splits of a run, by brute force
    cut = urls.segmenter(counts)
    for run in ("evilblue", "goodgreengrey", "blackpink"):
        every = [[run[a:b] for a, b in zip([0, *ends], [*ends, len(run)])] for n in range(4) for ends in __import__("itertools").combinations(range(1, len(run)), n)]
        cost = lambda ws: sum(cut.logs.get(w, -np.log(cut.total) - len(w) * np.log(10)) for w in ws)
        assert abs(cost(cut.split(run)) - max(map(cost, every))) < 1e-9
    learnt = urls.learn(urls.examples(df, cut, rules=rules))
    want = {}
    for host, blocked, ws in {(u.split("/")[2], ".net" in u, tuple(cut.split(u.split("/")[2].split(".")[0]) + cut.split(u.split("/")[3]))) for u in made if u and ".org" not in u}:
        for w in {*ws} - {""}:
            b, a = want.get(w, (0, 0))
            want[w] = (b + blocked, a + (not blocked))
    assert learnt == want
    rows = {r.page_id: r for r in urls.judge(df, rules=rules).collect()}
    n = len(made)
    assert rows[n - 4].score > rows[n - 3].score + 1 and rows[n - 4].host_words == "evil blue org" and rows[n - 2].verdict == "allow"
    model = urls.bayes(learnt)
    assert abs(rows[n - 4].score - model.score(["evil", "blue", "org"])) < 1e-9 and len(set(model.weight.values())) > 4


def test_viterbi_splits_into_words():
    cut = urls.segmenter({})
    for run, want in [("cheappills", ["cheap", "pills"]), ("casinowin", ["casino", "win"]), ("sciencemuseum", ["science", "museum"]), ("zzqq", ["zzqq"]), ("", [])]:
        assert cut.split(run) == want
    every = [[run[:i], run[i:]] for run in ["freecasino"] for i in range(1, len(run))] + [["freecasino"]]
    cost = lambda ws: sum(cut.logs.get(w, -np.log(cut.total) - len(w) * np.log(10)) for w in ws)
    assert cost(cut.split("freecasino")) == max(map(cost, every))


# ---- 6


def test_suffixes_equal_brute_force(spark, odd, none):
    rng = random.Random(2)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(40, 400))) for _ in range(6)]
    texts = []
    for _ in range(120):
        t = ""
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(base)
            a = rng.randint(0, len(s))
            t += s[a : rng.randint(a, len(s))] + "".join(rng.choice("abxyz") for _ in range(rng.randint(0, 30)))
        texts.append(t + "a" * (rng.randint(30, 300) if rng.random() < 0.1 else 0))
    clash = docs_of(spark, [*texts, None, ""]).withColumn("blocks", F.lit("clash")).withColumn("at", F.lit(1))
    for frame in (clash, odd, none):
        want = brute.repeats([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame).collect()}
        assert got == want


def test_suffixes_settled_in_batches(spark):
    """A passage, exact copies and periodic texts in many documents, in batches that see a few of them each."""
    rng = random.Random(8)
    made = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    passage, common, whole = made(120), made(60), made(900)
    texts = [whole if i % 9 == 4 else made(rng.randint(0, 80)) + rng.choice([passage, common, common[:45], "ab" * 40]) + made(rng.randint(0, 80)) for i in range(150)]
    rows = [(i * 7919 % 150 - 60, t) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        found = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute.repeats(rows)


def test_suffixes_of_frequent_prefixes_are_parted(spark):
    """One phrase in all documents, in surroundings that differ, that are equal on one side, and that are equal on both."""
    assert [suffixes.ranges(n) for n in (1, 2)] == [[(0, 34)], [(0, 16), (17, 34)]] and suffixes.ranges(35) == [(i, i) for i in range(35)]
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    sides = [made(40) for _ in range(3)]
    phrase = "frequent phrase of all"
    side = lambda: rng.choice([*sides, *(s[:20] + made(9) for s in sides), *(made(9) + s[-20:] for s in sides), made(rng.randint(0, 50))])
    rows = [(i * 7919 % 140 - 60, side() + phrase + side() + ("" if i % 3 else made(30) + phrase)) for i in range(140)]
    want = brute.repeats(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for parts in (((1, 2),), ((1, 35),), ((4, 5), (40, 35))):
            found = suffixes.remove_repeats(frame, parts=parts).collect()
            assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    context = bytes([34, 34]) + bytes(rng.randrange(256) for _ in range(68))
    around = spark.createDataFrame([(1, 5, 9, bytearray(context)), (2, 6, 9, bytearray(context)), (1, 7, 9, bytearray([34, 34])), (1, 8, 9, bytearray([3, 33] + [0] * 68))], "k long, doc long, at int, around binary")
    some = suffixes.parted(around, spark.createDataFrame([(1, 50)], "k long, n long"), ((40, 35),)).groupBy("doc").agg(F.count_distinct("k").alias("keys"), F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, some.collect())) == [(5, 35, 35), (6, 1, 1), (7, 1, 1), (8, 3, 3)]


def test_suffixes_in_parts_of_long_texts(monkeypatch):
    text = random.Random(1).randbytes(5000)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    starts = sorted(int(p - s.off[s.part[p]] + s.base[s.part[p]]) for s in suffixes.streams([text, b"short", text[:49]]) for p in np.flatnonzero(s.ok))
    assert starts == list(range(5000 - 49))


# ---- 7


def test_decontamination(spark, odd, none):
    rng = random.Random(9)
    items = [text_of(rng, n) for n in (6, 20, 40)] + ["one two three", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [text_of(rng, 30) + " " + items[1].upper() + "\n" + text_of(rng, 30), items[2].replace(" ", "\n", 3), " ".join(items[2].split()[:20]), edited(rng, items[2], 0.02), "one two three", text_of(rng, 50), None, "", items[0] + " " + items[0]]
    frame = docs_of(spark, texts).withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(frame, bench).collect()}
    assert {(0, 1), (1, 2), (4, 3), (8, 0)} <= got and not any(d in (2, 5, 6, 7) for d, _ in got)
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns and {2, 5, 6, 7} <= {r.doc_id for r in left.collect()} and not {0, 1, 4, 8} & {r.doc_id for r in left.collect()}
    assert decontaminate.find(none, bench).count() == decontaminate.find(frame, bench.limit(0)).count() == 0
    assert decontaminate.find(odd, bench).count() == 0


def test_block_variants_hold_every_fingerprint_within_the_radius():
    rng, near = random.Random(3), set(decontaminate.variants(decontaminate.RADIUS))
    for _ in range(300):
        d = sum(1 << b for b in rng.sample(range(64), decontaminate.RADIUS))
        assert any((d >> (8 * k)) & 255 in near for k in range(decontaminate.BLOCKS))


@pytest.mark.parametrize("name", ["op2_near_duplicates", "op7_decontamination", "op9_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = queries.QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    assert sorted(map(str, mine.toPandas()[columns].to_numpy().tolist())) == sorted(map(str, con.sql(queries.ORACLES[name]).df()[columns].to_numpy().tolist()))


# ---- 8


def test_language_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op8_language(spark, "/root/testdata/sf0.01").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) > 0.97 * len(out) and all(0 <= r.score <= 1 for r in rows)


def test_language_backoff(spark, none):
    model = language.train([("the cat the cat sat", "en"), ("le chat le chat assis", "fr"), (None, "fr")])
    langs, scores = language.predict_texts(["the", "cats", "chats!", "123 --", None, "", "qqq"], model, WordRows(2))
    assert langs[:3] == ["en", "en", "fr"] and langs[3:6] == ["und"] * 3 and scores[3:6] == [0.0] * 3 and 0 < scores[6] <= 1
    assert language.train([]).languages == [] and language.predict_texts(["x"], language.train([]), WordRows(0))[0] == ["und"]
    assert language.predict(none, model).count() == 0


# ---- 9


def test_lines(spark, odd, none):
    rows = [(i, f"menu \nown {i}\n\n menu\t\n{'rare' if i < 3 else 'x' + str(i)}", "en", "a" if i else None, 0) for i in range(30)] + [(100 + i, "menu\r", "en", "b", 0) for i in range(30)] + [(200, None, "en", "a", 0), (201, "", "en", "a", 0)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("boilerplate", F.lit(1))
    got = {r.doc_id: r for r in lines.clean(frame).collect()}
    assert got[5].text == "own 5\n\nx5" and (got[5]["__n_lines"], got[5]["__n_removed"]) == (5, 2)
    assert got[1].text.endswith("rare") and got[0].text == rows[0][1]
    assert got[100].text == "" and got[100]["__n_removed"] == 1 and got[200].text is None and got[201].text == "" and got[200]["__n_lines"] == 0
    assert lines.clean(none).count() == 0 and lines.clean(odd).count() == 10


# ---- 10


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op10_quality(spark, sf).collect()
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in out) > 0.9 * len(out)
    assert sum(r.predicted for r in out if labels[r.doc_id]) > 0.97 * sum(labels[r.doc_id] for r in out)


def test_quality_odd(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, empty, lambda k: F.lit(True))
    assert all(r.score == 0.5 for r in quality.score(odd, model).collect()) and quality.score(none, model).count() == 0
    labels = spark.createDataFrame([(3, 0, 0), (4, 1, 0), (5, None, 0), (0, 1, 0), (7, 3, 0), (None, 1, 0)], empty.schema)
    rows = {r.doc_id: r.score for r in quality.score(odd.withColumn("quality", F.lit("clash")), quality.fit(odd, labels, lambda k: F.lit(True))).collect()}
    assert rows[0] == rows[1] and rows[4] == rows[5] > rows[3]


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        texts = {r.doc_id: r.text for r in docs.collect()}
        kept = {r.doc_id: r.text for r in out.collect()}
        if name == "near_duplicates":
            assert set(kept) == {k for k, (_, c) in brute.near_duplicates(list(texts.items())).items() if k == c}
        if name == "lines":
            assert set(kept) == set(texts)
        docs = out.cache()
    pieces = cp.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_no_stage_collects_or_samples_the_corpus():
    import inspect

    for module in (components, decontaminate, lines, minhash, packing, suffixes):
        assert not re.search(r"localCheckpoint|\.sample\(|\.collect\(\)|crossJoin", inspect.getsource(module))
