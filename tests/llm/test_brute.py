"""Operators that SQL can't express, against plain versions, the library, or held-out labels."""

import time
from pathlib import Path

import brute
import numpy as np
import pytest

import corpus_pipeline
from siftstone.llm import common, language, near_dedup, packing, pieces, quality, queries, suffix_dedup, toxicity

SF = "/root/testdata/sf0.01"
VOCABULARY = [f"{a}{b}" for a in ("ka", "Lo", "mi", "né", "pu", "x1") for b in ("ra", "so", "tu", "vi")]


def corpus(seed, n=60):
    """Random texts that share passages of 40 to 90 words, some of them edited, repeated inside or periodic."""
    rng = np.random.default_rng(seed)
    passages = [list(rng.choice(VOCABULARY, rng.integers(40, 90))) for _ in range(8)]
    rows = []
    for doc in rng.permutation(n):
        w = list(rng.choice(VOCABULARY, rng.integers(0, 120)))
        for _ in range(rng.integers(0, 3)):
            p = list(passages[rng.integers(8)])
            if rng.random() < 0.3:
                p[rng.integers(len(p))] = "edited"
            at = rng.integers(0, len(w) + 1)
            w[at:at] = p
        if doc % 13 == 0:
            w += ["ha"] * int(rng.integers(20, 90))
        if doc % 17 == 0 and rows:
            w = rows[rng.integers(len(rows))][1].split(" ")
        rows.append((int(doc), rng.choice([" ", ", ", " - "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix(spark, seed):
    rows = corpus(seed)
    out = suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute.cut_repeats(rows)


def test_suffix_family(spark, tmp_path):
    """Levels merge geometrically; saved and loaded between batches they tell what one array of all batches tells."""
    rows = corpus(4, 70)
    batches = [spark.createDataFrame([(d, t) for d, t in rows if d % 7 == k], "doc bigint, text string") for k in range(7)]
    family, ranks, met = suffix_dedup.Family(), [], []
    for k, batch in enumerate(batches):
        met.append({tuple(r) for r in family.add(suffix_dedup.suffix_array(batch)).collect()})
        ranks.append([rank for rank, _ in family.levels])
        if k in (2, 4):
            family.save(f"{tmp_path}/{k}")
            family = suffix_dedup.Family.load(spark, f"{tmp_path}/{k}")
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]
    docs = [t for _, t in rows]
    whole = suffix_dedup.Family()
    all_docs = spark.createDataFrame(rows, "doc bigint, text string")
    assert met[-1] == {tuple(r) for r in whole.add(suffix_dedup.suffix_array(all_docs)).collect()}
    assert len(docs) == 70 and met[-1] and met[0] <= {(m, d) for m, _ in met[-1] for d in (True, False)}
    left = suffix_dedup.decide(all_docs, family.add(suffix_dedup.suffix_array(all_docs.limit(0))))
    assert left.where("whole").count() > 0


def thue(n):
    """The Thue-Morse word of n letters and its complement: polynomials modulo a power of two don't tell them apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_unlike_texts_with_equal_polynomials(spark, n):
    one, two = thue(n)
    rows = [(1, one), (2, two), (3, " ".join(one)), (4, " ".join(two)), (5, " ".join([*"cdefgh" * 10, one])), (6, " ".join([*"ijklmn" * 10, two]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.cut_repeats(docs).collect()}
    assert kept == brute.cut_repeats(rows)
    classes = brute.near_classes(rows)
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in near_dedup.near_classes(docs).collect()} == classes and classes[1] != classes[2]


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    """Edited copies, excerpts of them at any size, texts that quote several others, and copies of all of these."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, bases = [], []
    for _ in range(40):
        base = list(rng.choice(words, rng.integers(3, 400)))
        bases.append(base)
        for _ in range(rng.integers(1, 5)):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 25))):
                copy[at] = rng.choice(words)
            rows.append(copy)
        if len(base) > 30:
            at, n = rng.integers(0, len(base) - 20), rng.integers(5, 20)
            rows.append(base[at : at + n])
            rows.append(base[: rng.integers(10, len(base))])
    for _ in range(8):
        rows.append([w for k in rng.integers(0, 40, 4) for w in bases[k]])
    rows += [rows[k] for k in rng.integers(0, len(rows), 10)]
    rows = [(int(d), " ".join(rows[k])) for d, k in enumerate(rng.permutation(len(rows)))]
    got = {r["doc_id"]: r for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute.near_classes(rows)
    assert got.keys() == want.keys() and all(r["keep"] == (r["class_id"] == d) for d, r in got.items())
    links = sum(n for _, n in want.values())
    assert links > 150 and 0.98 * links <= sum(r["links"] for r in got.values()) <= links
    assert np.mean([r["class_id"] == want[d][0] for d, r in got.items()]) >= 0.98


def test_near_hot(spark, monkeypatch):
    """Passages of many documents, alone, joined and with a little of their own, find the documents that hold them."""
    monkeypatch.setattr(near_dedup, "HOT", 3)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    passages = [list(rng.choice(words, 70)) for _ in range(3)]
    rows = [[*rng.choice(words, rng.integers(100, 300)), *passages[k % 3], *rng.choice(words, 30)] for k in range(40)]
    rows += [passages[0], passages[1] + list(rng.choice(words, 12)), passages[0] + passages[1], passages[2][:50], list(rng.choice(words, 80)) + passages[2]]
    rows += [passages[0] + passages[1] + list(rng.choice(words, 200))]
    rows = [(d, " ".join(x)) for d, x in enumerate(rows)]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute.near_classes(rows)
    assert {d for d in want if want[d][0] != d} == {d for d in got if got[d][0] != d} and {40, 41, 43} <= {d for d in want if want[d][0] != d}
    assert sum(n for _, n in got.values()) == sum(n for _, n in want.values())


def test_near_blocks(spark, monkeypatch):
    """A cluster larger than a block and buckets larger than a piece lose no link."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(d, " ".join([*base[:90], f"x{d}", *base[91:]])) for d in range(60)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["links"] for r in got} == {59}
    band, uid = np.zeros(100, np.int64), np.arange(100)
    sketch = [bytes(rng.integers(0, 256, 64, dtype=np.uint8).tolist()) for _ in range(4)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(band), pa.array(uid), pa.array([sketch[k % 4] for k in uid], pa.binary())], ["band", "uid", "sketch"])
    edges = {(a, b) for x in near_dedup.sketch_edges(iter([batch]), 9) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)}
    parent = list(range(100))
    for a, b in sorted(edges):
        assert a % 4 == b % 4
        parent[a] = parent[b]
    assert len(set(parent)) == 4


def test_near_all_links(spark):
    """An excerpt is linked to every text that holds it, not only to its best container."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(5000)]
    short, longer = list(rng.choice(words, 30)), list(rng.choice(words, 150))
    rows = [[*rng.choice(words, 40 + 30 * k), *short, *longer[: 120 + 10 * (k % 3)], *rng.choice(words, 90)] for k in range(6)] + [short, longer]
    rows = [(d, " ".join(x)) for d, x in enumerate(rows)]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.near_classes(rows) and got[6][1] == got[7][1] == 6


def test_near_hot_decoys(spark, monkeypatch):
    """A container is found among many larger sets that have as many of a query's hot keys but too few of its shingles."""
    monkeypatch.setattr(near_dedup, "HOT", 3)
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(5000)]
    query = list(rng.choice(words, 40, replace=False))
    rows = []
    for _ in range(100):
        edited = list(query)
        for at in 3 * rng.choice(12, 4, replace=False) + 3:
            edited[at] = "edited"
        rows.append([*edited, *rng.choice(words, 200)])
    rows += [query, [*query[:36], *rng.choice(words, 60)]]
    rows = [(d, " ".join(x)) for d, x in enumerate(rows)]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.near_classes(rows) and got[100] == (101, 1)


def test_near_frequent(spark, monkeypatch):
    """Short texts that stand in most documents: their links and best containers are right, in several passes and pieces, without a row for each pair."""
    monkeypatch.setattr(near_dedup, "HOT", 3)
    monkeypatch.setattr(near_dedup, "FREQUENT", 40)
    monkeypatch.setattr(near_dedup, "SETS", 5)
    monkeypatch.setattr(near_dedup, "STEP", 20)
    seen = []
    whole = near_dedup.containers
    monkeypatch.setattr(near_dedup, "containers", lambda *x: seen.append(whole(*x)) or seen[-1])
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(5000)]
    phrases = [list(rng.choice(words, n, replace=False)) for n in (3, 9, 14, 20, 30, 45)]
    rows = []
    for k in range(50):
        some = [list(phrases[p]) for p in rng.permutation(6)[: rng.integers(2, 6)]]
        if k % 3 == 0 and len(some[0]) > 6:
            some[0][len(some[0]) // 2] = "edited"
        rows.append([w for x in [*some, list(rng.choice(words, 60 + 7 * (k % 5)))] for w in x])
    rows += [rows[4], rows[5]] + phrases + phrases[:3] + [phrases[2] + phrases[1], phrases[3][:15], [*phrases[4][:25], "of", "its", "own"]]
    rows = [(f"d{d}", " ".join(rows[d])) for d in rng.permutation(len(rows))] + [("d4", " ".join(rows[4]))] * 2
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    want = brute.near_classes(rows)
    assert got == want and sum(n for _, n in want.values()) > 500
    made = [r for r in seen[0].collect() if r["holder"] is not None]
    assert sum(r["links"] for r in made) > 2 * len(made)


def test_near_block_work():
    """Links of blocks of near copies, against sets; a pair of full blocks takes a fraction of a second."""
    rng = np.random.default_rng(14)

    def block(n, most):
        base = rng.integers(1, 1 << 60, 400)
        sets = []
        for _ in range(n):
            x = base[: rng.integers(most, 401)].copy()
            edited = rng.random(len(x)) < rng.choice([0.02, 0.1, 0.25])
            x[edited] = rng.integers(1, 1 << 60 if n > 200 else 50, edited.sum())
            sets.append(np.unique(x))
        return sets, np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(n), [len(x) for x in sets])

    sets, hashes, doc = block(90, 20)
    side = rng.integers(0, 3, 90)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    near = lambda x, y: len(x & y) >= 0.7 * min(len(x), len(y)) - 1e-9 and max(len(x), len(y)) <= 1.25 * min(len(x), len(y)) + 1e-9
    plain = [set(x.tolist()) for x in sets]
    want = {(x, y) for x in left for y in right if x != y and near(plain[x], plain[y])}
    assert set(zip(*near_dedup.links_within(hashes, doc, 90, left, right), strict=True)) == want and len(want) > 100
    _, hashes, doc = block(1024, 400)
    times = []
    for _ in range(3):
        began = time.perf_counter()
        x, _ = near_dedup.links_within(hashes, doc, 1024, np.arange(512), np.arange(512, 1024))
        times.append(time.perf_counter() - began)
    assert len(x) > 100_000 and min(times) < 0.4


def test_bit_table_grows(spark, monkeypatch):
    """A bit table of more values than the least table has bits still tells most others apart, and loses none."""
    monkeypatch.setattr(common, "BITS", 20)
    table = common.bit_table(spark.range(400_000).selectExpr("xxhash64(id) as key"), "key", 400_000)
    told = [np.array(spark.range(n, n + 400_000).selectExpr("xxhash64(id) as key").toPandas()["key"]).view(np.uint64) for n in (0, 400_000)]
    assert len(common.in_table(table, told[0])) == 400_000 and len(common.in_table(table, told[1])) < 40_000


def test_pieces_as_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op3_sentencepiece(spark, SF).collect():
        assert list(r["ids"]) == model.encode(text[r["doc_id"]]) and r["intact"]


def test_pieces_long_units(spark):
    """Units of any length merge in rounds as the library merges them; equal polynomial hashes don't make units equal."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = np.random.default_rng(11)
    texts = ["x" * n for n in (1, 95, 96, 97, 5000)] + ["ab" * 3000, "the" * 900, "aab" * 1500, "日本語" * 700, "https://example.org/" + "a1b2/" * 500, "=" * 4000 + "-" * 33 + "=" * 50]
    texts += ["".join(rng.choice(list("etaoinshr"), n)) for n in (200, 3000, 20_000)] + ["".join(rng.choice(list("etaoinshrdlucmfwyp éü中🙂"), n)) for n in (500, 5000)]
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
        if len(thue) >= 1024:
            texts += [thue, thue.translate(str.maketrans("ab", "ba"))]
    out = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), pieces.Vocabulary.load())
    for r in out.collect():
        assert list(r["ids"]) == model.encode(texts[r["doc_id"]]) and r["intact"]


def test_toxicity_on_labels(spark):
    """Some labels contradict their text; documents with insults must go, and few others."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels), "p").join(labels, "doc_id").toPandas()
    insults = scored["text"].str.lower().str.count(r"\b(?:trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron)\b")
    bad, good = scored[(scored["toxic"] == 1) & (insults >= 2)], scored[(scored["toxic"] == 0) & (insults == 0)]
    assert len(bad) >= 20 and (bad["p"] >= 0.5).mean() >= 0.95
    assert (good["p"] >= 0.5).mean() <= 0.02


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) >= 40")
    model = language.train(docs.where("doc_id % 2 = 0"))
    found = language.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found["language"] == found["lang"]).mean() >= 0.95


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 2 = 1").select("doc_id", labels["quality"].alias("truth"))
    out = quality.quality(docs, labels.where("doc_id % 2 = 0")).join(held, "doc_id").toPandas()
    assert (out["keep"] == (out["truth"] == 1)).mean() >= 0.85


def test_quality_posteriors(spark):
    """The posteriors of a given classifier's evidence, against plain loops over sites; and the sites of URLs."""
    rng = np.random.default_rng(2)
    rows = [(d, " ".join(rng.choice(VOCABULARY, rng.integers(1, 60))), f"h{rng.integers(3)}" if d % 9 else None, f"p{rng.integers(3)}") for d in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    labels = spark.createDataFrame([(d, int(d % 3 > 0)) for d in range(0, 150, 2)], "doc_id bigint, quality int")
    out = quality.quality(docs, labels, "host", "path").toPandas().merge(docs.toPandas().fillna("none"), on="doc_id")
    rate = out["p_doc"].mean()

    def prior_strength(groups):
        n = np.array([len(g) for _, g in groups])
        mean, prior = np.array([g.mean() for _, g in groups]), np.array([p for p, _ in groups])
        between = max((n * (mean - prior) ** 2).sum() - (prior * (1 - prior)).sum(), 0) / n.sum()
        return float(np.clip((n * prior * (1 - prior)).sum() / n.sum() / max(between, 1e-9) - 1, 1, 1e4))

    hosts = {h: g["p_doc"].to_numpy() for h, g in out.groupby("host")}
    k = prior_strength([(rate, g) for g in hosts.values()])
    host_rate = {h: (k * rate + g.sum()) / (k + len(g)) for h, g in hosts.items()}
    paths = {s: g["p_doc"].to_numpy() for s, g in out.groupby(["host", "path"])}
    k = prior_strength([(host_rate[h], g) for (h, _), g in paths.items()])
    path_rate = {(h, p): (k * host_rate[h] + g.sum()) / (k + len(g)) for (h, p), g in paths.items()}
    logit = lambda p: np.log(p / (1 - p))
    for r in out.itertuples():
        p = path_rate[r.host, r.path]
        assert abs(r.host_rate - host_rate[r.host]) < 1e-6 and abs(r.path_rate - p) < 1e-6
        assert abs(logit(r.quality) - (logit(r.p_doc) + logit(p) - logit(rate))) < 1e-4 and r.keep == (r.quality >= 0.5)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sited = quality.quality(pages, pages.selectExpr("page_id as doc_id", "cast(page_id % 2 as int) as quality"), id_col="page_id", text_col="html", url="url")
    assert sited.count() == pages.count() and sited.select("host_rate").distinct().count() > 1
    urls = spark.createDataFrame([("https://www.Ex.org:80/a/b/c.html?q=/x",), ("//u@h.de",), ("mail",), (None,)], "url string")
    assert [tuple(r) for r in urls.select(*quality.site(urls["url"])).collect()] == [("ex.org", "/a/b/"), ("h.de", "/"), (None, None), (None, None)]


def test_language_plain(spark):
    """Names and similarities of a trained model, against dictionaries of byte pairs and triples."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    model = language.train(docs)
    for r in language.identify(docs, model).join(docs, "doc_id").where("doc_id % 7 = 0").collect():
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in r["text"].encode())
        v = np.zeros(language.DIMENSIONS)
        for i in range(len(data) - 1):
            v[((data[i] << 8 | data[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        for i in range(len(data) - 2):
            v[((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2246822519 & 0xFFFFFFFF) >> 20] += 1
        v = np.log1p(v) * model.idf
        cosines = [float(v @ c) / max(float(np.linalg.norm(v)), 1e-12) for c in model.centroids]
        best = max(cosines)
        assert abs(best - r["similarity"]) < 1e-4
        if min(abs(best - x) for x, n in zip(cosines, model.names, strict=True) if n != model.names[cosines.index(best)]) > 1e-4:
            k = cosines.index(best)
            assert r["language"] == (model.names[k] if best >= model.least[k] else "und")


def test_language_many(spark):
    """Every language of a table is taught, however many there are."""
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} " * 12, f"l{k:04}") for k in range(1200)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert sorted(set(model.names)) == sorted(lang for *_, lang in rows)


def test_label_model_recovers():
    """Accuracies of simulated voters, two of them copies of each other, and posteriors against Bayes' rule over the independent voters that vote."""
    rng = np.random.default_rng(0)
    n, balance = 200_000, 0.2
    y = rng.random(n) < balance
    hit, slip = np.array([0.7, 0.6, 0.5, 0.8, 0.65, 0.55, 0.6]), np.array([0.05, 0.1, 0.08, 0.1, 0.06, 0.04, 0.12])
    v = np.where(y[:, None], rng.random((n, 7)) < hit, rng.random((n, 7)) < slip).astype(int)
    v = np.concatenate([v, v[:, :1]], axis=1)
    z = np.concatenate([np.ones((n, 1)), toxicity.signs(v)], axis=1)
    model = toxicity.fit_label_model(z.T @ z, balance)
    assert np.abs(model.toxic[1:7] - hit[1:]).max() < 0.08 and np.abs(model.clean[1:7] - slip[1:]).max() < 0.05
    odds = balance / (1 - balance) * np.prod(np.where(v[:, :7] > 0, hit / slip, 1.0), axis=1)
    assert np.corrcoef(model.posterior(v) >= 0.5, odds >= 1)[0, 1] > 0.9


def test_toxicity_bound(spark):
    """One text on nearly all rows can't exceed the bound of the fitted sample, nor do rare words of labels far beyond it go unseen."""
    rows = [(d, "the same text for everyone here" if d % 100 else f"text number {d} of its own kind") for d in range(6000)]
    rng = np.random.default_rng(6)
    rows += [(10_000 + d, " ".join([*rng.choice(VOCABULARY, 40), "blargwort", *rng.choice(VOCABULARY, 40), "blargwort", "zz"])) for d in range(12)]
    rows += [(20_000 + d, " ".join(rng.choice(VOCABULARY, 60))) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, int(10_000 <= d < 20_000)) for d, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, fitted=50)
    assert toxicity.word_hash(["blargwort"])[0] in model.lexicon.mined
    assert toxicity.word_hash(["same"])[0] not in model.lexicon.mined
    assert toxicity.drop_toxic(docs, labels).where("doc_id < 10000").count() == 6000


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packing_search(seed):
    """No move, exchange of one for one, or of two for one between bins with room can raise the sum of squares any more."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1001, 300)
    start = packing.best_fit(lengths, 1000)
    bins = packing.improve([list(b) for b in start], lengths, 1000)
    assert sorted(i for b in bins for i in b) == list(range(300))
    fills = np.array([lengths[b].sum() for b in bins])
    assert fills.max() <= 1000 and len(bins) <= len(start) and len(bins) >= -(-lengths.sum() // 1000)
    assert (fills.astype(float) ** 2).sum() >= (np.array([lengths[b].sum() for b in start], float) ** 2).sum()
    assert len(bins) <= 1.03 * max(-(-lengths.sum() // 1000), (lengths > 500).sum()) + 2
    some = [lengths[b].tolist() for b in bins if lengths[b].sum() < 1000]
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            if i == j:
                continue
            subsets = lambda x: [()] + [(k,) for k in x] + [(k, m) for n, k in enumerate(x) for m in x[n + 1 :]]
            for out in subsets(a):
                for back in subsets(b):
                    if (len(out), len(back)) in ((1, 0), (1, 1), (2, 1), (1, 2)):
                        gain = sum(out) - sum(back)
                        if gain > 0 and sum(b) + gain <= 1000:
                            assert (sum(a) - gain) ** 2 + (sum(b) + gain) ** 2 <= sum(a) ** 2 + sum(b) ** 2


def test_packing_levels(spark):
    """Open bins of many groups are packed together: no more bins than one search over all documents needs, but for a few."""
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 60, 3000)
    docs = spark.createDataFrame([(int(d), "w " * int(n)) for d, n in enumerate(lengths)], "doc_id bigint, text string")
    out = packing.pack(docs, capacity=100, group=12).toPandas()
    assert out.groupby("bin")["tokens"].sum().max() <= 100 and out["tokens"].sum() == lengths.sum() and len(out) == 3000
    assert out["bin"].nunique() <= 1.01 * -(-lengths.sum() // 100) + 2
    kana = packing.pack(spark.createDataFrame([(1, "日本語 abc、か")], "doc_id bigint, text string")).toPandas()
    assert kana["tokens"].tolist() == [5]


def test_row_identity(spark):
    """Rows that differ only in which column is null are different rows."""
    docs = spark.createDataFrame([(1, "a", None), (1, None, "a"), (2, "b", None), (2, "b", None)], "id bigint, x string, y string")
    keys = docs.select(common.row_id(docs).alias("key"), docs["x"].isNotNull().alias("keep"))
    assert sorted(map(tuple, common.drop_rows(docs, common.materialize(keys)).collect())) == [(1, "a", None), (2, "b", None)]


def test_pipeline(spark, tmp_path):
    """run() over a small corpus, against the plain stages one after another."""
    rows = corpus(9, 40)
    data = rows + [(100 + i, rows[i][1]) for i in range(5)] + [(None, "a text without a number"), (300, None), (301, None), (302, ""), (303, ""), (304, "?!")]
    data += [(200 + i, f"you are an idiot and a pathetic loser number {i} " + " ".join(["stupid moron"] * (1 + i % 3))) for i in range(12)]
    wide = [(d, t, "en", "s", None if t is None else len(t), "more") for d, t in data]
    spark.createDataFrame(wide, "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, None, int(d >= 200)) for d, t in data if d is not None and t and d < 300 and d % 2] + [(None, 1, 1), (999, 1, 1), (201, 1, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    docs = {d: t for d, t in data if d is not None and t is not None and not 200 <= d < 300}
    for keep in (brute.exact_kept, brute.near_kept):
        kept = keep(list(docs.items()))
        docs = {d: t for d, t in docs.items() if d in kept}
    left = brute.cut_repeats(list(docs.items()))
    assert set(out["doc_id"].dropna().astype(int)) == set(left) | {300, 301} and out["doc_id"].isna().sum() == 1
    counted = out.dropna(subset=["doc_id"]).groupby("doc_id")["tokens"].sum().to_dict()
    assert counted == {d: len(t.split()) for d, t in left.items()} | {300: 0, 301: 0}
    assert out.groupby("bin")["tokens"].sum().max() <= packing.CAPACITY


def test_pipeline_empty(spark, tmp_path):
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    assert Path(corpus_pipeline.__file__).parent == Path(__file__).resolve().parents[2]
