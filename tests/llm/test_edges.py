"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest

from siftstone.llm import exact_dedup, fingerprints, language, near_dedup, packing, pieces, quality, sharding, suffix_dedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, slot string, `key` string, `id` string, `__key` string, tokens map<string,int>"
WORDS = [f"w{i}x" for i in range(4000)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "a", "b", "c", "d", "e", {"x": 1})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, wordless and very long texts, ties and repeated rows."""
    shared = prose(99, 70)
    rows = [
        row(1, prose(1, 200)), row(2, prose(1, 200)), row(3, None), row(None, prose(2, 100)), row(None, None), row(4, ""), row(5, ""), row(6, "  \n\t "), row(7, "!!! ???"),
        row(8, prose(3, 60) + " " + shared), row(9, prose(4, 60) + ". " + shared.upper() + "!"), row(10, prose(5, 90)), row(10, prose(5, 90)), row(10, prose(6, 90)), row(11, "one two"),
        row(12, prose(7, 60_000)), row(13, "x" * 50_000), row(14, "日本語 ▁ \0 🙂 é\n\nzwei"), row(15, prose(8, 40), None, None), (None,) * 11, (None,) * 11,
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (4, 0, 1), (8, 1, 0), (8, 0, 0), (12, 1, 0), (None, 1, 1), (99, 1, 1), (10, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def texts(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in df.collect())


def same_columns(a, b):
    assert a.columns == b.columns
    assert a.dtypes == b.dtypes


def test_suffix(odd, none):
    out = suffix_dedup.cut_repeats(odd)
    same_columns(out, odd)
    got = {r["doc_id"]: r for r in out.where("doc_id is not null and doc_id <> 10").collect()}
    assert 2 not in got and got[1]["text"] == prose(1, 200)
    assert got[8]["text"].endswith(prose(99, 70))
    assert got[9]["text"] == prose(4, 60) + ". !" and got[9]["n_chars"] == len(got[9]["text"])
    assert {3, 4, 5, 6, 7, 11, 12, 13, 14, 15} <= set(got)
    assert out.where("doc_id = 10").count() == 3 and out.where("doc_id is null").count() == 4
    assert suffix_dedup.cut_repeats(none).count() == 0


def test_exact(odd, none):
    out = exact_dedup.exact_dedup(odd)
    same_columns(out, odd)
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(4) == 1 and ids.count(5) == 0
    assert ids.count(10) == 2 and ids.count(None) == 4 and ids.count(3) == 1
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_given_history(odd, spark):
    history = spark.createDataFrame([(500, prose(1, 200)), (501, ""), (502, "unseen"), (503, None)], "doc_id bigint, text string")
    ids = [r["doc_id"] for r in exact_dedup.exact_dedup(odd, history=history).collect()]
    assert not {1, 2, 4, 5} & set(ids) and {3, 8, 12} <= set(ids)
    index = exact_dedup.build_index(exact_dedup.winners(exact_dedup.digests(history, "doc_id", "text")))
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in exact_dedup.exact_dedup(odd, index=index).collect())


def test_near(odd, none):
    out = near_dedup.near_dedup(odd)
    same_columns(out, odd)
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(10) == 2
    assert {3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15} <= set(ids) and ids.count(None) == 4
    assert near_dedup.near_dedup(none).count() == 0
    rows = near_dedup.near_classes(odd).collect()
    assert len(rows) == odd.count() and sum(r["keep"] for r in rows if r["doc_id"] == 1) == 1
    assert {r["class_id"] for r in rows if r["doc_id"] in (1, 2)} == {1} and {r["links"] for r in rows if r["doc_id"] in (1, 2, 3, 4)} == {0}
    assert near_dedup.near_classes(none).count() == 0


def test_toxicity(odd, none, labels):
    for known in (labels, None):
        out = toxicity.drop_toxic(odd, known)
        same_columns(out, odd)
        assert out.count() >= 15
    assert toxicity.drop_toxic(none, labels).count() == 0


def test_packing(odd, none):
    out = packing.pack(odd, capacity=128)
    rows = out.toPandas()
    assert rows["bin"].isna().sum() == 7  # 3, 4, 5, 6, two null rows, and the null text without an id
    real = rows.dropna(subset=["bin"])
    assert real.groupby("bin")["tokens"].sum().max() <= 128
    assert real[real["doc_id"] == 12]["tokens"].sum() == 60_000 and real[real["doc_id"] == 10]["tokens"].sum() == 270
    for _, b in real.groupby("bin"):
        b = b.sort_values("place")
        assert (b["place"].to_numpy()[1:] == b["tokens"].cumsum().to_numpy()[:-1]).all()
    assert packing.pack(none).count() == 0


def test_shard(odd, none):
    out = sharding.shard(odd, shards=4)
    assert out.columns == [{"shard": "shard_input", "slot": "slot_input"}.get(c, c) for c in odd.columns] + ["row_number", "position", "shard", "slot"]
    rows = out.toPandas()
    n = odd.count()
    assert sorted(rows["row_number"]) == list(range(n)) and sorted(rows["position"]) == list(range(n))
    assert (rows["position"] == rows["slot"] * 4 + rows["shard"]).all()
    assert (sharding.permute(rows["position"].to_numpy(), n, inverse=True) == rows["row_number"]).all()
    ordered = rows.sort_values("row_number")["doc_id"]
    assert ordered.isna().tolist() == [True] * 4 + [False] * (n - 4) and ordered.dropna().is_monotonic_increasing
    assert sharding.shard(none).count() == 0


def test_fingerprints(odd, none):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint(odd).where("doc_id is not null").collect()}
    assert rows[3]["root"] is None and rows[3]["sections"] is None
    assert rows[4]["root"] == rows[5]["root"] and len(rows[4]["sections"]) == 1
    assert rows[1]["root"] == rows[2]["root"] != rows[8]["root"] and len(rows[14]["sections"]) == 2
    assert fingerprints.fingerprint(none).count() == 0
    assert fingerprints.edits(fingerprints.fingerprint(none), fingerprints.fingerprint(none)).count() == 0


def test_edits(spark):
    """Changed, repeated, moved and re-parted paragraphs, and documents in one table only."""
    before = [(1, "a\nb\n\nc\n\nd"), (2, "a\na\nb"), (3, "a\nb\nc"), (4, "a\nb"), (5, "x"), (6, None), (7, "same\n\n same"), (8, ""), (9, "a\n\nb\n\na")]
    after = [(1, "a\nb\n\nC\n\nd"), (2, "a\nb"), (3, "b\na\nc"), (4, "a\n\nb"), (6, "y"), (7, "same\n\n same"), (8, "z"), (9, "b\n\na\n\na"), (10, "new")]
    trees = [fingerprints.fingerprint(spark.createDataFrame(x, "doc_id bigint, text string")) for x in (before, after)]
    got = sorted((r["doc_id"], r["change"], r["section"], r["paragraph"]) for r in fingerprints.edits(*trees).collect())
    assert got == sorted(
        [(1, "added", 1, 0), (1, "removed", 1, 0), (2, "removed", 0, 1), (3, "moved", 0, 0), (3, "moved", 0, 1), (4, "moved", 1, 0), (5, "removed", 0, 0), (6, "added", 0, 0), (8, "added", 0, 0), (8, "removed", 0, 0)]
        + [(9, "moved", 0, 0), (9, "moved", 1, 0), (10, "added", 0, 0)]
    )


def test_language(odd, none):
    rows = language.identify(odd, language.train(odd)).collect()
    assert len(rows) == odd.count()
    assert {r["language"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert {r["language"] for r in rows if r["doc_id"] in (1, 2, 12)} == {"en"}
    assert language.identify(none, language.train(none)).count() == 0
    assert {r["language"] for r in language.identify(odd, language.train(none)).collect()} == {"und"}


def test_quality(odd, none, labels):
    out = quality.quality(odd, labels).toPandas()
    assert len(out) == odd.count() and out["quality"].between(0, 1).all() and out["keep"].notna().all()
    assert quality.quality(none, labels).count() == 0
    assert (quality.quality(odd, labels.limit(0)).toPandas()["p_doc"] == 0.5).all()


def test_pieces(odd, none):
    v = pieces.Vocabulary.load()
    out = pieces.encode(odd, v)
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all((r["ids"] is None) == (r["n_tokens"] is None) for r in rows)
    assert all(r["intact"] for r in rows if r["ids"] is not None)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(out, v).collect()}
    assert back[12] == prose(7, 60_000) and back[4] == "" and back[3] is None
    assert pieces.encode(none, v).count() == 0
