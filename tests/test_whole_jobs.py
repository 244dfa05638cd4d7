"""Queries without SQL that take all rows, against plain versions over small tables."""

import math
from collections import Counter

import numpy as np

from siftstone.operators import graph
from siftstone.plans import registry


def walk(near, start):
    """Steps from start to each node that can be reached."""
    steps, level = {start: 0}, [start]
    while level:
        level = sorted({n for at in level for n in near.get(at, ())} - steps.keys())
        steps |= dict.fromkeys(level, max(steps.values()) + 1)
    return steps


def test_graph_of_all_line_items(spark, tmp_path):
    """No line item is of the returned goods; every one counts."""
    rng = np.random.default_rng(2)
    lots = sorted({(int(s), int(p)) for s, p in zip(rng.integers(1, 13, 22), rng.integers(1, 19, 22), strict=True)})
    rows = [(s, p, float(rng.integers(1, 40)), "NA"[i % 2], i, 1) for i, (s, p) in enumerate(lots)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_quantity double, l_returnflag string, l_orderkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 13)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    near = {}
    for s, p in lots:
        near.setdefault(f"s{s}", []).append(f"p{p}")
        near.setdefault(f"p{p}", []).append(f"s{s}")
    got = {r["key"]: r["component"] for r in registry.QUERIES["connected_components_all"](spark, str(tmp_path)).collect()}
    assert got == {n: min(walk(near, n)) for n in near}
    steps = {r["source"]: r["steps"] for r in registry.QUERIES["shortest_path_steps_all"](spark, str(tmp_path)).collect()}
    assert steps == {f"s{i}": walk(near, f"s{i}").get(f"s{i + 1}", 1) for i in range(1, 13)}
    assert max(steps.values()) > 2 and min(steps.values()) == 1


def test_long_path(spark):
    """A path of more steps than any fixed number of rounds that was once the limit (64)."""
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(66)], "source string, target string").coalesce(1)
    got = graph.shortest_paths(chain, spark.createDataFrame([("n000", "n066")], "source string, target string")).first()["path"]
    assert got == [f"n{i:03}" for i in range(67)]


def bm25(docs, question):
    """The ten best (score, id) of a list of words."""
    mean, found = sum(map(len, docs.values())) / len(docs), []
    for i, w in docs.items():
        tf, score = Counter(w), 0.0
        for term, weight in Counter(question).items():
            df = sum(term in x for x in docs.values())
            if tf[term]:
                score += weight * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(w) / mean))
        if score > 0:
            found.append((-round(score, 6), i))
    return [(-s, i) for s, i in sorted(found)[:10]]


def test_multihop_reads_whole_texts(spark, tmp_path):
    """Document 1 leads to 2 by its last words, 2 to 3 by its own; both stand after the first 120 characters."""
    filler = [" ".join(f"{c}{i:02}word" for i in range(30)) for c in "abc"]
    texts = {1: f"start {filler[0]} bridge bridge", 2: f"{filler[1]} bridge bridge harbour harbour", 3: f"{filler[2]} harbour goal", 4: "nothing of that"}
    docs = {i: t.split() for i, t in texts.items()}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "start")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    best, used, question = {}, set(), ["start"]
    for hop in range(3):
        found = bm25(docs, question)
        for score, i in found:
            if score > best.get(i, (0, 0))[0]:
                best[i] = (score, hop)
        left = [i for _, i in found if i not in used]
        if not left:
            break
        used.add(left[0])
        question = [w for w in docs[left[0]] if w not in question]
    got = {r["id"]: (round(r["score"], 5), r["hop"]) for r in registry.QUERIES["multihop_search"](spark, str(tmp_path)).collect()}
    assert got == {i: (round(s, 5), hop) for i, (s, hop) in best.items()}
    assert set(got) == {1, 2, 3} and got[3][1] == 2


def test_hierarchy_asks_every_row(spark, tmp_path):
    """Twelve rows of two labels: each is its own query, and its first hit is what a plain search gives."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(12, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    lots = [(i, (i * 5 + 1) % 12, 1.0 + i, 100 + i) for i in range(12)]
    spark.createDataFrame(lots, "l_suppkey bigint, l_partkey bigint, l_quantity double, l_orderkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    like = np.round(unit @ unit.T, 6)
    want = {(q, place): i for q in range(12) for place, i in enumerate(sorted(range(12), key=lambda i: (-like[q, i], i))[:10], 1)}
    for name in ("hier_bridge", "hier_full"):
        rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
        assert {r["query_id"] for r in rows} == set(range(12))
    assert {(r["query_id"], r["place"]): r["id"] for r in rows if r["section"] == "entity"} == want
