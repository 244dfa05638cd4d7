"""Operators whose work must stay where the rows are: same rows as the plain versions, and plans without the steps that grew."""

import numpy as np
import pyarrow as pa
import pytest

from siftstone import session
from siftstone.operators import fulltext, graph, knn, merge, paths, search, wiki
from siftstone.operators.components import components
from siftstone.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("repeats", [False, True])
def test_rankings_as_joined(spark, repeats):
    """Null and empty texts, equal scores, repeated ids, queries of unknown words and of the same id."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 12, rng.integers(1, 30)) ** 2 // 6) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 100, texts[0]) for i in range(6)] + [(200, None), (201, "")] + [(3, texts[4])] * repeats
    docs = spark.createDataFrame(rows, "doc bigint, body string").repartition(3)
    asked = spark.createDataFrame([("a", "w0 w1 w1"), ("b", texts[0]), ("c", "none"), ("d", "w4"), ("d", "w6 w10")], "q string, ask string")
    got = fulltext.rankings(docs, asked, "doc", "body", "q", "ask", 5, ("bm25", "all_terms"))
    for kind, found in zip(("bm25", "all_terms"), got, strict=True):
        want = fulltext._joined(docs, asked, ("doc", "body", "q", "ask"), kind, 5)
        assert found.count() and sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("cells", [1 << 20, 200])
@pytest.mark.parametrize("dense", [0, 3, 10**9])
def test_product_and_best(monkeypatch, cells, dense):
    """Dense or single cells, one piece or many: the same sums, and of those the same best."""
    monkeypatch.setattr(fulltext, "CELLS", cells)
    monkeypatch.setattr(fulltext, "DENSE", dense)
    rng = np.random.default_rng(7)
    weights, counts = rng.integers(0, 3, (9, 30)), rng.integers(0, 4, (200, 30)) * (rng.random((200, 30)) < 0.4)
    query, term = np.nonzero(weights)
    asked = fulltext.Asked(pa.table({"query_id": query, "term": [f"w{t}" for t in term], "weight": weights[query, term]}))
    words = pa.array([[f"w{t}" for t in range(30) for _ in range(row[t])] + ["other"] for row in counts])
    row, at, tf, size = asked.postings(words)
    assert (size == counts.sum(axis=1) + 1).all()
    assert np.array_equal(asked.product(200, row, at, tf, asked.weight), (counts @ weights.T)[:, asked.queries.to_numpy()])
    best = fulltext._Best(len(weights), 4)
    scores = counts @ weights.T
    for start in range(0, 200, 20):
        best.add(scores[start : start + 20], np.arange(1000 - start, 980 - start, -1))
    found = list(zip(*best.prune(), strict=True))
    ids = np.concatenate([np.arange(1000 - start, 980 - start, -1) for start in range(0, 200, 20)])
    for q in range(len(weights)):
        assert [int(i) for x, _, i in found if x == q] == sorted(ids[scores[:, q] > 0].tolist(), key=lambda i: (-scores[1000 - i, q], i))[:4]


@pytest.mark.parametrize("name", ["bm25_topk", "all_terms_rank", "rrf_fusion", "rewrite_search"])
def test_postings_stay(spark, name):
    """Only what a task found is shuffled: no join, no postings by term."""
    text = plan(registry.QUERIES[name](spark, SF))
    assert "MapInArrow" in text and "Generate explode" not in text and "SortMergeJoin" not in text


def test_texts_meet_few_rows_where_they_lie(spark):
    docs = spark.createDataFrame([(i, "x" * 9) for i in range(9)], "id bigint, text string")
    met = search.with_rows(docs.where("id < 2").select("id"), docs, "id")
    assert met.count() == 2 and "BroadcastHashJoin" in plan(met)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("k,least,others,once", [(3, None, False, False), (3, None, True, False), (40, 0.1, True, False), (None, 0.3, False, True)])
def test_streamed_block(monkeypatch, metric, k, least, others, once):
    """Tiles smaller than blocks, equal vectors, a zero vector: the hits of one plain product."""
    for name, n in (("ROWS", 7), ("COLUMNS", 13), ("EXACT", 5)):
        monkeypatch.setattr(knn, name, n)
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    v[5] = 0
    block, ids = knn._Block(k, metric, least, others, once), np.arange(60)
    arrow = pa.array(v.tolist(), pa.list_(pa.float64()))
    block.ask(pa.array(ids[:20]), arrow[:20])
    block.ask(pa.array(ids[20:40]), arrow[20:40])
    out = [b for at in (0, 30) for b in block.meet(pa.array(ids[at : at + 30]), arrow[at : at + 30])] + list(block.finish())
    found = sorted((q, i, round(s, 6) + 0.0) for b in out for q, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True))
    score = np.round(knn.similarities(v[:40], v, metric), 6)
    want = []
    for q in range(40):
        fit = [i for i in range(60) if (least is None or score[q, i] >= least) and not (others and i == q) and not (once and i <= q)]
        want += [(q, i, score[q, i] + 0.0) for i in sorted(fit, key=lambda i: (-score[q, i], i))[:k]]
    assert found == sorted(want)


def test_metrics_within_classes(spark):
    """The same as with every pair of a class written out, without writing them."""
    classes = spark.createDataFrame([(i, i % 3) for i in range(20)] + [(20, 7), (21, None)], "id bigint, class int")
    ranked = spark.createDataFrame([(q, (q * 5 + r * r) % 21, r) for q in range(21) for r in range(1, 7)], "query_id bigint, id bigint, rank int")
    a, b = classes.alias("a"), classes.alias("b")
    qrels = a.join(b, "class").where("a.id <> b.id").selectExpr("a.id query_id", "b.id id", "1 relevance")
    got, want = (sorted((r["query_id"], r["k"], *[round(x, 9) for x in r[2:]]) for r in x.collect()) for x in (search.metrics_within(ranked, classes), search.metrics(ranked, qrels)))
    assert got == want and len(got) == 100


def test_metrics_of_grades(spark):
    """Graded relevance: the ideal order has the better ones first, and more relevant documents than the deepest place."""
    ranked = spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], "query_id string, id string, rank int")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 1), ("q", "d", 1)], "query_id string, id string, relevance int")
    row = search.metrics(ranked, qrels, (2,)).first()
    assert round(row["ndcg"], 6) == round((1 + 3 / np.log2(3)) / (3 + 1 / np.log2(3)), 6) and row["recall"] == 0.5


@pytest.mark.parametrize("ends", [10**9, 0])
def test_paths_from_both_ends(spark, monkeypatch, ends):
    """In a task's memory or as tables: lengths and least paths as a plain search has them; nodes without edges, parts that aren't joined."""
    monkeypatch.setattr(paths, "ENDS", ends)
    rng = np.random.default_rng(11)
    links = {tuple(sorted(p)) for p in rng.integers(0, 20, (24, 2)).tolist() if p[0] != p[1]} | {(20, 21), (21, 22), (22, 23), (23, 24)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def best(a, b):
        seen, level = {a}, [[a]]
        while level:
            if hit := [p for p in level if p[-1] == b]:
                return min(hit)
            level = [[*p, n] for p in level for n in near.get(p[-1], ()) if n not in seen]
            seen |= {p[-1] for p in level}
        return None

    wanted = [(a, b) for a in (0, 3, 7, 20, 24, 30) for b in range(32)]
    edges, asked = spark.createDataFrame(sorted(links), "source bigint, target bigint"), spark.createDataFrame(wanted, "source bigint, target bigint")
    steps = {(r["source"], r["target"]): r["steps"] for r in graph.path_lengths(edges, asked).collect()}
    assert steps == {(a, b): (lambda p: p and len(p) - 1)(best(a, b)) for a, b in wanted} and max(filter(None, steps.values())) > 3
    found = {(r["source"], r["target"]): r["path"] for r in graph.shortest_paths(edges, asked).collect()}
    assert found == {(a, b): best(a, b) or [a, b] for a, b in wanted}


def test_search_looks_at_the_lesser_side():
    """A hub on one side: its neighbours' neighbours are never read."""
    n = 3000
    lists = {0: list(range(1, n)), **{i: [0] for i in range(1, n)}}
    lists[1], lists[n], lists[n + 1] = [0, n], [1, n + 1], [n]
    start = np.concatenate([[0], np.cumsum([len(lists[i]) for i in range(n + 2)])])
    g = paths.Graph(start, np.array([x for i in range(n + 2) for x in lists[i]], np.int32))
    g.prepare()
    read = []
    around = g._around
    g._around = lambda nodes: read.append(int(g.size[nodes].sum())) or around(nodes)
    assert g.search(n + 1, 0, False) == (3, []) and sum(read) < 10


@pytest.mark.parametrize("threshold", [0.4, -0.2])
def test_clusters_by_parts(spark, threshold):
    """The clusters of whole blocks: two blocks with the same vectors, zero vectors, equal vectors, a null block and a null vector."""
    rng = np.random.default_rng(12)
    v = np.concatenate([rng.normal(size=(30, 3)), np.zeros((2, 3))])
    v[7] = v[3]
    rows = [(i + 100 * b, v[i].tolist(), b or None) for b in (0, 1, 2) for i in range(32 - 10 * b)] + [(900, None, 1)]
    facts = spark.createDataFrame(rows, "id bigint, v array<double>, b int")
    got = {r["id"]: r["cluster"] for r in merge.semantic_clusters(facts, "id", "v", threshold, ["b"]).collect()}
    want = {}
    for b in (0, 1, 2):
        n = 32 - 10 * b
        want |= {i + 100 * b: int(x) + 100 * b for i, x in enumerate(merge.average_linkage(v[:n], 1 - threshold))}
    assert got == want and 3 < len(set(got.values())) < len(got) if threshold > 0 else got == want


def test_clusters_do_not_gather_blocks(spark, monkeypatch):
    """Far apart facts of one block never stand in one matrix."""
    rng = np.random.default_rng(13)
    facts = spark.createDataFrame([(i, (np.eye(20)[i // 2] + rng.normal(size=20) / 100).tolist()) for i in range(40)], "id bigint, v array<double>")
    found = merge.semantic_clusters(facts, "id", "v", 0.4)
    assert {r["id"]: r["cluster"] for r in found.collect()} == {i: i // 2 * 2 for i in range(40)}
    assert "part#" in plan(found)


def test_texts_come_in_few_rows(spark):
    """Long texts: the session's bound on the bytes of an Arrow batch is set before pages are made."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    wiki.pages(spark.createDataFrame([(1, "a.md", "x")], "document_id bigint, name string, text string"))
    assert int(spark.conf.get(key)) == session.BATCH_BYTES


def test_components_of_a_chain_and_a_crowd(spark):
    """A numbered chain, a dense bipartite part, a pair, a self-loop: few rounds, the least key of each."""
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 2000 + (i * 7 + j) % 90) for i in range(60) for j in range(20)] + [(5000, 4000), (7, 7), (4000, 5000)]
    got = {r["key"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), max_rounds=12).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for a, b in links[300:1500] for i in (a, b)} | {4000: 4000, 5000: 4000}
