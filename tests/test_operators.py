"""Operators on small literal tables."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.models import HashEmbedder, KeywordEmbedder, OverlapReranker, RuleModel, ask, embed, first_json, rerank
from siftstone.operators import chunking, extraction, graph, knn, merge, modes, scoring, search, wiki
from siftstone.operators.numbering import layers, number_rows
from siftstone.sources import files, html


def test_split_windows():
    text = "First one here. Second sentence. Third is the last."
    cut = chunking.split_text(text, 24, 6)
    assert len(cut) >= 2 and cut[1][0] < cut[0][1] and all(t for _, _, t in cut)
    assert chunking.split_text("  \n ") == [] and chunking.split_text(None) == []
    assert chunking.split_text("ab. cdefghijkl", 5, 4) == [(0, 3, "ab.")]
    assert chunking.split_text("ab. cdefghijkl", 5, 4, strict_tail=True)[-1][1] == 14
    with pytest.raises(ValueError):
        chunking.split_text("x", 4, 4)


def test_sections():
    found = chunking.sections("# P\nintro\n## C\ntext\n```\n# not a heading\n```\n### L\ndeep\n## D\nmore")
    assert [p for p, _ in found] == [["P"], ["P", "C"], ["P", "C", "L"], ["P", "D"]] and "# not a heading" in found[1][1]


def test_html():
    page = """<html><head><title>T &amp; x</title><meta name="description" content="About"><style>p{}</style></head><body><nav>menu</nav><!-- no -->
    <article><h1>Head</h1><p>%s</p><div class="share social">noise</div><img alt="A" src="/a.png"><img src="/logo.png"><img src="/s.png" width="10" height="10">
    <table><caption>Harvest</caption><tr><th>Field</th><th>Sacks</th></tr><tr><td>north</td><td></td></tr></table><div style="border: 0; background-image:url('b.jpg')">in</div>
    <picture><source srcset="s1.png 1x, s2.png 2x"></picture><script>bad()</script></article></body></html>""" % ("word " * 60)
    title, description, text = html.extract(page, "http://h/x/")
    assert title == "T & x" and description == "About"
    lines = text.split("\n")
    assert lines[:3] == ["Title: T & x", "Description: About", "Head"]
    for line in ("Image: A (http://h/a.png)", "Table: Harvest", "Field | Sacks", "north", "Background image: http://h/x/b.jpg", "Image source: http://h/x/s2.png"):
        assert line in lines
    assert not any(w in text for w in ("menu", "noise", "bad()", "logo", "s.png"[:0] or "http://h/s.png"))
    assert html.extract(None) == (None, None, None) and html.extract("")[2] == ""
    assert html.extract("<p>open <b>never closed")[2] == "open\nnever closed"


def test_sheet():
    pages = files.sheet_pages("a,,c\n1,x|y,\n,,\n2,z\n", "f.csv", 1)
    assert len(pages) == 2 and pages[0].startswith("Table: f.csv / csv_sheet\n") and "| a | column_2 | c |" in pages[0] and "x\\|y" in pages[0]
    assert pages[1].startswith("Table: f.csv / csv_sheet (continued)") and files.sheet_pages("", "f") == []


def test_keys_and_prefixes(spark):
    assert files.checked_key(" a/b.txt ") == "a/b.txt"
    for bad in ("", "/a", "a/../b", "a//b", "."):
        with pytest.raises(ValueError):
            files.checked_key(bad)
    rows = spark.createDataFrame([("a/b",), ("a/bc",), ("a/b/c",)], "k string")
    assert {r[0] for r in rows.where(files.under(F.col("k"), "a/b/")).collect()} == {"a/b", "a/b/c"}


def test_formats(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td1\t1.0\nq2\td2\t0\n")
    assert {(r.query_id, r.id, r.relevance) for r in files.qrels(spark, f"{tmp_path}/q.tsv").collect()} == {("q1", "d1", 1), ("q2", "d2", 0)}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, f"{tmp_path}/x.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "x.csv").write_text("doc_name|question\n a | why? \n")
    assert files.bar_separated(spark, f"{tmp_path}/x.csv", ["doc_name"]).first() == ("a", "why?")
    with pytest.raises(ValueError):
        files.bar_separated(spark, f"{tmp_path}/x.csv", ["answer"])


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_knn_in_blocks(spark, metric):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(60, 5)), rng.normal(size=(17, 5))
    v[5] = 0
    held = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id bigint, vector array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id bigint, query_vector array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in knn.top_k(knn.pairs(held, asked, 4, metric, block=7), 4).collect()}
    score = np.round(knn.similarities(q, v, metric), 6)
    for i, row in enumerate(score):
        assert [got[i, k + 1] for k in range(4)] == sorted(range(60), key=lambda j: (-row[j], j))[:4]


def test_vector_dimension(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 2.0])], "id bigint, vector array<double>")
    with pytest.raises(Exception, match="dimension mismatch"):
        knn.pairs(rows, spark.createDataFrame([(1, [1.0])], "query_id bigint, query_vector array<double>"), 1).collect()


def test_metrics_against_hand(spark):
    ranked = spark.createDataFrame([("q", d, r) for r, d in enumerate(["D3", "D1", "D1", "D2"], 1)], "query_id string, id string, rank int")
    qrels = spark.createDataFrame([("q", "D1", 2), ("q", "D2", 1)], "query_id string, id string, relevance int")
    row = search.metrics(ranked, qrels, (3,)).first()
    assert (row["recall"], round(row["precision"], 6), row["mrr"]) == (1.0, 0.666667, 0.5)


def test_fusion_ties_and_budget(spark):
    lists = spark.createDataFrame([("q", 0, 1, "a", 1.0), ("q", 0, 2, "b", 1.0), ("q", 1, 1, "b", 1.0), ("q", 1, 2, "c", 1.0)], "query_id string, list_no int, rank int, id string, weight double")
    assert [r.id for r in search.fused_top(lists, 3).orderBy("rank").collect()] == ["b", "a", "c"]
    rows = spark.createDataFrame([("x", 1, 50), ("x", 2, 5), ("y", 1, 3), ("y", 2, 3), ("y", 3, 9)], "g string, p int, n int")
    kept = search.budget_prefix(rows, ["g"], [F.asc("p")], "n", 10)
    assert sorted((r.g, r.p) for r in kept.collect()) == [("x", 1), ("y", 1), ("y", 2)]
    groups = {(r.g, r.p): r.grp for r in search.budget_groups(rows, "g", "p", "n", 10).collect()}
    assert groups == {("x", 1): 1, ("x", 2): 2, ("y", 1): 1, ("y", 2): 1, ("y", 3): 2}


def test_graph_edges_and_nodes(spark):
    relations = spark.createDataFrame([("b", "a", 2.0, "x", 1), ("a", "b", None, "y", 2), ("a", "b", 0.0, "y", 3), ("a", "a", 1.0, "z", 4), ("", "a", 1.0, "z", 5)], "source string, target string, weight double, type string, position int")
    assert [tuple(r) for r in graph.build_edges(relations).collect()] == [("a", "b", 4.0, "y", 3)]
    assert graph.build_edges(relations, False).count() == 3
    entities = spark.createDataFrame([("N", "t2", "d1", 1, 1), ("N", "t1", "d2", 2, 2), ("N", "t1", "d1", 1, 3), ("N", "t2", None, 3, 4)], "name string, type string, description string, source_id int, position int")
    row = graph.build_nodes(entities).first()
    assert (row["type"], row["description"], row["source_ids"], row["n"]) == ("t2", "d1<SEP>d2", [1, 2, 3], 4)


def test_shortest_paths_against_search(spark):
    rng = np.random.default_rng(8)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 14, (16, 2)).tolist()}
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "source string, target string")
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(f"n{a:02}", set()).add(f"n{b:02}")
            near.setdefault(f"n{b:02}", set()).add(f"n{a:02}")

    def best(a, b):
        level = [[a]]
        for _ in range(15):
            ends = [p for p in level if p[-1] == b]
            if ends:
                return min(ends)
            level = [[*p, n] for p in level for n in near.get(p[-1], ()) if n not in p]
        return [a, b]

    wanted = [(f"n{a:02}", f"n{b:02}") for a, b in itertools.product(range(3), range(14))]
    got = graph.shortest_paths(edges, spark.createDataFrame(wanted, "source string, target string"))
    for r in got.collect():
        assert r["path"] == best(r["source"], r["target"])


def test_ancestors_stop(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "root"), ("c", "c"), ("d", "e"), ("e", "d")], "node string, parent string")
    rows = graph.ancestors(parents, parents.select("node"), 3).collect()
    chain = {n: [r.ancestor for r in sorted(rows, key=lambda r: r.place) if r.node == n] for n in "abcde"}
    assert chain["a"] == ["a", "b", "root"] and chain["c"] == ["c"] and chain["d"] == ["d", "e", "d", "e"]


def test_average_linkage_brute():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(24, 3))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(24)]
    while len(groups) > 1:
        d, a, b = min((np.mean([np.linalg.norm(unit[i] - unit[j]) for i in x for j in y]), p, q) for (p, x), (q, y) in itertools.combinations(enumerate(groups), 2))
        if d > 0.5:
            break
        groups[a] += groups.pop(b)
    got = merge.average_linkage(v, 0.5)
    assert {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got.tolist())} == {frozenset(g) for g in groups}


def test_merging(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id bigint, name string, description string")
    new = spark.createDataFrame([(5, "A", "z"), (6, "c", "w")], "id bigint, name string, description string")
    groups = spark.createDataFrame([(1, 1), (5, 1)], "id bigint, grp bigint")
    rows = {r["id"]: (r["name"], r["description"], r["members"]) for r in merge.apply_merge(old, new, groups).collect()}
    assert rows == {1: ("a", "x\nz", [1, 5]), 2: ("b", "y", [2]), 6: ("c", "w", [6])}
    assert sorted(r["description"] for r in merge.upsert(old, new.withColumn("id", F.lit(2).cast("bigint")), ["id"]).collect())[0] in ("w", "x")


def test_evidence(spark):
    wanted = spark.createDataFrame([("q", 1, "The  Fox", None), ("q", 2, None, "a/b"), ("q", 3, "nothing", "a/b"), ("p", 1, None, None)], "query_id string, evidence_id int, expected string, locator string")
    found = spark.createDataFrame([("q", "see the fox run", "a/b/c")], "query_id string, text string, found_locator string")
    got = {r["query_id"]: round(r["evidence_recall"], 4) for r in scoring.evidence_recall(wanted, found).collect()}
    assert got == {"q": 0.6667, "p": 0.0}


def test_models(spark):
    rows = spark.createDataFrame([(1, "fox and dog"), (2, None), (3, "")], "id int, text string")
    vectors = {r.id: r.vector for r in embed(rows, "text", KeywordEmbedder(("fox",))).collect()}
    assert vectors[2] is None and [round(x, 3) for x in vectors[1]] == [1.0, 0.1] and len(HashEmbedder().embed(["ab"])[0]) == 8

    def answer(prompt):
        if "dog" in prompt:
            raise RuntimeError("no dogs")
        return prompt.upper()

    replies = {r.id: r.reply for r in ask(rows.unionByName(spark.createDataFrame([(4, "x")], "id int, text string")), "text", RuleModel(answer)).collect()}
    assert replies == {1: None, 2: None, 3: "", 4: "X"}
    results = spark.createDataFrame([("q", "red fox", 1, 10, "blue"), ("q", "red fox", 2, 11, "a red fox")], "query_id string, query string, place int, id bigint, text string")
    assert [r.id for r in rerank(results, OverlapReranker(), 1).collect()] == [11]
    assert first_json('<think>{"a":1}</think>```json\n{"b": {"c": 2}}\n```') == {"b": {"c": 2}} and first_json("none") is None


def test_extraction(spark):
    chunks = spark.createDataFrame([("d", "c1", "Otto knows Vera"), ("d", "c2", "broken")], "document_id string, chunk_id string, text string")

    def answer(prompt):
        if "broken" in prompt:
            return "sorry"
        return json.dumps({"entities": [{"name": "Otto", "type": "person"}, {"name": "Vera", "type": "person"}, {"name": ""}], "relations": [{"source": "otto", "target": "VERA", "type": "knows"}, {"source": "Otto", "target": "Emil", "type": "knows"}]})

    entities, relations, issues = extraction.extract(chunks, RuleModel(answer))
    assert sorted(r["name"] for r in entities.collect()) == ["Otto", "Vera"] and relations.count() == 1 and issues.count() == 2
    kept, left = extraction.constrain(entities, relations, spark.createDataFrame([("Place",)], "type string"))
    assert kept.count() == 0 and left.count() == 0


def test_merge_chunks(spark):
    rows = [("d", f"c{i}", i, t, i * 10, i * 10 + 10, v) for i, (t, v) in enumerate([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.01])])]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, text string, token_start int, token_end int, vector array<double>")
    out = {r["text"]: (r["token_start"], r["token_end"], r["parent_chunk_ids"]) for r in extraction.merge_chunks(chunks, RuleModel(lambda p: '{"text": "ac"}')).collect()}
    assert out == {"ac": (0, 30, ["c0", "c2"]), "b": (10, 20, ["c1"])}


def test_text_functions(spark):
    row = spark.sql("SELECT '  A  b\n' AS x, '' AS e, CAST(NULL AS STRING) AS n").select(T.strip(F.col("x")), T.normal_name(F.col("x")), T.count_words(F.col("x")), T.count_words(F.col("e")), T.count_words(F.col("n"))).first()
    assert tuple(row)[:2] == ("A  b", "a b") and tuple(row)[2:4] == (2, 0)


def test_numbers_and_layers(spark):
    rows = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 1000).alias("node"))
    numbered = number_rows(rows, [F.asc("node")])
    assert numbered.where("node <> row_number").count() == 0 and number_rows(rows.limit(0), [F.asc("node")]).count() == 0
    tree = layers(rows, [F.asc("node")], 10)
    assert {r["layer"]: r["count"] for r in tree.groupBy("layer").count().collect()} == {0: 1000, 1: 100, 2: 10, 3: 1}
    assert tree.where("parent = 'root'").count() == 1


def test_wiki(spark):
    docs = spark.createDataFrame([(1, "a/b.md", "# Title\nintro\n## Sub\nsame\n```\n# no\n```"), (2, "x/y.txt", None), (3, "z.md", "plain " * 100)], "document_id bigint, name string, text string")
    made = {r["document_id"]: r for r in wiki.pages(docs).collect()}
    assert made[1]["title"] == "Title" and made[1]["key"] == "1-title.md" and "#### Sub" in made[1]["text"] and "\n# no" in made[1]["text"]
    assert made[2]["title"] == "y" and len(made[3]["summary"]) <= 280
    cut = wiki.chunks(wiki.pages(docs), 300, 10).where("document_id = 3").orderBy("chunk_index").collect()
    assert all(r["text"].startswith("Page: z\nSection: ") and len(r["text"]) <= 300 for r in cut)


def test_rewritten_and_multihop(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red dog"), (3, "blue dog")], "id bigint, text string")

    def find(asked):
        return search.top_k(search.bm25(docs, asked, "id", "text", "query_id", "text"), 3)

    variants = spark.createDataFrame([("q", 0, "fox"), ("q", 1, "dog")], "query_id string, variant int, text string")
    assert [r["id"] for r in modes.rewritten(find, variants, 3).orderBy("rank").collect()] == [1, 2, 3]
    asked = spark.createDataFrame([("q", "fox")], "query_id string, text string")
    hops = {r["id"]: r["hop"] for r in modes.multihop(find, lambda q, found: found.where("rank = 1").join(docs, "id").select("query_id", "text"), asked, 2).collect()}
    assert hops == {1: 1, 2: 1}
