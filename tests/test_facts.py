"""Facts: what their queries' SQL doesn't show."""

import pytest

from siftstone.operators import facts, merge
from siftstone.sources import html


def test_delimiter_records(spark):
    reply = '("entity"<|>"Otto"<|>person<|>a "miller")##(relationship<|>Otto<|>mill<|>runs it<|>2.5)##(relationship<|>Otto<|>OTTO<|>x<|>y)##(relationship<|>mill<|>river<|>stands by<|>often)##(entity<|>short)##nonsense<|COMPLETE|>'
    rows = spark.createDataFrame([(1, reply), (2, None), (3, "")], "id int, reply string")
    entities, relations, trace = facts.delimiter_records(rows, ["id"])
    assert [tuple(r) for r in entities.collect()] == [(1, 0, "OTTO", "PERSON", 'a "miller')]
    assert sorted(tuple(r)[2:] for r in relations.collect()) == [("MILL", "RIVER", "stands by", 1.0), ("OTTO", "MILL", "runs it", 2.5)]
    assert sorted(r["nth"] for r in trace.collect()) == [2, 4, 5]


def test_pairs(spark):
    rows = spark.createDataFrame([('- red || "blue"\nfoo || bar\n["x y", "z"] (one, two)',), ("none",)], "t string")
    got = [[tuple(p) for p in r["p"]] for r in rows.select(facts.pairs(rows["t"]).alias("p")).collect()]
    assert set(got[0]) >= {("red", "blue"), ("foo", "bar"), ("x y", "z"), ("one", "two")} and got[1] == []


def test_aligned(spark):
    chunks = spark.createDataFrame([("c1", "d"), ("c2", "d")], "chunk_id string, document_id string")
    vectors = [("c1", "d", [1.0]), ("c2", "d", [2.0])]
    schema = "chunk_id string, document_id string, vector array<double>"
    assert facts.aligned(chunks, spark.createDataFrame(vectors, schema)).count() == 2
    for bad in (vectors[:1], [*vectors, vectors[0]], [vectors[0], ("c2", "e", [2.0])]):
        with pytest.raises(ValueError, match="match"):
            facts.aligned(chunks, spark.createDataFrame(bad, schema))


def test_retarget_keeps_the_first(spark):
    mapped = spark.createDataFrame([("a", "m"), ("b", "m")], "member string, merged_id string")
    rows = spark.createDataFrame([("a", "c1", 2), ("b", "c1", 1), ("b", "c2", 3)], "fact_id string, chunk_id string, seen int")
    out = merge.retarget_evidence(rows, mapped, ["fact_id", "chunk_id"], order=["seen"])
    assert sorted(map(tuple, out.select("fact_id", "chunk_id", "seen").collect())) == [("m", "c1", 1), ("m", "c2", 3)]


def test_deep_page(spark):
    deep = "<html><body><main>" + "<div>" * 5000 + "ground " * 60 + "</div>" * 5000 + "</main></body></html>"
    pages = spark.createDataFrame([(1, deep)], "page_id int, html string")
    assert html.extract_pages(pages, ["page_id"]).first()["text"].startswith("ground")
