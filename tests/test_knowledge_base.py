"""Building, resuming, asking and deleting a knowledge base; streams that keep tables up to date."""

import pytest
from pyspark.sql import functions as F

from siftstone.catalog import Catalog
from siftstone.models import KeywordEmbedder, RuleModel
from siftstone.recipe import KnowledgeBase, Parts, Recipe, basic_recipe, graph_recipe, split_step
from siftstone.streaming import events

REPLY = '{"entities": [{"name": "Fox", "type": "animal"}, {"name": "Dog", "type": "animal"}], "relations": [{"source": "Fox", "target": "Dog", "type": "jumps over"}]}'


@pytest.fixture
def objects(tmp_path):
    root = tmp_path / "objects"
    root.mkdir()
    (root / "a.txt").write_text("The quick fox jumps. " * 5)
    (root / "b.md").write_text("A lazy dog sleeps.")
    (root / "c.html").write_text("<title>C</title><p>Cats climb trees.</p>")
    (root / "d.csv").write_text("name,legs\nspider,8\n")
    (root / "e.bin").write_bytes(b"\0\1")
    return str(root)


def test_build_ask_delete(spark, tmp_path, objects):
    kb = KnowledgeBase(spark, f"{tmp_path}/kb", graph_recipe(40, 5), Parts(objects, KeywordEmbedder(("fox", "dog", "cats")), RuleModel(lambda p: REPLY)))
    assert all(s["state"] == "done" for s in kb.build().values())
    assert [r["key"] for r in kb.catalog.read("skipped").collect()] == ["e.bin"]
    assert kb.catalog.read("pages").count() == 4 and kb.catalog.read("nodes").count() == 2 and kb.catalog.read("edges").count() == 1
    asked = spark.createDataFrame([("q1", "lazy dog"), ("q2", "Cats climb")], "query_id string, text string")
    for mode in ("full_text_search", "vector_search", "hybrid_search", "sql_text_search"):
        best = {r["query_id"]: r["text"] for r in kb.query(asked, mode, 3).where("rank = 1").collect()}
        assert "dog" in best["q1"] and "Cats" in best["q2"], mode
    before = kb.manifest()
    assert kb.build() == before["steps"], "a finished build does nothing"
    assert len(kb.delete_plan()) == len(before["tables"]) + 1 and kb.delete() == [] and kb.catalog.tables() == {}


def test_recipe_problems(objects):
    assert Recipe([split_step()]).problems(Parts(objects)) == ["split needs the table pages, which no step before it gives"]
    assert "embed needs embedder" in basic_recipe().problems(Parts(objects))


def test_resume(spark, tmp_path, objects):
    calls = []

    def answer(prompt):
        return REPLY

    kb = KnowledgeBase(spark, f"{tmp_path}/kb", basic_recipe(), Parts(objects, KeywordEmbedder(("x",))))
    good = kb.recipe.steps[1]
    kb.recipe.steps[1] = type(good)(good.name, good.needs, good.gives, lambda *a: (_ for _ in ()).throw(RuntimeError("down")))
    with pytest.raises(RuntimeError):
        kb.build()
    assert kb.manifest()["steps"]["split"]["state"] == "failed"
    kb.recipe.steps[1] = good
    assert kb.build()["split"]["state"] == "done" and not calls and answer("")


def test_catalog_upsert(spark, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/c")
    catalog.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), ["id"])
    catalog.upsert("t", spark.createDataFrame([(2, "c")], "id int, v string"), ["id"])
    assert {tuple(r) for r in catalog.read("t").collect()} == {(1, "a"), (2, "c")}
    catalog.remove("t", spark.createDataFrame([(1,)], "id int"), ["id"])
    assert catalog.read("t").count() == 1
    with pytest.raises(ValueError):
        catalog.write("no/such", catalog.read("t"))


def test_stream_as_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i, part in enumerate(rows.randomSplit([0.5, 0.5], 1)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    catalog = Catalog(spark, f"{tmp_path}/kb")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        events.keep_up(stream, catalog, f"{tmp_path}/at", {"latest": (lambda b: b.select("event_id", "user_id", "value"), ["event_id"])}).awaitTermination()
    assert catalog.read("latest").count() == rows.select("event_id").distinct().count()
    query = events.tumbling(stream, 60, "400 days").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in events.tumbling(rows).withColumn("total", F.round("total", 4)).collect()}
    assert {tuple(r) for r in spark.table("tumbled").withColumn("total", F.round("total", 4)).collect()} == want
