"""The inverted index gives the scan's rows, reads no text, and prunes by token."""
import pytest

from quarry.catalog import Catalog
from quarry.model import ModelSpec
from quarry.sources import text_index
from quarry.sources.text_index import TextIndex

TEXTS = ["red Bolt", "bolt, bolt; nut", None, "", "--", "RED nut bolt", "blue", "Über-nut 42"]


@pytest.fixture
def index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "RANGE", 3)
    docs = spark.createDataFrame([(i * 2 - 4, t) for i, t in enumerate(TEXTS)] + [(None, "red bolt")], "id long, text string")
    ix = TextIndex(spark, str(tmp_path))
    ix.add(docs.where("id < 5 OR id IS NULL"), "id", "text")
    ix.add(docs.where("id >= 5"), "id", "text")
    return docs, ix


@pytest.mark.parametrize("query", ["bolt", "RED bolt", "nut bolt red", "42", "über", "absent", "red absent"])
def test_equals_the_scan(spark, index, query):
    docs, ix = index
    cat = Catalog(spark, {"d": docs}, {"d": ModelSpec("d", key=("id",))})
    want = sorted(r.id for r in cat.table("d").find_many(where={"text": {"search": query}}).where("id IS NOT NULL").collect())
    assert sorted(r.id for r in ix.search(query).collect()) == want
    assert sorted(r.id for r in cat.table("d").search(ix, query).collect()) == want


def test_scores_and_plan(spark, index):
    docs, ix = index
    assert {r.id: r.score for r in ix.scores("red bolt").collect()} == {-4: 2, -2: 1, 6: 2}
    plan = ix.search("red bolt")._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [bolt,red])" in plan.replace("  ", " ") and "text" not in plan.split("Location")[0]
    with pytest.raises(ValueError):
        ix.search(" - ")
    with pytest.raises(KeyError):
        TextIndex(spark, ix.root + "/none").search("x")
