"""Nested writes: every verb on small catalogue tables, and what they refuse."""
import pytest
from pyspark.sql import Row

from quarry.catalog import Catalog
from quarry.model import CATALOGUE_MODELS, ModelSpec, Relation
from quarry.operators import mutate as M
from quarry.operators import nested
from quarry.sources import sinks

OWNER = "id int, name string"
PET = "id int, tag string, name string, owner int"
MODELS = {
    "owner": ModelSpec("owner", key=("id",), unique=(("name",),), required=("id", "name"), relations={"pets": Relation("pet", "many", ("id",), ("owner",))}),
    "pet": ModelSpec("pet", key=("id",), unique=(("tag",),), required=("id",), relations={"owner_row": Relation("owner", "one", ("owner",), ("id",))}),
}


@pytest.fixture
def pets(spark):
    return Catalog(spark, {"owner": spark.createDataFrame([(1, "ann"), (2, "bo")], OWNER),
                           "pet": spark.createDataFrame([(10, "a", "rex", 1), (11, "b", "tom", 1), (12, "c", "pip", None)], PET)}, MODELS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def owners_of(cat):
    return {r.id: r.owner for r in cat.df("pet").collect()}


def test_create_with_all_verbs_on_both_sides(spark, pets):
    data = spark.createDataFrame([
        (3, "cy", ([(20, "d", "new", None)], [(12,)], [((11,), ("never",)), ((21,), ("made",))])),
        (4, "di", (None, None, None)),
    ], f"id int, name string, pets struct<create: array<struct<{', '.join(f.replace(' ', ': ') for f in PET.split(', '))}>>, connect: array<struct<id: int>>, connect_or_create: array<struct<where: struct<id: int>, create: struct<name: string>>>>")
    done = pets.table("owner").write(data)
    assert done.touched[0] == "owner" and set(done.touched) == {"owner", "pet"}
    assert owners_of(done.catalog) == {10: 1, 11: 3, 12: 3, 20: 3, 21: 3}
    assert rows(done.catalog.df("pet").where("id in (20, 21)")) == [(20, "d", "new", 3), (21, None, "made", 3)]
    assert rows(done.affected) == [(3, "cy"), (4, "di")]


def test_to_one_by_another_unique_key_and_deep_rows(spark, pets):
    data = spark.createDataFrame([(30, ("bo",), None), (31, None, (5, "eve", [(32, "deep")]))],
                                 "id int, c struct<name: string>, n struct<id: int, name: string, pets: array<struct<id: int, name: string>>>")
    data = data.selectExpr("id", "struct(c AS connect, if(n is null, null, struct(n.id, n.name, struct(n.pets AS create) AS pets)) AS create) AS owner_row")
    done = pets.table("pet").create(data)
    assert owners_of(done.catalog) == {10: 1, 11: 1, 12: None, 30: 2, 31: 5, 32: 5}
    assert (5, "eve") in rows(done.catalog.df("owner"))


def test_update_verbs(spark, pets):
    key = "array<struct<id: int>>"
    data = spark.createDataFrame([(1, None, ([(11,), (12,)], None, None)), (2, "bob", (None, None, None)), (99, "absent", ([], None, None))],
                                 f"id int, name string, pets struct<set: {key}, disconnect: {key}, delete: {key}>")
    done = pets.table("owner").write(data, "update")
    assert owners_of(done.catalog) == {10: None, 11: 1, 12: 1}
    assert rows(done.catalog.df("owner")) == [(1, "ann"), (2, "bob")]
    # disconnect leaves rows of others alone; delete takes the row away
    data = spark.createDataFrame([(1, (None, [(10,), (12,)], [(11,)]))], f"id int, pets struct<set: {key}, disconnect: {key}, delete: {key}>")
    done = pets.table("owner").write(data, "update")
    assert owners_of(done.catalog) == {10: None, 12: None}
    # to-one: disconnect, delete, and a new owner
    data = spark.createDataFrame([(10, True, None, None), (12, None, None, (1,))], "id int, d boolean, x boolean, c struct<id: int>")
    data = data.selectExpr("id", "struct(d AS disconnect, x AS delete, c AS connect) AS owner_row")
    assert owners_of(pets.table("pet").write(data, "update").catalog) == {10: None, 11: 1, 12: 1}
    data = spark.createDataFrame([(10, True)], "id int, x boolean").selectExpr("id", "struct(x AS delete) AS owner_row")
    done = nested.update(pets, "pet", data, check=False)
    assert rows(done.catalog.df("owner")) == [(2, "bo")] and owners_of(done.catalog)[10] is None


def test_empty_set_and_upsert(spark, pets):
    data = spark.createDataFrame([(1, ([],))], "id int, pets struct<set: array<struct<id: int>>>")
    assert owners_of(pets.table("owner").write(data, "update").catalog) == {10: None, 11: None, 12: None}
    data = spark.createDataFrame([(1, ("x",), ("anna",)), (7, ("gus",), ("never",))], "id int, create struct<name: string>, update struct<name: string>")
    done = pets.table("owner").write(data, "upsert")
    assert rows(done.table) == [(1, "anna"), (2, "bo"), (7, "gus")] and rows(done.affected) == [(1, "anna"), (7, "gus")]


@pytest.mark.parametrize("data, schema, error", [
    ([(1, "again")], "id int, name string", M.UniqueViolation),
    ([(8, "x"), (8, "y")], "id int, name string", M.UniqueViolation),
    ([(8, None)], "id int, name string", M.RequiredViolation),
])
def test_refused_rows(spark, pets, data, schema, error):
    with pytest.raises(error):
        nested.create(pets, "owner", spark.createDataFrame(data, schema))


def test_refused_links(spark, pets):
    with pytest.raises(nested.RelatedNotFound):  # connects nothing
        pets.table("pet").create(spark.createDataFrame([(50, ((9,),))], "id int, owner_row struct<connect: struct<id: int>>"))
    with pytest.raises(nested.RelatedNotFound):  # a plain foreign key without a row
        nested.create(pets, "pet", spark.createDataFrame([(50, 9)], "id int, owner int"))
    with pytest.raises(nested.RelatedNotFound):  # deletes a row of another parent
        pets.table("owner").write(spark.createDataFrame([(2, ([(10,)],))], "id int, pets struct<delete: array<struct<id: int>>>"), "update")
    with pytest.raises(ValueError):  # no such verb when creating
        pets.table("owner").create(spark.createDataFrame([(9, "z", ([(10,)],))], "id int, name string, pets struct<set: array<struct<id: int>>>"))
    with pytest.raises(M.UniqueViolation):  # one row for two parents
        pets.table("owner").write(spark.createDataFrame([(1, ([(12,)],)), (2, ([(12,)],))], "id int, pets struct<connect: array<struct<id: int>>>"), "update")


def test_games_with_links_and_dimensions_published_together(spark, tmp_path):
    cat = Catalog.empty_catalogue(spark)
    genre = "struct<where: struct<id: int>, create: struct<id: int, name: string>>"
    data = spark.createDataFrame([(1, "One", [((5,), (5, "Action")), ((6,), (6, "Indie"))]), (2, "Two", [((5,), (5, "Action"))])], f"id int, name string, g array<{genre}>")
    data = data.selectExpr("id", "name", "struct(transform(g, x -> struct(struct(x AS connect_or_create) AS genre)) AS create) AS genres")
    done = cat.table("Game").create(data, include={"genres": True})
    assert {r.id: [g.genreId for g in r.genres] for r in done.affected.collect()} == {1: [5, 6], 2: [5]}
    sinks.publish(spark, str(tmp_path), done.tables())
    assert rows(sinks.read_table(spark, str(tmp_path), "Genre")) == [(5, "Action"), (6, "Indie")]
    assert rows(sinks.read_table(spark, str(tmp_path), "GameGenre")) == [(1, 5), (1, 6), (2, 5)]
    assert set(done.touched) == {"Game", "Genre", "GameGenre"} <= set(CATALOGUE_MODELS)
    # a link is disconnected by the other column of its key
    again = done.catalog.table("Game").write(spark.createDataFrame([(1, ([(6,)],))], "id int, genres struct<disconnect: array<struct<genreId: int>>>"), "update")
    assert rows(again.catalog.df("GameGenre")) == [(1, 5), (2, 5)]


def test_verbs_read_what_the_one_before_left_once(spark, pets):
    """The plan of the table grows with the number of verbs, not with the product of their reads."""
    key = "array<struct<id: int>>"
    data = spark.createDataFrame([(1, ([(11,), (12,)], None, None, None)), (2, (None, None, None, [(10,)]))],
                                 f"id int, pets struct<set: {key}, disconnect: {key}, delete: {key}, connect: {key}>")
    done = pets.table("owner").write(data, "update")
    assert owners_of(done.catalog) == {10: 2, 11: 1, 12: 1}
    assert done.catalog.df("pet")._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4
