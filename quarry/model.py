"""Model descriptions: one small spec per table instead of generated classes.

A ``ModelSpec`` names the table, its key, its column defaults, its required
columns and its relations.  Every operation of ``quarry.operators`` is written
once against a spec, so the ten catalogue tables (and the driver's fixture
tables used in checks) share one implementation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Relation:
    target: str                  # target model name
    kind: str                    # "one" (to-one) or "many" (to-many)
    fields: tuple[str, ...]      # columns on this model
    references: tuple[str, ...]  # matching columns on the target model


@dataclass
class ModelSpec:
    name: str
    schema: T.StructType | None = None      # None: take the table's own schema
    key: tuple[str, ...] = ()               # primary key; () = no unique key
    unique: tuple[tuple[str, ...], ...] = ()  # further unique keys
    defaults: dict = field(default_factory=dict)
    required: tuple[str, ...] = ()
    relations: dict[str, Relation] = field(default_factory=dict)

    def unique_keys(self) -> list[tuple[str, ...]]:
        keys = [self.key] if self.key else []
        return keys + [tuple(u) for u in self.unique]

    def columns(self, df=None) -> list[str]:
        if self.schema is not None:
            return [f.name for f in self.schema.fields]
        return list(df.columns) if df is not None else []

    def tiebreak(self, df) -> list[str]:
        """Columns that make an order total: the key, else every column."""
        return list(self.key) if self.key else self.columns(df)


def compound_key_name(cols: tuple[str, ...]) -> str:
    """Name of a compound unique key as the reference's where-dict uses it."""
    return "_".join(cols)


# ---------------------------------------------------------------------------
# The ten catalogue tables.
# ---------------------------------------------------------------------------

_I, _S, _B, _D, _TS = T.IntegerType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType()


def _struct(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


# Table and column names of the catalogue data model (they must
# equal the source format's names for the tables and CSVs to line up).
GAME_SCHEMA = _struct(
    ("id", _I, False), ("name", _S, False), ("required_age", _I, False), ("is_free", _B, False),
    ("detailed_description", _S, True), ("about_the_game", _S, True), ("short_description", _S, True),
    ("supported_languages", _S, True), ("header_image", _S, True), ("developers", _S, True),
    ("publishers", _S, True), ("windows", _B, False), ("mac", _B, False), ("linux", _B, False),
    ("metacritic", _I, True), ("release_date", _TS, True), ("coming_soon", _B, False),
    ("owners_min", _I, False), ("owners_max", _I, False), ("average_2weeks", _I, False),
    ("average_forever", _I, False), ("reviewNumReviews", _I, True), ("reviewScore", _I, True),
    ("reviewScoreDesc", _S, True), ("reviewTotalPositive", _I, True), ("reviewTotalNegative", _I, True),
    ("reviewTotalReviews", _I, True),
)

REVIEW_SCHEMA = _struct(
    ("id", _S, False), ("gameId", _I, False), ("authorSteamId", _S, True),
    ("authorPlaytimeForever", _I, False), ("authorPlaytimeAtReview", _I, False),
    ("authorLastPlayed", _TS, True), ("language", _S, True), ("review", _S, True),
    ("votedUp", _B, False), ("votesUp", _I, False), ("votesFunny", _I, False),
    ("weightedVoteScore", _D, True), ("writtenDuringEarlyAccess", _B, False),
    ("timestampCreated", _TS, True), ("timestampUpdated", _TS, True),
)

CATALOGUE_MODELS: dict[str, ModelSpec] = {
    "Game": ModelSpec(
        "Game", GAME_SCHEMA, key=("id",),
        defaults={"required_age": 0, "is_free": False, "windows": False, "mac": False, "linux": False,
                  "coming_soon": False, "owners_min": 0, "owners_max": 0, "average_2weeks": 0,
                  "average_forever": 0},
        required=("id", "name"),
        relations={
            "categories": Relation("GameCategory", "many", ("id",), ("gameId",)),
            "genres": Relation("GameGenre", "many", ("id",), ("gameId",)),
            "developers_rel": Relation("GameDeveloper", "many", ("id",), ("gameId",)),
            "publishers_rel": Relation("GamePublisher", "many", ("id",), ("gameId",)),
            "reviews": Relation("Review", "many", ("id",), ("gameId",)),
        }),
    "Category": ModelSpec("Category", _struct(("id", _I, False), ("name", _S, False)), key=("id",),
                          required=("id", "name"),
                          relations={"games": Relation("GameCategory", "many", ("id",), ("categoryId",))}),
    "Genre": ModelSpec("Genre", _struct(("id", _I, False), ("name", _S, False)), key=("id",),
                       required=("id", "name"),
                       relations={"games": Relation("GameGenre", "many", ("id",), ("genreId",))}),
    "GameCategory": ModelSpec(
        "GameCategory", _struct(("gameId", _I, False), ("categoryId", _I, False)), key=("gameId", "categoryId"),
        required=("gameId", "categoryId"),
        relations={"game": Relation("Game", "one", ("gameId",), ("id",)),
                   "category": Relation("Category", "one", ("categoryId",), ("id",))}),
    "GameGenre": ModelSpec(
        "GameGenre", _struct(("gameId", _I, False), ("genreId", _I, False)), key=("gameId", "genreId"),
        required=("gameId", "genreId"),
        relations={"game": Relation("Game", "one", ("gameId",), ("id",)),
                   "genre": Relation("Genre", "one", ("genreId",), ("id",))}),
    "Developer": ModelSpec("Developer", _struct(("name", _S, False), ("amount_games_published", _I, False)),
                           key=("name",), defaults={"amount_games_published": 0}, required=("name",),
                           relations={"games": Relation("GameDeveloper", "many", ("name",), ("developerName",))}),
    "Publisher": ModelSpec("Publisher", _struct(("name", _S, False), ("amount_games_published", _I, False)),
                           key=("name",), defaults={"amount_games_published": 0}, required=("name",),
                           relations={"games": Relation("GamePublisher", "many", ("name",), ("publisherName",))}),
    "GameDeveloper": ModelSpec(
        "GameDeveloper", _struct(("gameId", _I, False), ("developerName", _S, False)),
        key=("gameId", "developerName"), required=("gameId", "developerName"),
        relations={"game": Relation("Game", "one", ("gameId",), ("id",)),
                   "developer": Relation("Developer", "one", ("developerName",), ("name",))}),
    "GamePublisher": ModelSpec(
        "GamePublisher", _struct(("gameId", _I, False), ("publisherName", _S, False)),
        key=("gameId", "publisherName"), required=("gameId", "publisherName"),
        relations={"game": Relation("Game", "one", ("gameId",), ("id",)),
                   "publisher": Relation("Publisher", "one", ("publisherName",), ("name",))}),
    "Review": ModelSpec(
        "Review", REVIEW_SCHEMA, key=("id",),
        defaults={"authorPlaytimeForever": 0, "authorPlaytimeAtReview": 0, "votedUp": False, "votesUp": 0,
                  "votesFunny": 0, "writtenDuringEarlyAccess": False},
        required=("id", "gameId"),
        relations={"game": Relation("Game", "one", ("gameId",), ("id",))}),
}


# ---------------------------------------------------------------------------
# The driver's tables, described the same way so every operator can be
# checked on them.  ``part_supplier`` is the link table
# ``distinct(l_partkey, l_suppkey)`` derived from ``lineitem``.
# ---------------------------------------------------------------------------

FIXTURE_MODELS: dict[str, ModelSpec] = {
    "region": ModelSpec("region", key=("r_regionkey",),
                        relations={"nations": Relation("nation", "many", ("r_regionkey",), ("n_regionkey",))}),
    "nation": ModelSpec("nation", key=("n_nationkey",),
                        relations={"region": Relation("region", "one", ("n_regionkey",), ("r_regionkey",)),
                                   "customers": Relation("customer", "many", ("n_nationkey",), ("c_nationkey",))}),
    "customer": ModelSpec("customer", key=("c_custkey",), required=("c_custkey", "c_name"),
                          relations={"nation": Relation("nation", "one", ("c_nationkey",), ("n_nationkey",)),
                                     "orders": Relation("orders", "many", ("c_custkey",), ("o_custkey",))}),
    "supplier": ModelSpec("supplier", key=("s_suppkey",), defaults={"s_acctbal": 0.0},
                          relations={"nation": Relation("nation", "one", ("s_nationkey",), ("n_nationkey",)),
                                     "parts": Relation("part_supplier", "many", ("s_suppkey",), ("l_suppkey",)),
                                     "lineitems": Relation("lineitem", "many", ("s_suppkey",), ("l_suppkey",))}),
    "part": ModelSpec("part", key=("p_partkey",), required=("p_partkey", "p_name"),
                      defaults={"p_size": 0},
                      relations={"lineitems": Relation("lineitem", "many", ("p_partkey",), ("l_partkey",)),
                                 "suppliers": Relation("part_supplier", "many", ("p_partkey",), ("l_partkey",))}),
    "part_supplier": ModelSpec("part_supplier", key=("l_partkey", "l_suppkey"),
                               relations={"part": Relation("part", "one", ("l_partkey",), ("p_partkey",)),
                                          "supplier": Relation("supplier", "one", ("l_suppkey",), ("s_suppkey",))}),
    "orders": ModelSpec("orders", key=("o_orderkey",),
                        relations={"customer": Relation("customer", "one", ("o_custkey",), ("c_custkey",)),
                                   "lineitems": Relation("lineitem", "many", ("o_orderkey",), ("l_orderkey",))}),
    "lineitem": ModelSpec("lineitem", key=(),
                          relations={"order": Relation("orders", "one", ("l_orderkey",), ("o_orderkey",)),
                                     "part": Relation("part", "one", ("l_partkey",), ("p_partkey",)),
                                     "supplier": Relation("supplier", "one", ("l_suppkey",), ("s_suppkey",))}),
    "events": ModelSpec("events", key=("event_id",)),
    "documents": ModelSpec("documents", key=("doc_id",), required=("doc_id", "text"),
                           relations={"label": Relation("labels", "one", ("doc_id",), ("doc_id",))}),
    "labels": ModelSpec("labels", key=("doc_id",), required=("doc_id", "quality", "toxic"),
                        relations={"document": Relation("documents", "one", ("doc_id",), ("doc_id",))}),
    "pages": ModelSpec("pages", key=("page_id",)),
    "conversations": ModelSpec("conversations", key=("conv_id", "turn")),
    "embeddings": ModelSpec("embeddings", key=("vec_id",)),
    "benchmark": ModelSpec("benchmark", key=("item_id",)),
}

FIXTURE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                  "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
