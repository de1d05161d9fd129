"""ST1: the whole ingest as a stream.

Store, stats and page bodies land as files in any order.  Each micro-batch
moves a keyed state on and with it everything that the ingest job makes:

* ``store`` / ``stats``: the latest body of each id, parsed (its NULLs replace
  older values, as the job copies them);
* ``runs``: per id the last visited page, whether the run is closed, the cursors
  it used, the number of children and the first summary (``advance_runs``);
* ``pending``: raw pages that landed ahead of their run, at most as many per id
  as the run may still visit;
* ``entities`` and ``Game``: the merged records of the touched ids;
* ``Review``, the four link tables, ``Category`` and ``Genre``;
* ``Developer`` / ``Publisher``: counters, moved by new links alone.

A page that its run has passed is not read again when it lands once more.
Which ids a batch touches is told by bitmaps, and tables that grow meet by
sort-merge joins, so none passes through the driver.
Tables are kept in buckets of their keys; a batch reads and writes the touched
buckets only.  All of them, with the batch's number, become visible by one
manifest: a batch that is tried again after a lost driver finds its number
there and does nothing, so nothing counts twice.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CATALOGUE_MODELS
from ..operators import mutate as M
from ..operators import normalize as N
from ..plans import ingest_jobs as J
from ..session import checkpoint_dir
from ..sources import sinks
from ..sources.scan import landing_payloads
from .incremental import merge_by_seq

EPOCH, COUNT = "@epoch", "@buckets"
BODY = "id int, body string, landed bigint"
PAGE = "id int, page_no int, body string, landed bigint"
LINKS = {  # link table → list of the store record, its column, its dimension or counter table
    "GameDeveloper": ("developer_names", "developerName", "Developer"),
    "GamePublisher": ("publisher_names", "publisherName", "Publisher"),
    "GameCategory": ("categories", "categoryId", "Category"),
    "GameGenre": ("genres", "genreId", "Genre"),
}
ITEM_SEQ = "struct<seq: bigint, pos: int>"


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _nullable(kind: T.DataType) -> T.DataType:
    """The type as Parquet gives it back: everything may be NULL."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    return T.ArrayType(_nullable(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


class IngestStream:
    """``run()`` takes in everything that has landed since the last run; the tables are read by ``table``.

    ``landing`` has the folders ``store``, ``stats`` and ``pages`` (Parquet); ``ids`` is the id list
    (seq, appid), as ``ingest_jobs.select_ids`` gives it.  ``buckets`` is taken when the tables are made
    (a table's expected size over what a task should rewrite); later runs find it in the manifest.
    """

    def __init__(self, spark: SparkSession, landing: str, root: str, ids: DataFrame, buckets: int = 64,
                 run_ts: str | None = None, max_children: int = N.MAX_CHILDREN, max_files_per_trigger: int | None = None):
        self.spark, self.landing, self.root = spark, landing, root
        self.listed = ids.select(F.col("seq").cast("long").alias("seq"), F.col("appid").cast("int").alias("appid"))
        self.run_ts, self.cap, self.files = run_ts, max_children, max_files_per_trigger
        self.buckets = int(sinks.current_versions(spark, root).get(COUNT, buckets))
        checkpoint_dir(spark)

    # -- tables -------------------------------------------------------------------
    @cached_property
    def schemas(self) -> dict[str, T.StructType]:
        nothing = landing_payloads(self.spark.createDataFrame([], BODY)).select("id", "payload")
        store, stats = N.store_records(nothing), N.stats_records(nothing)
        summary = N.parse_pages(landing_payloads(self.spark.createDataFrame([], PAGE)).select("id", "page_no", "payload")).schema["summary"].dataType
        entities = J.merge_sources(self.listed, store, stats, store.selectExpr("id", *[f"CAST(NULL AS {J.ENTITY_TYPES[f]}) AS {f}" for f in N.SUMMARY_FIELDS]), "")

        def record(df: DataFrame) -> T.StructType:
            return _schema("id int, landed bigint").add("rec", T.StructType([f for f in df.schema.fields if f.name != "id"]))
        out = {"store": record(store), "stats": record(stats), "pending": _schema(PAGE), "entities": entities.schema,
               "runs": _schema("id int, last_page int, closed boolean, cursors array<string>, n_children int").add("summary", summary)}
        out |= {name: CATALOGUE_MODELS[name].schema for name in ("Game", *LINKS, "Developer", "Publisher")}
        out |= {name: T.StructType(list(CATALOGUE_MODELS[name].schema.fields)).add("__seq", _schema(f"s {ITEM_SEQ}")["s"].dataType) for name in ("Category", "Genre")}
        out["Review"] = T.StructType(list(CATALOGUE_MODELS["Review"].schema.fields)).add("__seq", _schema("s struct<seq: bigint, rank: int>")["s"].dataType)
        return {name: _nullable(schema) for name, schema in out.items()}

    def table(self, name: str) -> DataFrame:
        """A table's current rows, without the stream's own columns."""
        return sinks.read_buckets(self.spark, self.root, name, self.schemas[name]).drop("__seq")

    def entities(self) -> DataFrame:
        return self.table("entities").drop("seq")

    def _bucket(self, *key: str):
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame, *key: str) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket(*key)).distinct().collect())  # at most the number of buckets

    def _old(self, name: str, buckets: list[int]) -> DataFrame:
        return sinks.read_buckets(self.spark, self.root, name, self.schemas[name], buckets, self.versions).hint("merge")

    # -- one batch ------------------------------------------------------------------
    def run(self) -> None:
        # the list is read once a run; every batch joins it
        self.ids = self.listed.repartition("appid").checkpoint()
        self.wanted = J.id_bitmaps(self.ids, "appid").checkpoint()
        self._advance(self._unseen_ids(), None)
        bodies = [self._stream("store", BODY), self._stream("stats", BODY), self._stream("pages", PAGE)]
        q = (bodies[0].unionByName(bodies[1]).unionByName(bodies[2]).writeStream.foreachBatch(lambda batch, epoch: self._batch(batch, epoch))
             .option("checkpointLocation", f"{self.root}/_stream").trigger(availableNow=True).start())
        q.awaitTermination()

    def _stream(self, source: str, schema: str) -> DataFrame:
        reader = self.spark.readStream.schema(schema).format("parquet")
        if self.files:
            reader = reader.option("maxFilesPerTrigger", self.files)
        df = reader.load(f"{self.landing}/{source}")
        page = F.col("page_no") if source == "pages" else F.lit(None).cast("int").alias("page_no")
        return df.select(F.lit(source).alias("source"), "id", page, "body", "landed")

    def _unseen_ids(self) -> DataFrame | None:
        """Ids of the list without an entity: they get one, even if nothing of them ever lands."""
        known = sinks.read_buckets(self.spark, self.root, "entities", self.schemas["entities"])
        new = self.ids.join(known.select(F.col("seq").alias("__s")).hint("merge"), F.col("seq") == F.col("__s"), "left_anti")
        return None if new.isEmpty() else new.select(F.col("appid").alias("id")).distinct()

    def _batch(self, batch: DataFrame, epoch: int) -> None:
        if int(sinks.current_versions(self.spark, self.root).get(EPOCH, -1)) >= epoch:
            return
        batch = J.with_ids(batch, "id", self.wanted).checkpoint()
        self._advance(batch.select("id").distinct(), batch, {EPOCH: str(epoch)})

    def _advance(self, touched: DataFrame | None, batch: DataFrame | None, notes: dict[str, str] | None = None) -> None:
        if touched is None:
            return
        self.versions = sinks.current_versions(self.spark, self.root)
        touched = touched.checkpoint()
        here = self._touched(touched, "id")
        touched = J.id_bitmaps(touched, "id").checkpoint()
        parts: dict[str, tuple[DataFrame, list[int]]] = {}

        def put(name: str, df: DataFrame, buckets: list[int], *key: str) -> None:
            if buckets:
                parts[name] = (df.withColumn("__b", self._bucket(*key)).hint("rebalance", F.col("__b")), buckets)

        store, stats, runs = (self._old(n, here) for n in ("store", "stats", "runs"))
        if batch is not None and here:
            fresh = self._parsed(batch, "store", N.store_records).checkpoint()
            store = self._latest(store, fresh).checkpoint()
            put("store", store, here, "id")
            stats = self._latest(stats, self._parsed(batch, "stats", N.stats_records)).checkpoint()
            put("stats", stats, here, "id")
            runs, children = self._pages(batch, touched, runs, here, put)
            self._links(fresh, here, put)
            self._children(children, put)
        self._entities(touched, store, stats, runs, here, put)
        sinks.publish_parts(self.spark, self.root, parts, (notes or {}) | {COUNT: str(self.buckets)})

    def _parsed(self, batch: DataFrame, source: str, records) -> DataFrame:
        """(id, landed, rec): the batch's latest body of each id; rec is NULL when the body gives no record."""
        bodies = M.last_per_key(batch.where(F.col("source") == source).select("id", "body", "landed", F.col("landed").alias("__l")), ("id",), "__l")
        rec = records(landing_payloads(bodies.select("id", "body")))
        rec = rec.select("id", F.struct(*[c for c in rec.columns if c != "id"]).cast(self.schemas[source]["rec"].dataType).alias("rec"))
        return bodies.select("id", "landed").join(rec.hint("merge"), "id", "left")

    def _latest(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """The later body of each id, with its NULLs."""
        both = old.select("id", "landed", "rec").unionByName(new.select("id", "landed", "rec"))
        return M.last_per_key(both.withColumn("__l", F.col("landed")), ("id",), "__l")

    def _pages(self, batch: DataFrame, touched: DataFrame, runs: DataFrame, here: list[int], put) -> tuple[DataFrame, DataFrame]:
        pending = self._old("pending", here)
        mine = J.with_ids(pending, "id", touched).unionByName(batch.where("source = 'pages'").select(*pending.columns))
        mine = M.last_per_key(mine.withColumn("__l", F.col("landed")), ("id", "page_no"), "__l")
        mine = mine.join(runs.select("id", "last_page", "closed", "n_children").hint("merge"), "id", "left").where(N.reachable(self.cap)).select(*pending.columns)
        base = N.parse_pages(landing_payloads(mine).select("id", "page_no", "payload")).checkpoint()
        moved, children = N.advance_runs(runs, base, self.cap)
        moved = moved.checkpoint()
        runs = runs.join(moved.hint("merge"), "id", "left_anti").unionByName(moved.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas["runs"].fields])).checkpoint()
        put("runs", runs, here, "id")
        waiting = mine.join(runs.select("id", "last_page", "closed", "n_children").hint("merge"), "id", "left").where(N.reachable(self.cap)).select(*pending.columns)
        put("pending", J.with_ids(pending, "id", touched, keep=False).unionByName(waiting), here, "id")
        return runs, children.checkpoint()

    def _children(self, children: DataFrame, put) -> None:
        spec = CATALOGUE_MODELS["Review"]
        rows = children.join(self.ids.select(F.col("appid").alias("gameId"), "seq").hint("merge"), "gameId")
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields], F.struct("seq", "rank").alias("__seq"))
        buckets = self._touched(rows, "id")
        put("Review", merge_by_seq(self._old("Review", buckets), rows, ("id",), "__seq"), buckets, "id")

    def _links(self, fresh: DataFrame, here: list[int], put) -> None:
        """Links of newly landed store records; counters move by the links that are new."""
        lists = [f"rec.{column}" for column, _, _ in LINKS.values()]
        listed = fresh.where("rec IS NOT NULL").select("id", *lists).join(self.ids.select(F.col("appid").alias("id"), "seq").hint("merge"), "id").checkpoint()
        for link, (column, name, table) in LINKS.items():
            old = self._old(link, here)
            if table in ("Developer", "Publisher"):
                pairs = N.name_links(listed, column, name).select(F.col("gameId").cast("int").alias("gameId"), name).checkpoint()
                buckets = self._touched(pairs, name)
                links, counters = M.maintain_counted_links(old, self._old(table, buckets), pairs, "gameId", name)
                put(table, counters.table, buckets, "name")
            else:
                items = N.item_links(listed, column, seq="seq").select(
                    F.col("gameId").cast("int").alias("gameId"), F.col("id").try_cast("int").alias("id"), "name", F.struct("seq", "pos").cast(ITEM_SEQ).alias("__seq"))
                items = items.where("id IS NOT NULL").checkpoint()
                buckets = self._touched(items, "id")
                named = M.dimension_names(items)
                put(table, merge_by_seq(self._old(table, buckets), named.select("id", "name", "__seq"), ("id",), "__seq"), buckets, "id")
                links = M.connect(old, items.select("gameId", F.col("id").alias(name)), ("gameId", name))
            put(link, links.table.select(*old.columns), here, "gameId")

    def _entities(self, touched: DataFrame, store: DataFrame, stats: DataFrame, runs: DataFrame, here: list[int], put) -> None:
        ids = J.with_ids(self.ids, "appid", touched)
        made = J.merge_sources(ids, *[s.where("rec IS NOT NULL").select("id", "rec.*").hint("merge") for s in (store, stats)],
                               runs.where("summary IS NOT NULL").select("id", "summary.*").hint("merge"), self.run_ts).checkpoint()
        old = self._old("entities", here)
        put("entities", J.with_ids(old, "id", touched, keep=False).unionByName(made.select(*old.columns)), here, "id")
        spec = CATALOGUE_MODELS["Game"]
        put("Game", M.upsert(self._old("Game", here), made.select("seq", *[f.name for f in spec.schema.fields]), spec, seq="seq", check=False).table, here, "id")
