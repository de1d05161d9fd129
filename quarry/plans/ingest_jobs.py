"""Id-set jobs of the ingest run: resume difference, offset / limit over file
order, key-set unions, sorted unique ids (J8, L10, O2, O3, G9)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def processed_keys(key_sets: Iterable[DataFrame], column: str = "id") -> DataFrame:
    """O2: union of processed-key sets (each a one-column DataFrame)."""
    sets = [s.select(F.col(s.columns[0]).alias(column)) for s in key_sets]
    return reduce(DataFrame.union, sets).distinct()


def resume_difference(ids: DataFrame, id_col: str, processed: Iterable[DataFrame]) -> DataFrame:
    """Drop ids already processed; order and duplicates of the rest kept
    (a left-anti join, unlike ``EXCEPT``).  Catalyst broadcasts the processed
    set when its measured size allows, else it sort-merges."""
    done = processed_keys(processed, "__done")
    return ids.join(done, ids[id_col] == done["__done"], "left_anti")


#: Bitmaps of 4 KB, each for 32,768 neighbouring ids, that may be broadcast (64 MB).
BROADCAST_BITMAPS = 16_384


def id_bitmaps(ids: DataFrame, column: str) -> DataFrame:
    """An exact set of whole-number ids as bitmaps: (bucket, bits).  One row holds 32,768 neighbouring numbers."""
    number, place = F.bitmap_bucket_number(column), F.bitmap_bit_position(column)
    return ids.where(F.col(column).isNotNull()).select(number.alias("bucket"), place.alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def with_ids(df: DataFrame, column: str, bitmaps: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose id is in the set (or, without ``keep``, is not), by a join on the bitmap's number.

    The bitmaps are broadcast when counted below ``BROADCAST_BITMAPS``; then
    ``df``, which may hold large bodies, is filtered where it is read, without a
    shuffle.  Beyond that the join is left to Spark."""
    small = bitmaps.limit(BROADCAST_BITMAPS + 1).count() <= BROADCAST_BITMAPS
    sets = bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    place = F.bitmap_bit_position(column)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    joined = df.join(F.broadcast(sets) if small else sets, F.bitmap_bucket_number(column) == F.col("__bucket"), "inner" if keep else "left")
    return joined.where(inside if keep else ~inside).drop("__bucket", "__bits")


def offset_limit(ids: DataFrame, seq: str = "seq", offset: int = 0, limit: int | None = None) -> DataFrame:
    """Skip the first ``offset`` rows of file order, then keep ``limit``."""
    if not offset and limit is None:
        return ids
    from ..operators.read import slice_rows
    return slice_rows(ids, [F.col(seq)], offset, limit)


def distinct_sorted_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct ids in ascending order (range-partitioned sort; partial
    aggregation removes duplicates before the shuffle)."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


# ---------------------------------------------------------------------------
# The full ingest job as one lineage
# ---------------------------------------------------------------------------

from functools import cached_property, partial  # noqa: E402

from pyspark.sql import Column  # noqa: E402

from ..catalog import Catalog  # noqa: E402
from ..functions import clean as C  # noqa: E402
from ..functions.clean import ident, q  # noqa: E402
from ..model import CATALOGUE_MODELS  # noqa: E402
from ..operators import mutate as M  # noqa: E402
from ..operators import normalize as N  # noqa: E402
from ..sources.scan import landing_payloads  # noqa: E402

# The entity CSV columns, in the source format's order.
ENTITY_CSV_COLUMNS = (
    "id", "name", "required_age", "is_free", "detailed_description", "about_the_game", "short_description",
    "supported_languages", "header_image", "developers", "publishers", "windows", "mac", "linux", "metacritic",
    "release_date", "coming_soon", "owners_min", "owners_max", "average_2weeks", "average_forever",
    "median_forever", "median_2weeks", "ccu", "reviewNumReviews", "reviewScore", "reviewScoreDesc",
    "reviewTotalPositive", "reviewTotalNegative", "reviewTotalReviews", "store_status", "steamspy_status",
    "reviews_status", "last_updated")

# The base record every id starts from before sources overlay it.
BASE_RECORD = {
    "name": "", "required_age": 0, "is_free": False, "detailed_description": "", "about_the_game": "",
    "short_description": "", "supported_languages": "", "header_image": "", "developers": "", "publishers": "",
    "windows": False, "mac": False, "linux": False, "metacritic": None, "release_date": None,
    "coming_soon": False, "owners_min": 0, "owners_max": 0, "average_2weeks": 0, "average_forever": 0,
    "median_forever": 0, "median_2weeks": 0, "ccu": 0, "reviewNumReviews": None, "reviewScore": None,
    "reviewScoreDesc": None, "reviewTotalPositive": None, "reviewTotalNegative": None, "reviewTotalReviews": None,
}
ENTITY_TYPES = {
    "id": "int", "name": "string", "required_age": "int", "is_free": "boolean", "detailed_description": "string",
    "about_the_game": "string", "short_description": "string", "supported_languages": "string",
    "header_image": "string", "developers": "string", "publishers": "string", "windows": "boolean",
    "mac": "boolean", "linux": "boolean", "metacritic": "int", "release_date": "timestamp_ntz",
    "coming_soon": "boolean", "owners_min": "int", "owners_max": "int", "average_2weeks": "int",
    "average_forever": "int", "median_forever": "int", "median_2weeks": "int", "ccu": "int",
    "reviewNumReviews": "int", "reviewScore": "int", "reviewScoreDesc": "string", "reviewTotalPositive": "int",
    "reviewTotalNegative": "int", "reviewTotalReviews": "int",
}


class IngestRun:
    """One run of the job.  Every part is planned when it is first asked for.

    * ``ids``: (seq, appid) processed, ``seq`` giving the file order;
    * ``oversized``: listed ids that fit no 32-bit key; nothing is made of them;
    * ``entities``: the 34-column merged records (one per processed id occurrence);
    * ``reviews``: the 15-column child rows (+ seq, rank);
    * ``store``: normalised store rows, with link lists;
    * ``catalog``: catalogue tables after upserts and link upkeep, or None.
    """

    def __init__(self, ids: DataFrame, some: bool, bodies: tuple[DataFrame, DataFrame, DataFrame],
                 catalog: Catalog | None, run_ts: str | None, max_children: int, checkpoint: bool):
        fits = F.col("appid").between(-(2 ** 31), 2 ** 31 - 1)
        self._ids, self.oversized = ids.where(fits).withColumn("appid", F.col("appid").cast("int")), ids.where(~fits)
        self._some, self._bodies = some, bodies
        self._base, self._run_ts, self._cap, self._checkpoint = catalog, run_ts, max_children, checkpoint

    def _kept(self, df: DataFrame, when: bool = True) -> DataFrame:
        if not (self._checkpoint and when):
            return df
        from ..session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        return df.checkpoint()

    @cached_property
    def ids(self) -> DataFrame:
        # every part joins the list
        return self._kept(self._ids.repartition("appid") if self._checkpoint else self._ids)

    @cached_property
    def _wanted(self) -> DataFrame | None:
        """The ids of a run over some of them, as bitmaps, made once."""
        if not self._some:
            return None
        from ..session import checkpoint_dir
        checkpoint_dir(self.ids.sparkSession)
        return id_bitmaps(self.ids, "appid").checkpoint()

    @cached_property
    def store(self) -> DataFrame:
        return self._kept(N.store_records(_only(self._bodies[0], self._wanted)))

    @cached_property
    def stats(self) -> DataFrame:
        return self._kept(N.stats_records(_only(self._bodies[1], self._wanted)))

    @cached_property
    def _pages(self) -> tuple[DataFrame, DataFrame]:
        pages = _only(self._bodies[2], self._wanted).select("id", "page_no", "payload")
        return N.page_run(pages, cap=self._cap, parsed=self._kept)

    @cached_property
    def merged(self) -> DataFrame:
        # with a catalogue the table is made of it besides the file
        return self._kept(merge_sources(self.ids, self.store, self.stats, self._pages[0], self._run_ts), self._base is not None)

    @property
    def entities(self) -> DataFrame:
        return self.merged.drop("seq")

    @cached_property
    def reviews(self) -> DataFrame:
        # each occurrence of an id in the list writes its children again
        return self._kept(self._pages[1].join(self.ids.select(F.col("appid").alias("gameId"), "seq"), "gameId"), self._base is not None)

    @cached_property
    def listed(self) -> DataFrame:
        """The link lists of the store rows, once for each occurrence of an id."""
        lists = self.store.select("id", "developer_names", "publisher_names", "categories", "genres")
        return self._kept(lists.join(self.ids.select(F.col("appid").alias("id"), "seq"), "id"))

    @cached_property
    def catalog(self) -> Catalog | None:
        return None if self._base is None else apply_to_catalogue(self._base, self)


def select_ids(id_texts: DataFrame, offset: int = 0, limit: int | None = None,
               processed: list[DataFrame] | None = None) -> DataFrame:
    """S1 + L10 + J8: text ids → whole numbers (bad ones dropped) → offset → resume
    difference → limit, keeping file order (``seq``) and duplicates."""
    ids = id_texts.selectExpr("seq", f"{C.int_text('appid', 'bigint')} AS appid").where("appid IS NOT NULL")
    if offset:
        ids = offset_limit(ids, offset=offset)
    if processed:
        ids = resume_difference(ids, "appid", processed)
    if limit is not None:
        ids = offset_limit(ids, limit=limit)
    return ids


def _only(bodies: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Payloads of the ids in this run (``wanted``: their bitmaps; None when the run takes all ids), decoded to VARIANT.

    A body landed again replaces the earlier one of its id (and page): bodies
    with a ``landed`` column are cut to the latest before they are parsed;
    without that column each id (and page) must stand once."""
    if wanted is not None:
        bodies = with_ids(bodies, "id", wanted)
    if "landed" in bodies.columns:
        key = tuple(c for c in ("id", "page_no") if c in bodies.columns)
        bodies = M.last_per_key(bodies, key, "landed")
    return landing_payloads(bodies)


def merge_sources(ids: DataFrame, store: DataFrame | None, stats: DataFrame | None,
                  summaries: DataFrame | None, run_ts: str | None = None) -> DataFrame:
    """Base record ← store (its NULLs copied too) ← stats (seven
    fields) ← review summary; ``*_status`` = ok / missing per source.

    Three left joins on the id; all sides hash-partition on it (Catalyst
    broadcasts a side it measures as small)."""
    df = ids
    sources = []
    for name, src, fields in (("store", store, N.GAME_FIELDS), ("steamspy", stats, N.STATS_FIELDS),
                              ("reviews", summaries, N.SUMMARY_FIELDS)):
        if src is None:
            continue
        flag = f"__{name}"
        right = src.selectExpr(f"id AS {flag}_id", *[f"{ident(f)} AS {ident(flag + '_' + f)}" for f in fields],
                               f"true AS {flag}")
        df = df.join(right, df["appid"] == right[f"{flag}_id"], "left")
        sources.append((name, flag, fields))
    cols = ["seq", "CAST(appid AS INT) AS id"]
    for f in ENTITY_CSV_COLUMNS[1:30]:
        default = BASE_RECORD[f]
        v = "NULL" if default is None else (("true" if default else "false") if isinstance(default, bool)
                                             else (q(default) if isinstance(default, str) else str(default)))
        for name, flag, fields in sources:
            if f in fields:
                v = f"CASE WHEN {flag} IS NOT NULL THEN {ident(flag + '_' + f)} ELSE {v} END"
        cols.append(f"CAST({v} AS {ENTITY_TYPES[f]}) AS {ident(f)}")
    present = {name for name, _, _ in sources}
    for name in ("store", "steamspy", "reviews"):
        cond = f"__{name} IS NOT NULL" if name in present else "false"
        cols.append(f"CASE WHEN {cond} THEN 'ok' ELSE 'missing' END AS {name}_status")
    ts = q(run_ts) if run_ts is not None else "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\")"
    cols.append(f"{ts} AS last_updated")
    return df.selectExpr(*cols)


def ingest(id_texts: DataFrame, store_bodies: DataFrame, stats_bodies: DataFrame, page_bodies: DataFrame,
           catalog: Catalog | None = None, run_ts: str | None = None, offset: int = 0,
           limit: int | None = None, processed: list[DataFrame] | None = None,
           max_children: int = N.MAX_CHILDREN, checkpoint: bool = False) -> IngestRun:
    """Ids → offset → resume → limit → normalise the three sources →
    merge → upsert entities and children → links / dimensions.

    Lazy throughout, and only what is asked for is planned; the caller writes
    ``entities`` / ``reviews`` (CSV sinks) and the catalogue tables
    (``sinks.publish``).  The three sources and the merge are joined on the id,
    so one hash partitioning on the id serves every join (Catalyst broadcasts
    sides it measures as small).  A run over some ids filters the raw bodies by
    exact bitmaps of its ids before anything is shuffled; a run over all ids
    filters nothing.

    ``checkpoint=True`` (for big runs) writes the normalised sources and the
    parsed pages once to the session's shared ``spark.checkpoint.dir``: the
    merge, upserts and link upkeep then read them instead of re-parsing
    payloads in each branch, and a lost executor re-reads them instead of
    recomputing the lineage."""
    ids = select_ids(id_texts, offset, limit, processed)
    some = bool(offset or limit is not None or processed)
    return IngestRun(ids, some, (store_bodies, stats_bodies, page_bodies), catalog, run_ts, max_children, checkpoint)


def write_run(spark, run: IngestRun, root: str, resume: bool = False) -> None:
    """The job's outputs: entity and child CSV (appended to on a resumed run), and the
    catalogue's tables, made visible together by one manifest."""
    from ..sources import sinks
    sinks.write_entity_csv(spark, run.entities, f"{root}/entities", ENTITY_CSV_COLUMNS, resume=resume)
    sinks.write_child_csv(spark, run.reviews, f"{root}/children", N.REVIEW_FIELDS,
                          datetime_cols=("authorLastPlayed", "timestampCreated", "timestampUpdated"), resume=resume)
    if run.catalog is not None:
        sinks.publish(spark, f"{root}/tables", {name: run.catalog.df(name) for name in CATALOGUE_MODELS if name in run.catalog.loaders or name in run.catalog.tables},
                      models=CATALOGUE_MODELS)


def published_catalog(spark, root: str) -> Catalog:
    """The tables that the last run published."""
    from ..sources import sinks
    loaders = {name: partial(sinks.read_table, spark, f"{root}/tables", name, m.schema) for name, m in CATALOGUE_MODELS.items()}
    return Catalog(spark, {}, CATALOGUE_MODELS).with_loaders(loaders)


def apply_to_catalogue(cat: Catalog, run: IngestRun) -> Catalog:
    """Upserts and link upkeep of one run (M3, M15, M16), set-based; each table is planned when it is asked for.

    Repeated ids: the last occurrence (highest ``seq``) wins, and links /
    counters only count new distinct pairs, so rerunning a batch changes nothing."""
    def games():
        cols = [f.name for f in CATALOGUE_MODELS["Game"].schema.fields]
        return M.upsert(cat.df("Game"), run.merged.select("seq", *cols), CATALOGUE_MODELS["Game"], seq="seq", check=False).table

    def reviews():
        cols = [f.name for f in CATALOGUE_MODELS["Review"].schema.fields]
        rows = run.reviews.select(*cols, F.struct("seq", "rank").alias("__seq"))
        return M.upsert(cat.df("Review"), rows, CATALOGUE_MODELS["Review"], seq="__seq", check=False).table

    def counted(names: str, name_col: str, link: str, table: str, part: int):
        pairs = N.name_links(run.listed, names, name_col).select(F.col("gameId").cast("int"), name_col)
        return M.maintain_counted_links(cat.df(link), cat.df(table), pairs, "gameId", name_col)[part].table

    def dimension(list_col: str, dim: str, link: str, link_col: str, part: int):
        items = N.item_links(run.listed, list_col, seq="seq").select(
            F.col("gameId").cast("int"), F.col("id").try_cast("int").alias("id"), "name",
            F.struct("seq", "pos").alias("__seq")).where("id IS NOT NULL")  # others: oversized_items
        table = M.maintain_dimension(cat.df(dim), cat.df(link), items, "id", link_col, "__seq")[part].table
        return table.select(*cat.df(dim if part == 0 else link).columns)

    loaders = {"Game": games, "Review": reviews}
    for names, name_col, link, table in (("developer_names", "developerName", "GameDeveloper", "Developer"),
                                         ("publisher_names", "publisherName", "GamePublisher", "Publisher")):
        loaders[link] = partial(counted, names, name_col, link, table, 0)
        loaders[table] = partial(counted, names, name_col, link, table, 1)
    for list_col, dim, link, link_col in (("categories", "Category", "GameCategory", "categoryId"),
                                          ("genres", "Genre", "GameGenre", "genreId")):
        loaders[dim] = partial(dimension, list_col, dim, link, link_col, 0)
        loaders[link] = partial(dimension, list_col, dim, link, link_col, 1)
    return cat.with_loaders(loaders)


def oversized_items(store: DataFrame, list_col: str) -> DataFrame:
    """Categories / genres whose id fits no 32-bit key: ``(gameId, id, name)``.  They are left out of the dimension."""
    items = N.item_links(store.withColumn("seq", F.lit(0)), list_col, seq="seq")
    return items.where(F.col("id").isNotNull() & F.col("id").try_cast("int").isNull()).select("gameId", "id", "name")


def export_ids(pages: DataFrame) -> DataFrame:
    """Id-list pages → valid prefix → unique ids, ascending (S8 → G9)."""
    appids = N.id_list_pages(landing_payloads(pages))
    return distinct_sorted_ids(appids, "appid")
