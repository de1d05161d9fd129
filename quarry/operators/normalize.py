"""Normalisation jobs: landed JSON payloads → typed catalogue rows (P1–P5),
the child-page run rules (N3–N5) and the paged id list (S8).

Each job takes a DataFrame of payloads (``payload`` is VARIANT, NULL when the
body did not decode) and returns DataFrames; nothing is parsed row by row in
Python.  Jobs run in stages, one ``selectExpr`` each: variant sub-values are
materialised as columns together with their kind (``clean.with_kinds``), then
the field rules of ``quarry.functions.clean`` (SQL expressions) read those
attributes.  Catalyst does not re-inline the expensive ``schema_of_variant``
across the projections, so each value is inspected once; filters on parsed
flags sit behind a fence (``fenced_where``) so they are not pushed down and
re-expanded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.clean import ident

MAX_CHILDREN = 100  # children kept per parent (fixed value of the source API paging)

# Output field names of the source format (entity, stats,
# summary and child rows); payload keys read below are the source's JSON keys.
GAME_FIELDS = ("name", "required_age", "is_free", "detailed_description", "about_the_game",
               "short_description", "supported_languages", "header_image", "developers", "publishers",
               "windows", "mac", "linux", "metacritic", "release_date", "coming_soon")
STATS_FIELDS = ("owners_min", "owners_max", "average_forever", "average_2weeks", "median_forever",
                "median_2weeks", "ccu")
SUMMARY_FIELDS = ("reviewNumReviews", "reviewScore", "reviewScoreDesc", "reviewTotalPositive",
                  "reviewTotalNegative", "reviewTotalReviews")
REVIEW_FIELDS = ("id", "gameId", "authorSteamId", "authorPlaytimeForever", "authorPlaytimeAtReview",
                 "authorLastPlayed", "language", "review", "votedUp", "votesUp", "votesFunny",
                 "weightedVoteScore", "writtenDuringEarlyAccess", "timestampCreated", "timestampUpdated")


def fenced_where(df: DataFrame, cond: str) -> DataFrame:
    """``df.where(cond)`` that Catalyst will not push below ``df``.

    A filter on parsed flags would otherwise be pushed through every staging
    projection, each alias replaced by its definition, so the condition grows
    with every reference down to the raw body (and is computed twice).  A
    projection holding a non-deterministic column (``spark_partition_id()``,
    free to compute) that the filter reads is a fence Catalyst respects."""
    fenced = df.selectExpr("*", "spark_partition_id() AS __fence")
    return fenced.where(f"({cond}) AND __fence >= 0").drop("__fence")


# ------------------------------------------------------------------ P1 / P2 store
def store_records(payloads: DataFrame, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """P1 + P2: ``{"<id>": {success, data}}`` payloads → one row per kept id:
    ``id``, the 16 entity fields, and the link lists ``developer_names``,
    ``publisher_names`` (array<string>), ``categories``, ``genres``
    (array<struct<id bigint, name string>>).

    Kept only if the payload is an object, its entry under the id's key is an
    object with a truthy ``success``, and ``data`` is an object or falsy
    (falsy data gives every field its default)."""
    extra = [c for c in payloads.columns if c not in (id_col, payload_col, "body")]
    ex = [ident(c) for c in extra]
    # the entry under the id's own key (the key is data, so read the object as a map);
    # a payload that is not an object has no map, hence no entry
    s1 = payloads.selectExpr(f"{ident(id_col)} AS __id", *ex,
                             f"try_element_at(try_variant_get({ident(payload_col)}, '$', 'map<string,variant>'), "
                             f"CAST({ident(id_col)} AS STRING)) AS __entry")
    s2 = C.with_kinds(s1, {"__e": "__entry", "__data": C.vget("__entry", "$.data"),
                           "__success": C.vget("__entry", "$.success")}, keep=["__id", *extra])
    d, dk = C.vk("__data")
    kept = f"{C.is_object(*C.vk('__e'))} AND {C.truthy(*C.vk('__success'))} AND (NOT {C.truthy(d, dk)} OR {C.is_object(d, dk)})"
    s3 = fenced_where(s2, kept).selectExpr("__id", *ex, f"CASE WHEN {C.is_object(d, dk)} THEN {d} END AS __d")
    paths = {n: f"$.{n}" for n in ("name", "required_age", "is_free", "detailed_description", "about_the_game",
                                   "short_description", "supported_languages", "header_image", "developers",
                                   "publishers", "categories", "genres")}
    paths.update({"windows": "$.platforms.windows", "mac": "$.platforms.mac", "linux": "$.platforms.linux",
                  "metacritic": "$.metacritic.score", "rd": "$.release_date",
                  "rd_date": "$.release_date.date", "rd_soon": "$.release_date.coming_soon"})
    s4 = C.with_kinds(s3, {f"__f_{n}": C.vget("__d", p) for n, p in paths.items()}, keep=["__id", *extra])

    def f(n):
        return C.vk(f"__f_{n}")

    texts = ("name", "detailed_description", "about_the_game", "short_description", "supported_languages")
    s5 = s4.selectExpr(
        "*", f"{C.string_or_list(*f('developers'))} AS __devs", f"{C.string_or_list(*f('publishers'))} AS __pubs",
        *[f"{C.text_or_empty(*f(n))} AS __t_{n}" for n in texts])
    rd_obj = C.is_object(*f("rd"))
    rules = s5.selectExpr(
        "__id AS id", *[f"__t_{n}" for n in texts], *ex,
        f"{C.required_age(*f('required_age'))} AS required_age",
        f"{C.truthy(*f('is_free'))} AS is_free",
        f"{C.text_or_empty(*f('header_image'))} AS header_image",
        f"{C.join_list('__devs')} AS developers",
        f"{C.join_list('__pubs')} AS publishers",
        f"{C.truthy(*f('windows'))} AS windows",
        f"{C.truthy(*f('mac'))} AS mac",
        f"{C.truthy(*f('linux'))} AS linux",
        f"{C.to_int32(C.variant_int(*f('metacritic')))} AS metacritic",
        f"CASE WHEN {rd_obj} THEN {C.parse_release_date(C.text_or_empty(*f('rd_date')))} END AS release_date",
        f"({rd_obj} AND {C.truthy(*f('rd_soon'))}) AS coming_soon",
        f"{C.link_names('__devs')} AS developer_names",
        f"{C.link_names('__pubs')} AS publisher_names",
        f"{C.id_name_items(*f('categories'), ('description',))} AS categories",
        f"{C.id_name_items(*f('genres'), ('description', 'name'))} AS genres")
    # F1 (HTML) needs the entity table: the only Column-built step, all five
    # fields in one projection so they share one Arrow evaluation
    out = rules.select("*", *[C.strip_html(F.col(f"__t_{n}")).alias(f"__h_{n}") for n in texts])
    cols = [F.col("id")]
    for n in GAME_FIELDS:
        if n == "supported_languages":
            cols.append(C.col(C.list_separators("__h_supported_languages")).alias(n))
        elif n in texts:
            cols.append(F.col(f"__h_{n}").alias(n))
        else:
            cols.append(F.col(n))
    cols += [F.col(c) for c in ("developer_names", "publisher_names", "categories", "genres", *extra)]
    return out.select(*cols)


def name_links(store: DataFrame, list_col: str, name_out: str, seq: str | None = None) -> DataFrame:
    """P2 long form of a name list: one row per (gameId, name, position)."""
    keep = [F.col("id").alias("gameId")] + ([F.col(seq)] if seq else [])
    return store.select(*keep, F.posexplode(list_col).alias("pos", name_out))


def item_links(store: DataFrame, list_col: str, seq: str | None = None) -> DataFrame:
    """P2 long form of an {id, name} list: one row per (gameId, id, name, position)."""
    keep = [F.col("id").alias("gameId")] + ([F.col(seq)] if seq else [])
    return store.select(*keep, F.posexplode(list_col).alias("pos", "item")).select(
        *[F.col(c) for c in ["gameId"] + ([seq] if seq else [])], "pos",
        F.col("item.id").alias("id"), F.col("item.name").alias("name"))


# ------------------------------------------------------------------ P3 stats
def stats_records(payloads: DataFrame, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """Owners range and five counts (each ``int(x or 0)``); non-object payload → missing."""
    names = ("owners", "average_forever", "average_2weeks", "median_forever", "median_2weeks", "ccu")
    s1 = C.with_kinds(payloads.selectExpr(f"{ident(id_col)} AS id", f"{ident(payload_col)} AS __p"),
                      {"__pk": "__p"}, keep=["id", "__p"])
    s1 = fenced_where(s1, C.is_object(*C.vk("__pk")))
    staged = C.with_kinds(s1, {f"__{n}": C.vget("__p", f"$.{n}") for n in names}, keep=["id"])
    lo, hi = C.owners_range(*C.vk("__owners"))
    return staged.selectExpr("id", f"{C.clamp_int(lo)} AS owners_min", f"{C.clamp_int(hi)} AS owners_max",
                             *[f"{C.clamp_int(C.variant_int(*C.vk(f'__{n}'), default=0))} AS {n}" for n in names[1:]])


# ------------------------------------------------------------------ P5 child rows
def review_rows(items: DataFrame, game_col: str = "id", item_col: str = "item") -> DataFrame:
    """P5: one review item (VARIANT) per row → the 15 review columns;
    non-objects and items without ``recommendationid`` are dropped."""
    extra = [c for c in items.columns if c not in (game_col, item_col)]
    ex = [ident(c) for c in extra]
    top = ("recommendationid", "author", "language", "review", "voted_up", "votes_up", "votes_funny",
           "weighted_vote_score", "written_during_early_access", "timestamp_created", "timestamp_updated")
    s0 = C.with_kinds(items.selectExpr(f"{ident(game_col)} AS __game", *ex, f"{ident(item_col)} AS __r"),
                      {"__rk": "__r"}, keep=["__game", *extra, "__r"])
    s0 = fenced_where(s0, C.is_object(*C.vk("__rk")))
    s1 = C.with_kinds(s0, {f"__r_{k}": C.vget("__r", f"$.{k}") for k in top}, keep=["__game", *extra])
    s1 = fenced_where(s1.selectExpr("*", f"{_rec_text(*C.vk('__r_recommendationid'))} AS __rid"), "__rid <> ''")
    a, ak = C.vk("__r_author")
    auth = ("steamid", "playtime_forever", "playtime_at_review", "last_played")
    s2 = C.with_kinds(s1, {f"__a_{k}": f"CASE WHEN {C.is_object(a, ak)} THEN {C.vget(a, '$.' + k)} END" for k in auth})

    def rv(k):
        return C.vk(f"__r_{k}")

    def av(k):
        return C.vk(f"__a_{k}")

    return s2.selectExpr(
        "__rid AS id", "CAST(__game AS INT) AS gameId",
        f"CASE WHEN {C.truthy(*av('steamid'))} THEN {C.item_text(*av('steamid'))} ELSE '' END AS authorSteamId",
        f"{C.clamp_int(C.variant_int(*av('playtime_forever'), default=0))} AS authorPlaytimeForever",
        f"{C.clamp_int(C.variant_int(*av('playtime_at_review'), default=0))} AS authorPlaytimeAtReview",
        f"{C.epoch_to_ts(C.variant_int(*av('last_played'), default=0))} AS authorLastPlayed",
        f"{C.text_or_empty(*rv('language'))} AS language",
        f"{C.text_or_empty(*rv('review'))} AS review",
        f"{C.truthy(*rv('voted_up'))} AS votedUp",
        f"{C.clamp_int(C.variant_int(*rv('votes_up'), default=0))} AS votesUp",
        f"{C.clamp_int(C.variant_int(*rv('votes_funny'), default=0))} AS votesFunny",
        f"{C.variant_float(*rv('weighted_vote_score'), default=0.0)} AS weightedVoteScore",
        f"{C.truthy(*rv('written_during_early_access'))} AS writtenDuringEarlyAccess",
        f"{C.epoch_to_ts(C.variant_int(*rv('timestamp_created'), default=0))} AS timestampCreated",
        f"{C.epoch_to_ts(C.variant_int(*rv('timestamp_updated'), default=0))} AS timestampUpdated",
        *ex)


def _rec_text(v: str, k: str) -> str:
    return f"CASE WHEN {C.truthy(v, k)} THEN {C.item_text(v, k)} ELSE '' END"


def _valid_item(e: str) -> str:
    """A review item (struct of v, k) that is an object with a non-empty id."""
    rid = C.vget(f"{e}.v", "$.recommendationid")
    return f"({e}.k IN ('obj', 'obj0') AND {_rec_text(rid, C.kind(rid))} <> '')"


# ------------------------------------------------------------------ P4 + N3 N4 N5 page runs
def parse_pages(pages: DataFrame, id_col: str = "id", page_col: str = "page_no", payload_col: str = "payload") -> DataFrame:
    """One row a page: failed, next_cursor, summary (struct or NULL), its valid items and their number."""
    s0 = C.with_kinds(pages.selectExpr(f"{ident(id_col)} AS id", f"{ident(page_col)} AS page_no",
                                       f"{ident(payload_col)} AS payload"),
                      {"__pk": "payload"}, keep=["id", "page_no", "payload"])
    s1 = C.with_kinds(s0, {"__success": C.vget("payload", "$.success"), "__reviews": C.vget("payload", "$.reviews"),
                           "__cursor": C.vget("payload", "$.cursor"), "__qs": C.vget("payload", "$.query_summary")},
                      keep=["id", "page_no", "payload", "__pk", "__pk__k"])
    usable = f"({C.is_object(*C.vk('__pk'))} AND {C.truthy(*C.vk('__success'))})"
    s2 = s1.selectExpr(
        "id", "page_no", "payload IS NULL AS failed",
        f"CASE WHEN {usable} AND {C.is_array(*C.vk('__reviews'))} THEN {C.variant_items(*C.vk('__reviews'))} END AS items",
        f"CASE WHEN {C.is_string(*C.vk('__cursor'))} THEN {C.vget('__cursor', '$', 'string')} END AS next_cursor",
        f"CASE WHEN {usable} AND {C.is_object(*C.vk('__qs'))} THEN __qs END AS __sq")
    qs_fields = ("num_reviews", "review_score", "review_score_desc", "total_positive", "total_negative",
                 "total_reviews")
    s3 = C.with_kinds(s2, {f"__q_{n}": C.vget("__sq", f"$.{n}") for n in qs_fields},
                      keep=["id", "page_no", "failed", "items", "next_cursor", "__sq"])

    def iv(n):
        return C.to_int32(C.variant_int(*C.vk(f"__q_{n}")))

    summary = (f"CASE WHEN __sq IS NOT NULL THEN named_struct("
               f"'reviewNumReviews', {iv('num_reviews')}, 'reviewScore', {iv('review_score')}, "
               f"'reviewScoreDesc', {C.text_or_null(*C.vk('__q_review_score_desc'))}, "
               f"'reviewTotalPositive', {iv('total_positive')}, 'reviewTotalNegative', {iv('total_negative')}, "
               f"'reviewTotalReviews', {iv('total_reviews')}) END")
    e = "e_item"
    base = s3.selectExpr("id", "page_no", "failed", "next_cursor", f"{summary} AS summary",
                         f"filter(items, {e} -> {_valid_item(e)}) AS items")
    return base.selectExpr("*", "coalesce(size(items), 0) AS n_valid")


def advance_runs(runs: DataFrame, base: DataFrame, cap: int = MAX_CHILDREN) -> tuple[DataFrame, DataFrame]:
    """Go on with the page runs of ``runs`` by further parsed pages, in whatever order pages land.

    ``runs`` holds what each id's run has come to: last_page, closed, the cursors
    it used, n_children and its first summary.  Pages right after ``last_page``
    are visited by the rules of ``page_run``; a page beyond a gap waits.  A
    visited page but the last has a child, so only ``cap - n_children`` pages
    after the last one can ever be visited, and no window holds more.
    Returns the runs that moved, and the children of the visited pages.
    """
    state = runs.select("id", "last_page", "closed", "cursors", "n_children", F.col("summary").alias("first_summary"))
    j = base.join(state.hint("merge"), "id", "left").withColumns({
        "last_page": F.coalesce("last_page", F.lit(0)), "closed": F.coalesce("closed", F.lit(False)), "n_children": F.coalesce("n_children", F.lit(0)),
        "cursors": F.coalesce("cursors", F.array().cast("array<string>"))})
    j = j.where(reachable(cap))
    w = Window.partitionBy("id").orderBy("page_no")
    j = j.withColumns({
        "place": F.row_number().over(w), "so_far": F.sum("n_valid").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "first_use": F.min("page_no").over(Window.partitionBy("id", "next_cursor"))})
    j = j.withColumn("stop", F.col("failed") | (F.col("n_valid") == 0) | F.col("next_cursor").isNull() | (F.col("next_cursor") == "*")
                     | F.coalesce(F.array_contains("cursors", F.col("next_cursor")), F.lit(False)) | (F.col("first_use") < F.col("page_no"))
                     | (F.col("n_children") + F.col("so_far") >= cap))
    j = j.withColumn("stopped", F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    visited = j.where((F.col("page_no") == F.col("last_page") + F.col("place")) & ~F.col("stopped"))
    has_summary = F.col("summary").isNotNull()
    moved = visited.groupBy("id").agg(
        F.max("page_no").alias("last_page"), F.max("stop").alias("closed"),
        F.concat(F.first("cursors"), F.collect_list("next_cursor")).alias("cursors"),
        F.least(F.lit(cap), F.first("n_children") + F.sum("n_valid")).cast("int").alias("n_children"),
        F.coalesce(F.first("first_summary"), F.min_by("summary", F.when(has_summary, F.col("page_no")))).alias("summary"))
    items = visited.select("id", "page_no", (F.col("n_children") + F.col("so_far") - F.col("n_valid")).alias("before"), F.posexplode("items").alias("pos", "it"))
    items = items.select("id", F.col("it.v").alias("item"), "page_no", "pos", (F.col("before") + F.col("pos") + 1).cast("int").alias("rank")).where(F.col("rank") <= cap)
    return moved, review_rows(items, "id", "item")


def reachable(cap: int):
    """Pages that a run may still visit."""
    return F.expr(f"NOT coalesce(closed, false) AND page_no > coalesce(last_page, 0) AND page_no <= coalesce(last_page, 0) + {int(cap)} - coalesce(n_children, 0)")


def page_run(pages: DataFrame, id_col: str = "id", page_col: str = "page_no", payload_col: str = "payload",
             cap: int = MAX_CHILDREN, parsed=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Child pages ``(id, page_no, payload)`` in fetch order → (summaries, reviews).

    The run of pages the source visits is a prefix: it ends at the first page
    that failed (NULL payload; gives nothing), that has no valid review (gives
    its summary only), whose next cursor is missing, ``'*'`` or already used,
    or where ``cap`` reviews are reached.  The first page that never landed
    ends it too, also when later ones did.  ``parsed`` may write the parsed
    pages once, so that the passes below read them back.

    * summaries (P4/N5): first non-NULL summary per id among the visited pages;
    * reviews (P5/N3): the first ``cap`` valid reviews in (page, position) order.

    All steps are grouped aggregates or windows on the id (cursor) keys; the
    ``row_number() <= cap`` filter lets Spark cut each id to ``cap`` rows per
    map task before the shuffle, so a parent with a huge landed history stays
    bounded.
    """
    base = parse_pages(pages, id_col, page_col, payload_col)
    # several consumers read `base`; the fence keeps each from inlining the parse chain
    base = parsed(base.selectExpr("*", "spark_partition_id() AS __fence"))

    # pass 1 over `base`: per id, the first stopping page and the first page with a summary
    # a cursor's first use is a grouped minimum, so a hot (id, cursor) ships one row a task
    used = base.groupBy("id", "next_cursor").agg(F.min("page_no").alias("first_use"))
    following = base.select("id", (F.col("page_no") - 1).alias("page_no"), F.lit(True).alias("followed")).distinct()
    flagged = (base.select("id", "page_no", "summary", "failed", "n_valid", "next_cursor", "__fence")
               .join(used, ["id", "next_cursor"], "left").join(following, ["id", "page_no"], "left"))
    flagged = flagged.select("id", "page_no", "summary", (
        F.col("failed") | (F.col("n_valid") == 0) | F.col("next_cursor").isNull()
        | (F.col("next_cursor") == "*") | F.coalesce(F.col("first_use") < F.col("page_no"), F.lit(False))
        | F.col("followed").isNull() | (F.col("__fence") < 0)).alias("stop"))
    has_summary = F.col("summary").isNotNull()
    per_id = flagged.groupBy("id").agg(
        # a run begins at page 1: without it nothing was visited
        F.when(F.min("page_no") > 1, F.lit(0)).otherwise(F.min(F.when(F.col("stop"), F.col("page_no")))).alias("stop_page"),
        F.min(F.when(has_summary, F.col("page_no"))).alias("summary_page"),
        F.min_by("summary", F.when(has_summary, F.col("page_no"))).alias("summary"))

    # pass 2 over `base`: the children in (page, position) order, at most `cap` per id
    exploded = (base.select("id", "page_no", F.posexplode("items").alias("pos", "it"))
                .select("id", "page_no", "pos", F.col("it.v").alias("item")))
    w = Window.partitionBy("id").orderBy("page_no", "pos")
    ranked = exploded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    cap_page = ranked.where(F.col("rank") == cap).select("id", F.col("page_no").alias("cap_page"))
    limits = (per_id.join(cap_page, "id", "left")
              .select("id", "summary_page", "summary", F.least("stop_page", "cap_page").alias("last_page")))

    kept = ranked.join(limits.select("id", "last_page"), "id", "left").where(
        F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page")))
    reviews = review_rows(kept.select("id", "item", "page_no", "pos", "rank"), "id", "item")

    summaries = (limits.where(F.col("summary").isNotNull()
                              & (F.col("last_page").isNull() | (F.col("summary_page") <= F.col("last_page"))))
                 .select("id", "summary.*"))
    return summaries, reviews


# ------------------------------------------------------------------ S8 id-list pages
def id_list_pages(pages: DataFrame, page_col: str = "page_no", payload_col: str = "payload") -> DataFrame:
    """Pages ``{apps: [{appid, name}]}`` in page order → ``(page_no, pos, appid)``.

    The run stops at the first page with no apps (it gives nothing) and after
    a page whose last entry has no integer ``appid`` (that page still counts);
    entries without an integer appid are skipped.  A page whose ``apps`` is
    truthy but not a list is an error in the source: ``bad_id_pages`` lists
    them, and here such a page ends the run like an empty one.
    """
    s0 = C.with_kinds(pages.selectExpr(f"{ident(page_col)} AS page_no", f"{ident(payload_col)} AS __p"),
                      {"__apps": C.vget("__p", "$.apps")}, keep=["page_no"])
    a, b = "e_app", "e_ok"
    # isinstance(x, int): JSON integers, and booleans (a bool is an int there)
    s1 = s0.selectExpr(
        "page_no",
        f"transform(CASE WHEN {C.is_array(*C.vk('__apps'))} THEN {C.variant_items(*C.vk('__apps'))} END, "
        f"{a} -> CASE WHEN {a}.k IN ('obj', 'obj0') THEN {C.vget(a + '.v', '$.appid')} END) AS ids")
    s2 = s1.selectExpr("page_no", f"transform(ids, {b} -> named_struct('ok', coalesce({C.kind(b)} IN ('int', 'bool'), false), "
                                  f"'appid', {C.vget(b, '$', 'bigint')})) AS apps")
    flagged = s2.selectExpr("page_no", "apps", "coalesce(size(apps), 0) = 0 AS empty",
                            "coalesce(size(apps), 0) > 0 AND NOT coalesce(try_element_at(apps, -1).ok, false) AS tail_bad")
    # both stop pages are one aggregate: a scalar subquery, computed once and used as a literal
    stops = flagged.agg(F.struct(F.min(F.when(F.col("empty"), F.col("page_no"))).alias("empty"),
                                 F.min(F.when(F.col("tail_bad"), F.col("page_no"))).alias("bad")).alias("s")).scalar()
    empty_page, bad_page = stops["empty"], stops["bad"]
    kept = flagged.where((empty_page.isNull() | (F.col("page_no") < empty_page))
                         & (bad_page.isNull() | (F.col("page_no") <= bad_page)))
    out = kept.select("page_no", F.posexplode("apps").alias("pos", "app"))
    return out.where(F.col("app.ok")).select("page_no", "pos", F.col("app.appid").alias("appid"))


def bad_id_pages(pages: DataFrame, page_col: str = "page_no", payload_col: str = "payload") -> DataFrame:
    """Pages whose ``apps`` is truthy but not a list (an error in the source)."""
    s = C.with_kinds(pages.selectExpr(f"{ident(page_col)} AS page_no", f"{ident(payload_col)} AS __p"),
                     {"__apps": C.vget("__p", "$.apps")}, keep=["page_no"])
    return s.where(f"{C.truthy(*C.vk('__apps'))} AND NOT {C.is_array(*C.vk('__apps'))}").select("page_no")
