"""End-to-end runs over landed data (the reference's three entry points as jobs).

* ``run_list``     landed list payloads of one source → common offers (A2–A8, C1–C3, F1, C7)
* ``run_details``  offers + landed detail responses + cache → enriched offers, new cache, status (Entry 2)
* ``run_writer``   collect files of a run → deduped, numbered tracker rows, JSON export, summary (Entry 3)

Each function returns DataFrames (lazy) and, where asked, writes through the sinks;
nothing is collected on the driver except one-row summaries.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.classify import block_flag, block_mark
from jobtide.functions.detail import content_found, content_stages, with_detail_fields
from jobtide.functions.urls import identity_key, url_key
from jobtide.operators import cache as K
from jobtide.operators import enrich as EN
from jobtide.operators.dedup import dedup_run, dedup_source, source_dedup_key
from jobtide.operators.filters import apply_filters
from jobtide.operators.mapping import conform, require, to_common
from jobtide.operators.numbering import number_within
from jobtide.operators.outcomes import RULES, resolve_outcomes, run_status
from jobtide.operators.positional import run_names
from jobtide.operators.status import with_description
from jobtide.functions.tracker import to_tracker
from jobtide.sinks import export as SK
from jobtide.session import scratch_path
from jobtide.sources import landing as L

TYPED = {"justjoin", "rocketjobs"}


def run_list(landing: DataFrame, source: str, filters: DataFrame | None = None) -> DataFrame:
    """One source's landed list rows (run_id, page_no, position, payload) → common offers.
    API pages carry many items: list order is (page_no, item index), kept as one number with
    the page in its upper 32 bits, so pages of any length stay apart.  Every landed row that
    meets the source's requirement and the filters stays; there is no cap."""
    order = F.shiftleft(F.col("page_no").cast("bigint"), 32) + F.col("item_pos")
    if source in TYPED:
        items = L.ingest_board_api(landing).withColumn("position", order)
    elif source == "nofluffjobs":
        items = L.ingest_postings(landing).withColumn("position", order)
    elif source == "talentdays":
        items = L.ingest_items(landing).withColumn("position", order).withColumn(
            "item", F.try_variant_get("item", "$", L.TALENTDAYS_ITEM.simpleString()))
    else:
        items = L.ingest_cards(landing, source)
    offers = require(to_common(items, source, keep=("run_id", "position", "id", "jk")))
    key = source_dedup_key(source) if source in ("olx", "indeed", "nofluffjobs", "pracuj", "theprotocol") else None
    offers = dedup_source(offers, key)
    if filters is not None:
        offers = apply_filters(offers, filters.where(F.col("source") == source))
    return conform(offers)


def run_details(offers: DataFrame, details: DataFrame, cache: DataFrame, source: str,
                now: dt.datetime | None = None) -> dict[str, DataFrame]:
    """Entry 2.  ``details`` = landing_detail rows (run_id, source, position, url, status,
    body, error) holding the source's detail responses; they are attached by the source's detail id
    (``attach_responses``).

    Cache hits, twins and fresh fetches carry a fields struct; the source's merge rule
    applies it: override (fields present replace list values; the description always)
    or, for olx, fill-only with the salary triple taken only when the list had none."""
    rules = RULES[source]
    o = EN.cache_lookup(offers.withColumn("url_key", url_key("url")), cache)
    landed = _landed(details, source)
    flags = ["status", "error", "parsed", "malformed", "blocked", "block_mark", "nonempty", "_rid"]
    narrow = landed.drop("_det")
    has_url = F.coalesce(F.col("url_key") != "", F.lit(False))
    att = EN.attach_responses(o, narrow, source, flags)
    att = att.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("parsed", "malformed", "blocked", "nonempty")}) \
        .withColumn("no_slug", has_url & F.coalesce(EN.detail_id(source, "url") == "", F.lit(True)))
    resolved = resolve_outcomes(att, rules, twin_fields=("_rid",), materialize=True)
    # The texts move once: to the offers that take them.  Offers that take none don't meet in one task.
    oc = F.col("outcome")
    hit = (oc == "cached") & F.col("cache_hit")
    taken = F.when(oc == "fetched", F.col("_rid")).when((oc == "cached") & ~hit, F.col("twin__rid"))
    none = -1 - F.shiftrightunsigned(F.xxhash64("run_id", "source", "position"), 1)
    out = resolved.withColumn("_taken", F.coalesce(taken, none)).drop("_rid", "twin__rid")
    out = out.join(landed.select(F.col("_rid").alias("_taken"), "_det"), "_taken", "left").drop("_taken")
    cached = set(cache.schema["f"].dataType.fieldNames())
    hit_fields = F.struct(*[(F.col(f"hit_f.{f}") if f in cached else F.lit(None)).cast(FIELD_TYPES[f]).alias(f)
                            for f in DETAIL_ALL])
    out = out.withColumn("_got", F.when(hit, hit_fields).otherwise(F.col("_det")))
    cols = set(out.columns)
    if rules.empty_is_fetched and source == "olx":          # fill-only merge
        guard = F.col("salary_from").isNull() if "salary_from" in cols else F.lit(True)
        out = out.withColumn("_guard", guard)
        for f in DETAIL_ALL:
            cur = F.col(f) if f in cols else F.lit(None)
            if f in ("salary_from", "salary_to", "salary_currency"):
                out = out.withColumn(f, F.when(F.col("_guard"), F.coalesce(cur, F.col(f"_got.{f}"))).otherwise(cur))
            else:
                out = out.withColumn(f, F.coalesce(cur, F.col(f"_got.{f}")))
        out = out.drop("_guard")
    else:                                                    # override merge
        for f in DETAIL_ALL:
            cur = F.col(f) if f in cols else F.lit(None)
            if f == "description":
                out = out.withColumn(f, F.when(F.col("_got").isNotNull(), F.col("_got.description")).otherwise(cur))
            else:
                out = out.withColumn(f, F.coalesce(F.col(f"_got.{f}"), cur))
    stamp = F.lit(now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp")
    new_entries = out.where(oc == "fetched").select(
        "url_key", stamp.alias("fetched_at"),
        F.struct(*[F.col(f"_det.{c}").cast(FIELD_TYPES[c]).alias(c) for c in cache.schema["f"].dataType.fieldNames()])
        .alias("f"))
    new_cache = K.cache_upsert(cache, new_entries, desc="f.description")
    enriched = conform(out.drop("_got", "_det", "hit_f"))
    return {"offers": enriched, "cache": new_cache, "status": run_status(resolved, rules)}


def _landed(details: DataFrame, source: str) -> DataFrame:
    """The responses with what their bodies tell, read once and written with a number (``_rid``) of their own.  Joins and
    outcomes then work on flags and numbers, and a body is never exchanged."""
    if "error" not in details.columns:
        details = details.withColumn("error", F.lit(None).cast("string"))
    d = details.select("run_id", "source", "position", "url", "status", "error", "body")
    stages = content_stages("body", source)
    for stage in stages:
        d = d.withColumns(stage)
    parsed, malformed = content_found(source)
    # nofluffjobs scans every body for needles; the others only where the content is missing.
    scan = F.lit(False) if source == "nofluffjobs" else F.col("parsed")
    d = (d.withColumns({"parsed": F.coalesce(parsed, F.lit(False)), "malformed": F.coalesce(malformed, F.lit(False))})
         .withColumn("blocked", block_flag("body", "status", has_content=scan)))
    d = with_detail_fields(d, "body", source, "_det", content="_dv", where=F.col("status").between(200, 299))
    # Which needle it was matters in the blocked ones only.
    d = (d.withColumns({"block_mark": F.when(F.col("blocked"), block_mark("body")),
                        "nonempty": F.coalesce(F.length("_det.description") > 0, F.lit(False))})
         .drop("body", *[c for stage in stages for c in stage])
         .withColumn("_rid", F.monotonically_increasing_id()))
    path = scratch_path(details.sparkSession, "responses")
    d.write.option("compression", "zstd").parquet(path)
    return details.sparkSession.read.schema(d.schema).parquet(path)


DETAIL_ALL = ["description", "skills_required", "skills_nice", "valid_through", "apply_url", "expires_at",
              "company", "contract_type", "experience_level", "salary_from", "salary_to", "salary_currency"]
FIELD_TYPES = {f: "array<string>" if f.startswith("skills") else "double" if f in ("salary_from", "salary_to") else "string"
               for f in DETAIL_ALL}


def name_run(spark: SparkSession, started_at: dt.datetime, run_id: str, earlier: DataFrame | None = None) -> dict:
    """F7 + I19 for one run: its tab and file stamp (both Warsaw time), told apart from the
    earlier runs (run_id, started_at) of the same minute.  A run that is already among them
    keeps its name, so writing it again replaces its own output."""
    me = spark.createDataFrame([(run_id, started_at)], "run_id string, started_at timestamp")
    if earlier is not None:
        same = earlier.select("run_id", F.col("started_at").cast("timestamp").alias("started_at")) \
            .where((F.date_trunc("minute", "started_at") == F.date_trunc("minute", F.lit(started_at)))
                   & (F.col("run_id") != run_id)).dropDuplicates(["run_id"])
        me = me.unionByName(same)
    row = run_names(me).where(F.col("run_id") == run_id).first()
    return {"run_tab": row["run_tab"], "export_stamp": row["export_stamp"]}


RUNS = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("started_at", T.TimestampType())])


def run_writer(spark: SparkSession, collect_path: str, started_at: dt.datetime, out: str | None = None,
               identity: str = "identity_key") -> dict[str, DataFrame]:
    """Entry 3.  Collect files → within-run dedup (identity key) → 1..n ids in (source,
    position) order → 13-column tracker rows; optional writes: tracker, JSON export with
    manifest (the sinks are isolated from each other) and the run's entry in ``out``/runs,
    by which later runs of the same minute get a name of their own."""
    run_id = started_at.strftime("%Y%m%d%H%M%S")
    earlier = L.read_or_empty(spark, f"{out}/runs", RUNS) if out else None
    name = name_run(spark, started_at, run_id, earlier)
    offers = L.read_collect(spark, collect_path).withColumn("run_id", F.lit(run_id))
    offers = offers.withColumn("source", F.coalesce(F.col("_src"), F.col("source")))
    # Winners and ids are found on rows without the description; two files may carry one source, so the file name
    # makes the order total.  Whole rows are fetched by that order key, once, where they are exported.
    place = ["source", "position", "_file"]
    narrow = dedup_run(offers.drop("description"), identity)
    numbered = number_within(narrow, ["run_id"], place, "id")
    whole = offers.join(numbered.select(*place, "id"), place)
    tracker = to_tracker(numbered).withColumn("run_tab", F.lit(name["run_tab"]))
    summary = with_description(whole)
    if out:
        stamp, seen = name["export_stamp"], {}
        SK.run_sinks(numbered, {
            "tracker": lambda d: SK.append_tracker(to_tracker(d).withColumn("run_tab", F.lit(name["run_tab"])),
                                                   f"{out}/tracker"),
            "export": lambda d: SK.export_full(whole, f"{out}/full/{stamp}", name["run_tab"], started_at.isoformat(), seen),
        })
        if "offers" in seen:        # counted while they were written
            summary = spark.createDataFrame([(run_id, seen["offers"], seen["with_description"])], summary.schema)
        if not earlier.where(F.col("run_id") == run_id).take(1):
            spark.createDataFrame([(run_id, started_at)], RUNS).write.mode("append").parquet(f"{out}/runs")
    return {"offers": whole.withColumn("identity_key", identity_key("url", "source")), "tracker": tracker,
            "summary": summary, "quarantine": L.quarantine_files(spark, collect_path), "file_stamp": spark.createDataFrame([(name["export_stamp"],)], "stamp string")}
