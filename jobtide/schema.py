"""Explicit schemas for the data product.

The common offer schema is the target every source is mapped to; collect files,
landed detail responses, the description cache and the tracker all have fixed
``StructType``s so that no job relies on schema inference.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, B, I, L = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType()
ARR_S = T.ArrayType(S)

# Source keys in the order the writer lists them, and their display names.
SOURCES = ["justjoin", "rocketjobs", "nofluffjobs", "talentdays", "pracuj", "theprotocol", "olx", "indeed"]
SOURCE_NAMES = {
    "justjoin": "JustJoin.it",
    "rocketjobs": "RocketJobs",
    "nofluffjobs": "NoFluffJobs",
    "talentdays": "TalentDays",
    "pracuj": "Pracuj.pl",
    "theprotocol": "theProtocol.it",
    "olx": "OLX",
    "indeed": "Indeed",
}

OFFER_FIELDS = [
    T.StructField("source", S),
    T.StructField("company", S),
    T.StructField("title", S),
    T.StructField("url", S),
    T.StructField("city", S),
    T.StructField("salary_from", D),
    T.StructField("salary_to", D),
    T.StructField("salary_currency", S),
    T.StructField("contract_type", S),
    T.StructField("experience_level", S),
    T.StructField("published_at", S),
    T.StructField("remote", B),
    T.StructField("description", S),
    T.StructField("skills_required", ARR_S),
    T.StructField("skills_nice", ARR_S),
    T.StructField("valid_through", S),
    T.StructField("apply_url", S),
    T.StructField("expires_at", S),
    T.StructField("detail_error", S),
]
OFFER = T.StructType(OFFER_FIELDS)
OFFER_COLUMNS = [f.name for f in OFFER_FIELDS]

# Enrichment fields a detail fetch (or cache hit) may carry.
DETAIL_FIELDS = ["description", "skills_required", "skills_nice", "valid_through", "apply_url", "expires_at"]

COLLECT_FILE = T.StructType([
    T.StructField("source", S),
    T.StructField("count", L),
    T.StructField("offers", T.ArrayType(OFFER)),
])

LANDING_DETAIL = T.StructType([
    T.StructField("run_id", S),
    T.StructField("source", S),
    T.StructField("position", L),
    T.StructField("url", S),
    T.StructField("status", I),
    T.StructField("body", S),
    T.StructField("error", S),
])

# Every field a detail response can give is cached, so a hit returns what a fetch would.
CACHE_FIELDS = T.StructType(
    [T.StructField(n, ARR_S if n.startswith("skills") else S) for n in DETAIL_FIELDS]
    + [T.StructField(n, S) for n in ("company", "contract_type", "experience_level")]
    + [T.StructField("salary_from", D), T.StructField("salary_to", D), T.StructField("salary_currency", S)])
DESC_CACHE = T.StructType([
    T.StructField("url_key", S),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("f", CACHE_FIELDS),
])
# In-file form of the cache: {key: {t: epoch ms, f: {...}}}
CACHE_FILE_MAP = T.MapType(S, T.StructType([T.StructField("t", L), T.StructField("f", CACHE_FIELDS)]))

# Tracker: 13 display columns plus the run partition column.
TRACKER_COLUMNS = ["id", "applied_at", "company", "title", "url", "source_name", "salary", "place_form",
                   "cv_sent", "status", "contact_at", "duplicate", "notes"]
TRACKER_HEADERS = ["ID", "Data aplikacji", "Firma", "Stanowisko", "Link do oferty", "Źródło (portal)", "Wynagrodzenie",
                   "Lokalizacja / forma", "CV wysłane", "Status", "Data kontaktu / rozmowy", "Duplikat?", "Notatki"]
TRACKER = T.StructType(
    [T.StructField("run_tab", S), T.StructField("id", L)]
    + [T.StructField(c, S) for c in TRACKER_COLUMNS[1:]]
)

# Tracker vocabularies (allowed drop-down values per column).
VOCAB = {
    "place_form": ["Zdalnie", "Hybrydowo", "Biuro - Wrocław", "Biuro - poza Wrocławiem", "Niejasne"],
    "cv_sent": ["Techniczne", "Fizyczne/usługowe", "Marketingowe", "Nie wysłane"],
    "status": ["Do wysłania", "Wysłane", "Brak odpowiedzi", "Odpowiedź - kontakt", "Rozmowa zaplanowana",
               "Po rozmowie", "Oferta!", "Odmowa", "Wycofałem się", "Przeterminowane"],
}
DEFAULT_CV_SENT = "Nie wysłane"
DEFAULT_STATUS = "Do wysłania"

RUN_STATUS = T.StructType([
    T.StructField("run_id", S), T.StructField("source", S), T.StructField("count", L),
    T.StructField("blocked", B), T.StructField("details_fetched", L), T.StructField("details_cached", L),
    T.StructField("detail_errors", L), T.StructField("detail_aborted", B),
])
