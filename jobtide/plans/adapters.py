"""Offer-shaped inputs derived from the driver tables.

Each adapter is one SQL SELECT over the landed tables, written in the dialect
subset that Spark SQL and DuckDB share, so the Spark query and its DuckDB oracle
start from literally the same rows.  Table names are placeholders: Spark reads
``parquet.`<dir>/<table>.parquet``` directly, DuckDB uses the registered views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

ADAPTERS: dict[str, str] = {}

# Landed list rows: one offer per event; source = event type, list position = event id.
ADAPTERS["offers_ev"] = """
SELECT 'R1' AS run_id,
       event_type AS source,
       event_id AS position,
       'U' || CAST(user_id AS STRING) AS company,
       'Offer ' || event_type || ' ' || CAST(user_id AS STRING) AS title,
       'https://Ex.pl/O/' || CAST(user_id AS STRING) || '/?e=' || CAST(event_id AS STRING) AS url,
       CASE user_id % 3 WHEN 0 THEN 'Wrocław' WHEN 1 THEN 'Opole' END AS city,
       value AS salary_from,
       CASE WHEN event_type IN ('click', 'purchase') THEN value * 2 END AS salary_to,
       CASE WHEN user_id % 2 = 0 THEN 'PLN' END AS salary_currency,
       event_type = 'view' AS remote,
       CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '  ' END AS description,
       ts AS landed_at
FROM {events}
"""

# Detail attempts: source = user, position = event id; status 0 = transport failure.
ADAPTERS["attempts_ev"] = """
SELECT 'R1' AS run_id,
       'u' || CAST(user_id AS STRING) AS source,
       event_id AS position,
       'https://ex.pl/d/' || CAST(user_id AS STRING) || '/' || CAST(event_id % 7 AS STRING) AS url,
       CASE WHEN event_type = 'error' THEN 0 WHEN value > 150 THEN 403 ELSE 200 END AS status,
       CASE WHEN event_type = 'purchase' THEN '' ELSE 'desc ' || props END AS body,
       event_type = 'signup' AND value < 50 AS cache_hit,
       event_type = 'click' AND value < 20 AS no_slug
FROM {events}
"""

# Description cache entries keyed by user; old vs new slice by event id parity.
ADAPTERS["cache_ev"] = """
SELECT 'https://ex.pl/c/' || CAST(user_id AS STRING) AS url_key,
       ts AS fetched_at,
       event_id % 2 AS slice,
       event_id,
       CASE WHEN event_type = 'error' THEN '' ELSE event_type || ' ' || props END AS description
FROM {events}
"""

# Salary texts in spaced-thousands / range / one-sided variants.
ADAPTERS["salary_or"] = """
SELECT o_orderkey AS id,
       CASE o_orderkey % 4
         WHEN 0 THEN 'od ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' do '
                     || CAST(CAST(floor(o_totalprice * 1.2) AS BIGINT) AS STRING) || ' zł'
         WHEN 1 THEN CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || ' '
                     || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0') || ' PLN / mies.'
         WHEN 2 THEN 'do ' || CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS STRING) || ',50 zł'
         ELSE CASE WHEN o_orderstatus = 'F' THEN 'Do negocjacji'
                   ELSE CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || ' k EUR' END
       END AS text
FROM {orders}
"""

# Tracker history: one run tab per order month, status vocabulary from order status.
ADAPTERS["tracker_or"] = """
SELECT o_orderkey AS id,
       '01.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '.' || CAST(year(o_orderdate) AS STRING) || ' 10-00' AS run_tab,
       o_orderdate AS started_at,
       'https://ex.pl/o/' || CAST(o_custkey AS STRING) AS url,
       'C' || CAST(o_custkey AS STRING) AS company,
       o_orderpriority AS title,
       CASE o_orderstatus WHEN 'F' THEN 'Wysłane' WHEN 'O' THEN 'Do wysłania' ELSE 'Odmowaa' END AS status,
       CASE WHEN o_orderkey % 5 = 0 THEN 'Hybrydowo' WHEN o_orderkey % 5 = 1 THEN 'Biuro' ELSE 'Zdalnie' END AS place_form,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Techniczne' ELSE 'Nie wysłane' END AS cv_sent,
       o_totalprice AS totalprice
FROM {orders}
"""

# Documents with an optional cached description (hit where a label exists).
ADAPTERS["descr_doc"] = """
SELECT d.doc_id AS position,
       d.source AS source,
       'https://docs.ex/' || d.lang || '/' || CAST(d.doc_id AS STRING) AS url,
       d.text AS text,
       d.lang AS lang,
       l.doc_id IS NOT NULL AS hit,
       l.quality AS quality,
       l.toxic AS toxic
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

# Phrases prefixed to document text by doc_id % 12 (classifier coverage).
TEXT_PHRASES = ["Staż", "stażysta", "Umowa o pracę", "B2B", "umowa zlecenie", "Senior", "młodszy", "Team Lead",
                "praca zdalna", "praca stacjonarna", "praktykant", ""]

ADAPTERS["text_doc"] = """
SELECT doc_id,
       source,
       lang,
       CASE doc_id % 12 {phrase_cases} END || ' ' || text AS text,
       CASE doc_id % 12 {phrase_cases} END || ' ' || lang || ' ' || source AS title
FROM {documents}
""".replace("{phrase_cases}", " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(TEXT_PHRASES)))

# Detail bodies with block needles inside or outside the profile windows.
ADAPTERS["body_doc"] = """
SELECT doc_id,
       CASE doc_id % 3 WHEN 0 THEN 'captcha' WHEN 1 THEN 'Access Denied' ELSE '' END AS needle,
       CASE WHEN doc_id % 2 = 0
            THEN (CASE doc_id % 3 WHEN 0 THEN 'captcha' WHEN 1 THEN 'Access Denied' ELSE '' END) || ' ' || text
            ELSE text || ' ' || (CASE doc_id % 3 WHEN 0 THEN 'captcha' WHEN 1 THEN 'Access Denied' ELSE '' END) END AS body,
       CASE WHEN doc_id % 11 = 0 THEN 429 WHEN doc_id % 13 = 0 THEN 500 ELSE 200 END AS status
FROM {documents}
"""

ADAPTERS["html_pg"] = """
SELECT page_id, url, html FROM {pages}
"""

# Pages carrying a synthetic JSON-LD block built from the document with the same id.
ADAPTERS["jsonld_pg"] = """
SELECT p.page_id,
       p.url,
       CASE WHEN d.doc_id IS NULL THEN p.html
            ELSE p.html || '<script type="application/ld+json">{{"@type": "'
                 || CASE WHEN d.doc_id % 3 = 0 THEN 'Organization' ELSE 'JobPosting' END
                 || '", "title": "' || d.source || '", "validThrough": "2024-0' || CAST(1 + d.doc_id % 9 AS STRING)
                 || '-01", "description": "<p>' || d.lang || ' ' || CAST(d.n_chars AS STRING) || '</p>"}}</script>'
       END AS html,
       d.doc_id IS NOT NULL AS has_ld
FROM {pages} p LEFT JOIN {documents} d ON p.page_id = d.doc_id
"""

ADAPTERS["place_na"] = """
SELECT n_nationkey AS id,
       '52-407 ' || n_name AS loc,
       n_name || ' - ' || CAST(n_nationkey AS STRING) AS place_date,
       n_name || ', Region ' || CAST(n_regionkey AS STRING) AS city_raw,
       n_name AS name,
       n_regionkey AS regionkey
FROM {nation}
"""

# Landed list pages: one page response per event; source from the user, pages 1..3.
ADAPTERS["pages_ev"] = """
SELECT 'R' || lpad(CAST(day(ts) AS STRING), 2, '0') AS run_id,
       CASE user_id % 8 WHEN 0 THEN 'justjoin' WHEN 1 THEN 'rocketjobs' WHEN 2 THEN 'nofluffjobs'
            WHEN 3 THEN 'talentdays' WHEN 4 THEN 'pracuj' WHEN 5 THEN 'theprotocol' WHEN 6 THEN 'olx'
            ELSE 'indeed' END AS source,
       CAST(event_id % 3 + 1 AS INT) AS page_no,
       event_id AS position,
       CASE WHEN event_type = 'error' AND value > 400 THEN 403 WHEN value > 485 THEN 503 ELSE 200 END AS status,
       CASE WHEN event_type = 'signup' THEN 'Brak wyników dla ' || props
            WHEN event_type = 'error' AND value < 3 THEN 'Just a moment...' ELSE props END AS text,
       CASE WHEN event_type IN ('click', 'view') AND value > 300 THEN 1 ELSE 0 END AS n_offers
FROM {events}
"""

# Indeed-style card rows derived from events.
ADAPTERS["cards_ev"] = """
SELECT event_id AS position,
       CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Senior Analyst ' || event_type
            WHEN 2 THEN 'Junior Developer (staż)' WHEN 3 THEN 'Team Lead ' || CAST(user_id AS STRING)
            ELSE 'Stażysta w dziale IT' END AS title,
       CASE event_id % 3 WHEN 0 THEN 'a' || CAST(event_id AS STRING) WHEN 1 THEN NULL ELSE '' END AS jk,
       CASE event_id % 4 WHEN 0 THEN '/rc/clk?jk=b' || CAST(user_id AS STRING) || '&from=x'
            WHEN 1 THEN '/pagead/' || CAST(event_id AS STRING)
            WHEN 2 THEN 'https://pl.indeed.com/job/' || CAST(event_id AS STRING) ELSE NULL END AS href,
       'U' || CAST(user_id AS STRING) AS company,
       CASE user_id % 3 WHEN 0 THEN '52-407 Wrocław' WHEN 1 THEN 'Opole' END AS loc,
       CASE event_type WHEN 'click' THEN 'od ' || CAST(user_id * 100 AS STRING) || ' zł'
            WHEN 'view' THEN CAST(user_id * 10 AS STRING) || ' 000 zł – ' || CAST(user_id * 12 AS STRING) || ' 000 zł'
            WHEN 'purchase' THEN 'do 8 000 PLN' ELSE '40 godz.' END AS salaryText,
       CASE event_id % 4 WHEN 0 THEN 'Umowa o pracę, B2B' WHEN 1 THEN 'kontrakt B2B' WHEN 2 THEN 'umowa zlecenie'
            ELSE 'Pełny etat' END AS metaText,
       CASE WHEN event_type = 'view' THEN 'Praca zdalna' WHEN event_type = 'click' THEN 'remote-first team' ELSE '' END
         AS cardText,
       CASE WHEN event_id % 2 = 0 THEN 'Dzisiaj' END AS publishedAt
FROM {events}
"""


def _spark_tables(sf_dir: str) -> dict[str, str]:
    d = sf_dir.rstrip("/")
    return {t: f"parquet.`{d}/{t}.parquet`" for t in TABLES}


def adapter_sql(name: str) -> str:
    """Adapter SELECT for DuckDB (views already registered under the table names)."""
    return ADAPTERS[name].format(**{t: t for t in TABLES}).strip()


def _tables_of(name: str) -> list[str]:
    sql = ADAPTERS[name]
    return [t for t in TABLES if "{" + t + "}" in sql]


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Adapter as a Spark DataFrame read straight from the parquet tables.  When the base
    scans yield fewer splits than the cluster has cores, the rows are spread before the
    (often regex-heavy) per-row work; on large inputs nothing is added."""
    from jobtide.session import spread
    df = spark.sql(ADAPTERS[name].format(**_spark_tables(sf_dir)))
    splits = max(table(spark, sf_dir, t).rdd.getNumPartitions() for t in _tables_of(name))
    return spread(df, scan_partitions=splits)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

# Conversation turns as list items (one item per turn, grouped per conversation).
ADAPTERS["turns_cv"] = """
SELECT conv_id, turn, role, text,
       text AS title,
       CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS company,
       CASE WHEN turn % 5 = 4 THEN NULL ELSE 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) END AS slug,
       CASE WHEN turn % 2 = 0 THEN 'Wrocław' END AS city,
       CASE WHEN turn % 4 = 3 THEN NULL ELSE CAST(turn * 1000 AS DOUBLE) END AS sal_from,
       CASE WHEN turn % 4 = 2 THEN CAST(turn * 1500 AS DOUBLE) END AS sal_to,
       CASE WHEN turn % 2 = 0 THEN '2024-02-01' END AS published,
       CASE WHEN turn % 3 = 0 THEN 'remote' ELSE 'office' END AS workplace,
       role || ' ' || CAST(turn AS STRING) AS label
FROM {conversations}
"""

# Landed detail responses for the documents (HTML bodies; some blocked or failing).
ADAPTERS["detail_doc"] = """
SELECT 'R1' AS run_id,
       source,
       doc_id AS position,
       'https://justjoin.it/job-offer/' || lang || '-' || CAST(doc_id % 300 AS STRING) AS url,
       CASE WHEN doc_id % 97 = 0 THEN 403 WHEN doc_id % 13 = 0 THEN 500 ELSE 200 END AS status,
       CASE WHEN doc_id % 211 = 0 THEN '<title>Just a moment...</title> captcha'
            WHEN doc_id % 17 = 0 THEN '<p> </p>'
            ELSE '<h2>Opis</h2><p>' || text || ' wiek <3 lata, Kr&oacute;l &Oacute; &lt;b&gt;</p><ul><li>' || lang || '</li></ul>' END AS body
FROM {documents}
"""
