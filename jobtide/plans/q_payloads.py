"""Payload ingestion over conversations and pages.

Per-conversation documents are built with bounded groups (one conversation) and
parsed back through the same readers the landed files use."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.functions.classify import CONTRACT_LABEL_RE, EXPERIENCE_LABEL_RE
from jobtide.functions.common import first_nonblank
from jobtide.functions.html import html_to_text
from jobtide.functions.jsonx import embedded_skill_list, list_values
from jobtide.functions.text import clean_city, compose_sections, format_skills, split_place_date
from jobtide.functions.urls import ad_id_from_url
from jobtide.operators.mapping import require, to_common
from jobtide.operators.positional import concat_lists, first_nonempty
from jobtide.plans import sqlx
from jobtide.plans.adapters import adapter
from jobtide.plans.registry import query
from jobtide.schema import OFFER, SOURCES
from jobtide.sources.landing import explode_collect, ingest_board_api, ingest_cards, ingest_items, ingest_postings
from jobtide.sources.pages import extract_jsonld, harvest_links, harvest_offers, ingest_embedded, jsonld

_RN = "CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT)"


def _per_conv(df, item, name="items"):
    """Per-conversation ordered array of ``item`` (bounded: one conversation's turns)."""
    return df.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("turn"), item.alias("x")))), lambda s: s["x"]).alias(name))


# ---------------------------------------------------------------- A1

@query("q_collect_explode", sql=f"""
SELECT conv_id, position, _src, title, url, company FROM (
  SELECT conv_id, {_RN} AS position,
         coalesce(nullif(CASE WHEN turn % 2 = 0 THEN NULL ELSE 'src-' || role END, ''),
                  CASE conv_id % 8 {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCES))} END) AS _src,
         title, 'https://ex.pl/c/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS url,
         nullif(company, '') AS company
  FROM {{{{turns_cv}}}}) WHERE conv_id % 7 <> 0""")
def q_collect_explode(spark, sf):
    t = adapter(spark, sf, "turns_cv")
    offer = F.struct(*[
        (F.when(F.col("turn") % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("src-"), "role")) if f.name == "source"
         else F.col("title") if f.name == "title"
         else F.concat(F.lit("https://ex.pl/c/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
         if f.name == "url" else F.nullif(F.col("company"), F.lit("")) if f.name == "company"
         else F.lit(None)).cast(f.dataType).alias(f.name) for f in OFFER.fields])
    docs = _per_conv(t, offer, "offers")
    src = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("conv_id") % 8 + 1).cast("int"))
    docs = docs.select("conv_id", src.alias("source"), F.size("offers").cast("bigint").alias("count"),
                       F.when(F.col("conv_id") % 7 != 0, F.col("offers")).alias("offers"))
    out = explode_collect(docs)
    return out.select("conv_id", F.col("position").cast("bigint").alias("position"), "_src", "title", "url", "company")


# ---------------------------------------------------------------- A2

@query("q_ingest_nested", sql=f"""
SELECT * FROM (
  SELECT conv_id, {_RN} AS position, 'justjoin' AS source, nullif(company, '') AS company, nullif(title, '') AS title,
         CASE WHEN nullif(slug, '') IS NOT NULL THEN 'https://justjoin.it/job-offer/' || slug END AS url,
         coalesce(nullif(city, ''), 'Kraków') AS city,
         CASE WHEN turn % 4 = 3 THEN NULL ELSE sal_from END AS salary_from,
         CASE WHEN turn % 4 = 3 THEN NULL ELSE sal_to END AS salary_to,
         CASE WHEN turn % 4 = 3 THEN NULL ELSE 'PLN' END AS salary_currency,
         CASE WHEN turn % 4 = 3 THEN NULL ELSE 'b2b' END AS contract_type,
         nullif(role, '') AS experience_level, published AS published_at, workplace = 'remote' AS remote
  FROM {{{{turns_cv}}}}) WHERE url IS NOT NULL""")
def q_ingest_nested(spark, sf):
    t = adapter(spark, sf, "turns_cv")
    et = F.when(F.col("turn") % 4 == 3, F.array().cast("array<struct<from:double,to:double,currency:string,type:string>>")) \
        .otherwise(F.array(F.struct(F.col("sal_from").alias("from"), F.col("sal_to").alias("to"),
                                    F.lit("PLN").alias("currency"), F.lit("b2b").alias("type"))))
    item = F.struct(F.col("company").alias("companyName"), "title", "slug", "city",
                    F.array(F.struct(F.lit("Kraków").alias("city"))).alias("multilocation"),
                    et.alias("employmentTypes"), F.col("role").alias("experienceLevel"),
                    F.col("published").alias("publishedAt"), F.col("workplace").alias("workplaceType"))
    docs = _per_conv(t, item, "data")
    # Even conversations land as {data, meta}, odd ones as a bare array.
    payload = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct("data", F.create_map(F.lit("n"), F.lit("1")).alias("meta")))) \
        .otherwise(F.to_json("data"))
    landing = docs.select("conv_id", payload.alias("payload"))
    items = ingest_board_api(landing).withColumnRenamed("item_pos", "position")
    out = require(to_common(items, "justjoin", keep=("conv_id", "position")))
    return out.select("conv_id", F.col("position").cast("bigint").alias("position"), "source", "company", "title", "url",
                      "city", "salary_from", "salary_to", "salary_currency", "contract_type", "experience_level",
                      "published_at", "remote")


# ---------------------------------------------------------------- A3/A4

def _nfj_item_json():
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    tag = F.concat(F.lit("c"), conv, F.lit("-"), turn.cast("string"))
    linkj = (F.when(turn % 3 == 0, F.to_json(F.struct(F.concat(F.lit("https://nofluffjobs.com/pl/job/"), tag).alias("url"))))
             .when(turn % 3 == 1, F.to_json(F.struct(tag.alias("slug"))))
             .otherwise(F.to_json(F.struct(F.concat(F.lit("/pl/job/"), tag).alias("url")))))
    places = F.when(turn % 2 == 0, F.array(F.struct(F.lit("").alias("city")), F.struct(F.lit("Gdańsk").alias("city"))))\
        .otherwise(F.array().cast("array<struct<city:string>>"))
    loc = F.struct((turn % 4 == 0).alias("fullyRemote"), places.alias("places"))
    sal_obj = F.to_json(F.struct((turn * 1000).alias("from"), (turn * 1200).alias("to"), F.lit("PLN").alias("currency"),
                                 F.lit("b2b").alias("type")))
    sal_arr = F.to_json(F.array(F.struct(F.lit("5000").alias("from"), F.lit("EUR").alias("currency"),
                                         F.lit("permanent").alias("type"))))
    sen = (F.when(turn % 3 == 0, F.to_json(F.array(F.lit("Junior"), F.lit("Mid"))))
           .when(turn % 3 == 1, F.lit('"Trainee"')).otherwise(F.lit("[]")))
    dates = F.when(turn % 2 == 0, F.concat(F.lit('"posted": '), (F.lit(1704067200000) + turn * 86400000).cast("string"))) \
        .otherwise(F.lit('"renewed": 1706745600'))
    base = F.to_json(F.struct(F.col("text").alias("title"), F.col("role").alias("name"), loc.alias("location")))
    # Splice the heterogeneous members (object-or-array salary, array-or-string seniority) into the object text.
    obj = F.regexp_replace(base, r"\}$", "")
    link_members = F.regexp_replace(F.regexp_replace(linkj, r"^\{", ""), r"\}$", "")
    return F.concat(obj, F.lit(", "), link_members,
                    F.lit(', "salary": '), F.when(turn % 2 == 0, sal_obj).otherwise(sal_arr),
                    F.lit(', "seniority": '), sen, F.lit(", "), dates, F.lit("}"))


@query("q_variant_postings", sql=f"""
SELECT * FROM (
  SELECT conv_id, {_RN} AS position, 'nofluffjobs' AS source, nullif({sqlx.js_trim('role')}, '') AS company,
         nullif({sqlx.js_trim('text')}, '') AS title,
         CASE turn % 3 WHEN 0 THEN 'https://nofluffjobs.com/pl/job/c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)
              WHEN 1 THEN 'https://nofluffjobs.com/pl/job/c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)
              ELSE 'https://nofluffjobs.com/pl/job/c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS url,
         CASE WHEN turn % 2 = 0 THEN 'Gdańsk' WHEN turn % 4 = 0 THEN 'Remote' END AS city,
         CASE WHEN turn % 2 = 0 THEN CAST(turn * 1000 AS DOUBLE) END AS salary_from,
         CASE WHEN turn % 2 = 0 THEN CAST(turn * 1200 AS DOUBLE) END AS salary_to,
         CASE WHEN turn % 2 = 0 THEN 'PLN' ELSE 'EUR' END AS salary_currency,
         CASE WHEN turn % 2 = 0 THEN 'b2b' ELSE 'permanent' END AS contract_type,
         CASE turn % 3 WHEN 0 THEN 'Junior, Mid' WHEN 1 THEN 'Trainee' END AS experience_level,
         strftime(CASE WHEN turn % 2 = 0 THEN make_timestamp((1704067200000 + turn * 86400000) * 1000)
                       ELSE make_timestamp(1706745600000 * 1000) END, '%Y-%m-%dT%H:%M:%S.%gZ') AS published_at,
         turn % 4 = 0 AS remote
  FROM (SELECT *, bool_and(text IS NOT NULL AND (role IS NOT NULL OR turn % 3 <> 1)) OVER (PARTITION BY conv_id) AS whole
        FROM conversations) WHERE whole OR conv_id % 6 IN (0, 5))
WHERE title IS NOT NULL OR url IS NOT NULL""")
def q_variant_postings(spark, sf):
    """A3: payloads of six shapes, some with arrays that must not be taken; away from ``postings`` an array counts only
    if all its elements are postings."""
    t = adapter(spark, sf, "turns_cv")
    docs = _per_conv(t, _nfj_item_json(), "items")
    arr = F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]"))
    k = F.col("conv_id") % 6
    payload = (F.when(k == 0, F.concat(F.lit('{"postings": '), arr, F.lit("}")))
               .when(k == 1, F.concat(F.lit('{"json": {"data": '), arr, F.lit("}}")))
               .when(k == 2, F.concat(F.lit('{"meta": {"pages": [1, 2]}, "result": {"data": '), arr, F.lit("}}")))
               .when(k == 3, F.concat(F.lit('{"data": [{"id": 1}, {"id": 2}], "state": {"x": {"list": '), arr, F.lit("}}}")))
               .when(k == 4, F.concat(F.lit('[[], [{"title": "t"}, 5], "postings", ['), arr, F.lit("]]")))
               .otherwise(F.concat(F.lit('{"a": [{"title": "t"}], "z": {"postings": '), arr, F.lit("}}"))))
    items = ingest_postings(docs.select("conv_id", payload.alias("payload"))).withColumnRenamed("item_pos", "position")
    out = require(to_common(items, "nofluffjobs", keep=("conv_id", "position")))
    return out.select("conv_id", F.col("position").cast("bigint").alias("position"), "source", "company", "title", "url",
                      "city", "salary_from", "salary_to", "salary_currency", "contract_type", "experience_level",
                      "published_at", "remote")


# ---------------------------------------------------------------- I11, H2, I13, I10

@query("q_list_values", sql="""
SELECT conv_id, string_agg(label, '|' ORDER BY turn) AS vals FROM {{turns_cv}} WHERE turn % 4 <> 0 GROUP BY conv_id""")
def q_list_values(spark, sf):
    t = adapter(spark, sf, "turns_cv")
    lab = F.when(F.col("turn") % 4 == 0, F.lit("  ")).otherwise(F.col("label"))
    kind = F.col("conv_id") % 3
    el = (F.when(kind == 0, F.to_json(F.array(lab)))
          .when(F.col("turn") % 3 == 0, F.to_json(F.array(F.struct(lab.alias("value")))))
          .when(F.col("turn") % 3 == 1, F.to_json(F.array(F.struct(F.lit(None).cast("string").alias("value"), lab.alias("name")))))
          .otherwise(F.to_json(F.array(F.struct(lab.alias("code"))))))
    docs = _per_conv(t, F.regexp_replace(F.regexp_replace(el, r"^\[", ""), r"\]$", ""), "els")
    arr = F.concat(F.lit("["), F.array_join("els", ", "), F.lit("]"))
    doc = F.when(kind == 1, F.concat(F.lit('{"items": '), arr, F.lit("}"))).otherwise(arr)
    vals = list_values(F.try_parse_json(doc))
    return docs.select("conv_id", F.when(F.size(vals) > 0, F.array_join(vals, "|")).alias("vals")).where("vals IS NOT NULL")


@query("q_concat_lists", sql="""
WITH g AS (SELECT conv_id, list(label ORDER BY turn) FILTER (WHERE role = 'user') AS benefits,
                  CASE WHEN conv_id % 2 = 0 THEN NULL ELSE list(label ORDER BY turn) FILTER (WHERE role <> 'user') END AS equipment,
                  CASE WHEN conv_id % 3 = 0 THEN ['kawa'] END AS perks
           FROM {{turns_cv}} GROUP BY conv_id)
SELECT conv_id, array_to_string(list_concat(list_concat(coalesce(benefits, []), coalesce(equipment, [])), coalesce(perks, [])), '|')
         AS items,
       CAST(len(list_concat(list_concat(coalesce(benefits, []), coalesce(equipment, [])), coalesce(perks, []))) AS INTEGER) AS n
FROM g""")
def q_concat_lists(spark, sf):
    t = adapter(spark, sf, "turns_cv")
    g = t.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "label")))).alias("u"),
        F.sort_array(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "label")))).alias("o"))
    g = g.select("conv_id",
                 F.transform("u", lambda s: s["label"]).alias("benefits"),
                 F.when(F.col("conv_id") % 2 == 0, F.lit(None)).otherwise(F.transform("o", lambda s: s["label"])).alias("equipment"),
                 F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("kawa"))).alias("perks"))
    c = concat_lists("benefits", "equipment", "perks")
    return g.select("conv_id", F.array_join(c, "|").alias("items"), F.size(c).alias("n"))


@query("q_skills", sql="""
SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN label || ' (level ' || CAST(turn AS VARCHAR) || ')' ELSE label END, '|'
                           ORDER BY turn) AS skills_required
FROM {{turns_cv}} WHERE turn % 5 <> 0 GROUP BY conv_id""")
def q_skills(spark, sf):
    t = adapter(spark, sf, "turns_cv")
    name = F.when(F.col("turn") % 5 == 0, F.lit("")).otherwise(F.col("label"))
    item = F.to_json(F.struct(name.alias("name"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("level")))
    docs = _per_conv(t, F.replace(item, F.lit('"'), F.lit('\\"')), "items")
    payload = F.concat(F.lit('self.__next_f.push([1,"{\\"id\\":1,\\"requiredSkills\\":['), F.array_join("items", ","),
                       F.lit('],\\"niceToHaveSkills\\":[]}"])'))
    sk = format_skills(embedded_skill_list(payload, "requiredSkills"))
    return docs.select("conv_id", F.array_join(sk, "|").alias("skills_required")).where("skills_required IS NOT NULL")


def _all_turns():
    """The texts of all turns in order, a paragraph each."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("p"))))
    return F.array_join(F.transform(turns, lambda s: s["p"]), "")


def _sections_sql():
    bul = "array_to_string(list_transform({x}, lambda z: '- ' || z), chr(10))"
    desc = f"nullif({sqlx.js_trim('d')}, '')"
    req = ("nullif(concat_ws(chr(10), CASE WHEN len(musts) > 0 THEN " + bul.format(x="musts") + " END, "
           "CASE WHEN len(langs) > 0 THEN 'Języki: ' || array_to_string(langs, ', ') END), '')")
    nice = "CASE WHEN len(nices) > 0 THEN " + bul.format(x="nices") + " END"
    tasks = "CASE WHEN len(resp) > 0 THEN " + bul.format(x="resp") + " END"
    ben = "CASE WHEN len(ben) > 0 THEN " + bul.format(x="ben") + " END"
    parts = ", ".join(f"CASE WHEN ({b}) IS NOT NULL THEN '{lab}' || chr(10) || ({b}) END"
                      for lab, b in zip(["OPIS:", "WYMAGANIA:", "MILE WIDZIANE:", "OBOWIĄZKI:", "BENEFITY:"],
                                        [desc, req, nice, tasks, ben]))
    joined = f"concat_ws(chr(10) || chr(10), {parts})"
    final = f"nullif({sqlx.js_trim(sqlx.sub(joined, "\n{3,}", "\n\n"))}, '')"
    return f"""
WITH g AS (SELECT conv_id, {sqlx.html_text("string_agg('<p>' || text || '</p>', '' ORDER BY turn)", 'nofluffjobs')} AS d,
                  coalesce(list(label ORDER BY turn) FILTER (WHERE role = 'user'), []) AS musts,
                  CASE WHEN conv_id % 2 = 0 THEN ['polski', 'angielski'] ELSE [] END AS langs,
                  CASE WHEN conv_id % 3 <> 0 THEN coalesce(list(label ORDER BY turn) FILTER (WHERE role <> 'user'), [])
                       ELSE [] END AS nices,
                  coalesce(list('task ' || CAST(turn AS VARCHAR) ORDER BY turn) FILTER (WHERE turn % 3 = 0), []) AS resp,
                  CASE WHEN conv_id % 4 = 0 THEN ['kawa'] ELSE [] END AS ben
           FROM {{{{turns_cv}}}} GROUP BY conv_id)
SELECT conv_id, {final} AS description FROM g"""


@query("q_sections", sql=_sections_sql())
def q_sections(spark, sf):
    t = adapter(spark, sf, "turns_cv")
    lab = lambda s: s["label"]
    g = t.groupBy("conv_id").agg(
        _all_turns().alias("d"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "label")))).alias("u"),
        F.sort_array(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "label")))).alias("o"),
        F.sort_array(F.collect_list(F.when(F.col("turn") % 3 == 0, F.struct(
            "turn", F.concat(F.lit("task "), F.col("turn").cast("string")).alias("label"))))).alias("r"))
    empty = F.array().cast("array<string>")
    desc = compose_sections(
        html_to_text("d", "nofluffjobs"), F.transform("u", lab),
        F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("polski"), F.lit("angielski"))).otherwise(empty),
        F.when(F.col("conv_id") % 3 != 0, F.transform("o", lab)).otherwise(empty),
        empty, F.transform("r", lab),
        concat_lists(F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("kawa")))))
    return g.select("conv_id", desc.alias("description"))


# ---------------------------------------------------------------- A5, A7 cards

@query("q_cards_min", sql=f"""
WITH c AS (SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 5 = 0 THEN '  ' ELSE name END AS title,
                  '/oferta/praca/' || lower(name) || '-CID4-ID' || CAST(100000 + id * 37 AS VARCHAR) || '.html' AS url,
                  nullif({sqlx.js_trim("split_part(place_date, ' - ', 1)")}, '') AS city,
                  CASE WHEN position(' - ' IN place_date) > 0
                       THEN {sqlx.js_trim("substr(place_date, position(' - ' IN place_date) + 3)")} END AS dateText,
                  CASE id % 3 WHEN 0 THEN '4 000 - 5 000 zł / mies.' WHEN 1 THEN '4.500 zł' ELSE 'Do negocjacji' END AS salaryRaw
           FROM {{{{place_na}}}})
SELECT CAST(id AS BIGINT) AS id, title, 'https://www.olx.pl' || url AS url, city, dateText AS published_at,
       {sqlx.salary('salaryRaw', 'olx')[0]} AS salary_from, {sqlx.salary('salaryRaw', 'olx')[1]} AS salary_to,
       {sqlx.salary('salaryRaw', 'olx')[2]} AS salary_currency,
       regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(city, '')), 'zdaln|remote') AS remote,
       regexp_extract(url, '(\\d{{6,}})', 1) AS ad_id
FROM c WHERE length(trim(title)) > 0""")
def q_cards_min(spark, sf):
    p = adapter(spark, sf, "place_na")
    cards = p.select(F.col("id").cast("string").alias("id"),
                     F.when(F.col("id") % 5 == 0, F.lit("  ")).otherwise(F.col("name")).alias("title"),
                     F.concat(F.lit("/oferta/praca/"), F.lower("name"), F.lit("-CID4-ID"),
                              (F.lit(100000) + F.col("id") * 37).cast("string"), F.lit(".html")).alias("url"),
                     clean_city("place_date", "before_dash").alias("city"),
                     split_place_date("place_date").alias("dateText"),
                     F.when(F.col("id") % 3 == 0, F.lit("4 000 - 5 000 zł / mies."))
                     .when(F.col("id") % 3 == 1, F.lit("4.500 zł")).otherwise(F.lit("Do negocjacji")).alias("salaryRaw"))
    rows = ingest_cards(cards, "olx")
    out = to_common(rows, "olx", keep=("id",))
    return out.select(F.col("id").cast("bigint").alias("id"), "title", "url", "city", "published_at", "salary_from",
                      "salary_to", "salary_currency", "remote", ad_id_from_url("url").alias("ad_id"))


_TP_CARDS_SQL = """SELECT conv_id, turn,
  CASE WHEN turn % 6 = 5 THEN NULL ELSE 'https://theprotocol.it/szczegoly/praca/c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS href,
  coalesce(nullif({t1}, ''), nullif({t2}, '')) AS title,
  coalesce(nullif({c1}, ''), nullif({c2}, '')) AS company,
  CASE turn % 4 WHEN 0 THEN 'Kraków, Warszawa' WHEN 1 THEN 'Wrocław' || chr(10) || 'zdalnie' WHEN 2 THEN ', Gdańsk' END AS cityRaw,
  CASE turn % 3 WHEN 0 THEN '160 - 200 zł/h' WHEN 1 THEN '12,5 k zł' ELSE '20 000 USD' END AS salaryRaw,
  CASE WHEN turn % 2 = 0 THEN 'Junior' END AS levelRaw,
  CASE turn % 3 WHEN 0 THEN 'Praca zdalna' WHEN 1 THEN 'hybrydowa' END AS workModeRaw,
  'B2B' AS contractRaw,
  CASE turn % 3 WHEN 0 THEN '2024-03-0' || CAST(turn % 9 + 1 AS VARCHAR) WHEN 1 THEN 'wczoraj' END AS dateRaw
FROM {{turns_cv}}""".replace(
    "{t1}", sqlx.js_trim("CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END")).replace(
    "{t2}", sqlx.js_trim("role")).replace("{c1}", sqlx.js_trim("CASE WHEN turn % 2 = 0 THEN '' END")).replace(
    "{c2}", sqlx.js_trim("'Firma ' || CAST(conv_id AS VARCHAR)"))

_TP_F, _TP_T, _TP_C = sqlx.salary("salaryRaw", "theprotocol")
_TP_CITY = sqlx.js_trim("string_split_regex(cityRaw, '[,\\n]')[1]")


@query("q_coalesce_candidates", sql=f"""
SELECT conv_id, CAST(turn AS BIGINT) AS turn, nullif(company, '') AS company, nullif(title, '') AS title, href AS url,
  CASE WHEN nullif(cityRaw, '') IS NOT NULL THEN CASE WHEN {_TP_CITY} <> '' THEN {_TP_CITY}
       ELSE nullif({sqlx.js_trim('cityRaw')}, '') END END AS city,
  {_TP_F} AS salary_from, {_TP_T} AS salary_to, {_TP_C} AS salary_currency, contractRaw AS contract_type,
  nullif(levelRaw, '') AS experience_level,
  CASE WHEN nullif(dateRaw, '') IS NOT NULL THEN coalesce(strftime(try_strptime(dateRaw, '%Y-%m-%d'), '%Y-%m-%dT%H:%M:%S.%gZ'),
       dateRaw) END AS published_at,
  CASE WHEN regexp_matches(lower(coalesce(workModeRaw, '') || ' ' || coalesce(cityRaw, '')), 'zdaln|remote') THEN true END AS remote
FROM ({_TP_CARDS_SQL}) WHERE coalesce(length(href) > 0, false)""")
def q_coalesce_candidates(spark, sf):
    t = adapter(spark, sf, "turns_cv")
    turn = F.col("turn")
    cards = t.select(
        "conv_id", "turn",
        F.when(turn % 6 == 5, F.lit(None)).otherwise(F.concat(F.lit("https://theprotocol.it/szczegoly/praca/c"),
                                                              F.col("conv_id").cast("string"), F.lit("-"),
                                                              turn.cast("string"))).alias("href"),
        first_nonblank(F.when(turn % 3 == 0, F.lit("  ")).otherwise(F.col("text")), "role").alias("title"),
        first_nonblank(F.when(turn % 2 == 0, F.lit("")), F.concat(F.lit("Firma "), F.col("conv_id").cast("string"))).alias("company"),
        F.when(turn % 4 == 0, F.lit("Kraków, Warszawa")).when(turn % 4 == 1, F.lit("Wrocław\nzdalnie"))
        .when(turn % 4 == 2, F.lit(", Gdańsk")).alias("cityRaw"),
        F.when(turn % 3 == 0, F.lit("160 - 200 zł/h")).when(turn % 3 == 1, F.lit("12,5 k zł"))
        .otherwise(F.lit("20 000 USD")).alias("salaryRaw"),
        F.when(turn % 2 == 0, F.lit("Junior")).alias("levelRaw"),
        F.when(turn % 3 == 0, F.lit("Praca zdalna")).when(turn % 3 == 1, F.lit("hybrydowa")).alias("workModeRaw"),
        F.lit("B2B").alias("contractRaw"),
        F.when(turn % 3 == 0, F.concat(F.lit("2024-03-0"), (turn % 9 + 1).cast("string")))
        .when(turn % 3 == 1, F.lit("wczoraj")).alias("dateRaw"))
    rows = ingest_cards(cards, "theprotocol")
    out = to_common(rows, "theprotocol", keep=("conv_id", "turn"))
    return out.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "company", "title", "url", "city",
                      "salary_from", "salary_to", "salary_currency", "contract_type", "experience_level", "published_at",
                      "remote")


# ---------------------------------------------------------------- A9, A10, A12 pages

_ANCHOR = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
_JSONLD = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'

_LINKS_SQL = f"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '{_ANCHOR}', 1) AS hrefs,
                  regexp_extract_all(html, '{_ANCHOR}', 2) AS texts FROM {{{{html_pg}}}}),
     u AS (SELECT page_id, unnest(hrefs) AS href, unnest(texts) AS text, generate_subscripts(hrefs, 1) - 1 AS link_pos FROM a)
SELECT page_id, href, {sqlx.js_trim(sqlx.dom_text('arg_min(text, link_pos)'))} AS text,
       CAST(min(link_pos) AS BIGINT) AS link_pos
FROM u WHERE contains(href, '/') GROUP BY page_id, href"""


@query("q_link_harvest", sql=_LINKS_SQL)
def q_link_harvest(spark, sf):
    links = harvest_links(adapter(spark, sf, "html_pg"), "/")
    return links.select("page_id", "href", "text", F.col("link_pos").cast("bigint").alias("link_pos"))


@query("q_offer_links", sql=f"""
SELECT doc_id, '/job/' || CAST(doc_id AS VARCHAR) || '-1' AS href, {sqlx.js_trim('text')} AS text, 0 AS link_pos FROM {{{{text_doc}}}}
UNION ALL SELECT doc_id, '/job/' || CAST(doc_id AS VARCHAR) || '-3', {sqlx.js_trim('title')}, 1 FROM {{{{text_doc}}}}
UNION ALL SELECT doc_id, '/job/' || CAST(doc_id AS VARCHAR) || '-4', {sqlx.js_trim('lang')}, 4 FROM {{{{text_doc}}}}""")
def q_offer_links(spark, sf):
    """A9 by the source's rule: quoted, bare and repeated hrefs, headings, and anchors that are none to a parser (in a
    comment, in a script, with another attribute).  The expected rows come from the table, not from the pages."""
    esc = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    n = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit('<!-- <a href="/job/c">no</a> --><script>"<a href=\'/job/s\'>no</a>"</script><a class=x href=\'/job/'), n,
        F.lit("-1'>"), esc("text"), F.lit('</a><a data-href="/job/'), n, F.lit('-2">no</a><A HREF=/job/'), n,
        F.lit('-3 title="a > b"><span>'), esc("source"), F.lit("</span><h3> "), esc("title"), F.lit(" </h3></A>"),
        F.lit('<a href="/job/'), n, F.lit('-1">again</a><a href="/about">'), esc("lang"), F.lit('</a><a href="/job/'), n,
        F.lit('-4"><i data-cy="job title">'), esc("lang"), F.lit("</i> "), esc("source"), F.lit("</a>"))
    pages = adapter(spark, sf, "text_doc").select("doc_id", html.alias("html"))
    return harvest_offers(pages, "nofluffjobs", ["doc_id"]).select("doc_id", "href", "text", "link_pos")


@query("q_embedded", sql=f"""
SELECT doc_id, 0 AS position, {sqlx.js_trim('title')} AS title, 'https://nofluffjobs.com/pl/job/d' || CAST(doc_id AS VARCHAR) AS url FROM {{{{text_doc}}}}
UNION ALL SELECT doc_id, 1, nullif({sqlx.js_trim('lang')}, ''), 'https://nofluffjobs.com/pl/job/e' FROM {{{{text_doc}}}} WHERE doc_id % 2 = 0""")
def q_embedded(spark, sf):
    """Postings in the first data script that holds some, at an unknown path; its type attribute is quoted or bare."""
    n = F.col("doc_id").cast("string")
    first = F.struct("title", F.concat(F.lit("/pl/job/d"), n).alias("url"))
    second = F.struct(F.col("lang").alias("title"), F.lit("/pl/job/e").alias("url"))
    postings = F.when(F.col("doc_id") % 2 == 0, F.array(first, second)).otherwise(F.array(first))
    blob = F.to_json(F.struct(F.struct(F.array(F.lit(1)).alias("pages"), postings.alias("rows")).alias("state")))
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit("type=application/json")).when(
        F.col("doc_id") % 3 == 1, F.lit("async TYPE='application/ld+json'")).otherwise(F.lit('id=x type="application/json"'))
    html = F.concat(F.lit('<!-- <script type="application/json">{"postings": [{"title": "no"}]}</script> -->'
                          '<script type="text/x">{"postings": [{"title": "no"}]}</script>'
                          '<script type="application/json">{"postings": [], "pad": "xxxxxxxxxx"}</script><script '), kind,
                    F.lit(">"), F.replace(blob, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    items = ingest_embedded(adapter(spark, sf, "text_doc").select("doc_id", html.alias("html")), ["doc_id"])
    out = to_common(items.withColumnRenamed("item_pos", "position"), "nofluffjobs", keep=("doc_id", "position"))
    return out.select("doc_id", "position", "title", "url")


_LD_SQL = f"""
WITH b AS (SELECT page_id, regexp_extract_all(html, '{_JSONLD}', 1) AS blocks FROM {{{{jsonld_pg}}}}),
     j AS (SELECT page_id, (list_filter(blocks, lambda x: json_extract_string(x, '$."@type"') = 'JobPosting'))[1] AS ld,
                  blocks[1] AS first_ld FROM b)"""


@query("q_jsonld", sql=f"""{_LD_SQL}
SELECT page_id, json_extract_string(ld, '$.title') AS title, json_extract_string(ld, '$.validThrough') AS valid_through,
       {sqlx.html_text("json_extract_string(ld, '$.description')", 'rocketjobs')} AS description,
       json_extract_string(first_ld, '$."@type"') AS first_type
FROM j""")
def q_jsonld(spark, sf):
    p = adapter(spark, sf, "jsonld_pg")
    both = p.select("page_id", jsonld("html", "JobPosting").alias("ld"), jsonld("html").alias("first"))
    ld = F.col("ld")
    return both.select("page_id", F.try_variant_get(ld, "$.title", "string").alias("title"),
                    F.try_variant_get(ld, "$.validThrough", "string").alias("valid_through"),
                    html_to_text(F.try_variant_get(ld, "$.description", "string"), "rocketjobs").alias("description"),
        F.try_variant_get("first", "$['@type']", "string").alias("first_type"))


@query("q_first_nonempty", sql=f"""
WITH l AS ({_LINKS_SQL}),
     {_LD_SQL.strip()[5:]},
     u AS (SELECT page_id, 1 AS prio, json_extract_string(ld, '$.title') AS value FROM j WHERE ld IS NOT NULL
           UNION ALL SELECT page_id, 2 AS prio, href AS value FROM l),
     m AS (SELECT page_id, min(prio) AS best FROM u GROUP BY page_id)
SELECT u.page_id, u.prio, u.value FROM u JOIN m ON u.page_id = m.page_id AND u.prio = m.best""")
def q_first_nonempty(spark, sf):
    p = adapter(spark, sf, "jsonld_pg")
    ld = extract_jsonld(p, "JobPosting").where(F.col("ld").isNotNull()).select(
        "page_id", F.lit(1).alias("_prio"), F.try_variant_get("ld", "$.title", "string").alias("value"))
    links = harvest_links(adapter(spark, sf, "html_pg"), "/").select("page_id", F.lit(2).alias("_prio"),
                                                                    F.col("href").alias("value"))
    return first_nonempty(["page_id"], ld, links).select("page_id", F.col("_prio").alias("prio"), "value")


# ---------------------------------------------------------------- A4 + C1 talentdays, A6 + C1 pracuj

def _td_item_json():
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    item = F.struct(
        F.struct(F.col("role").alias("name")).alias("employer"),
        F.col("title").alias("position"),
        F.when(turn % 5 != 4, F.concat(F.lit("c"), conv, F.lit("-"), turn.cast("string"))).alias("slug"),
        F.struct(F.when(turn % 2 == 0, F.lit("Wrocław")).alias("name")).alias("city"),
        F.struct((turn * 100).alias("min"), F.when(turn % 3 == 0, turn * 150).alias("max"),
                 F.lit("PLN").alias("currency")).alias("wages"),
        F.lit("Staż").alias("jobType"),
        F.when(turn % 2 == 0, F.lit("zero")).otherwise(F.lit("JUNIOR")).alias("experience"),
        F.when(turn % 3 == 0, F.array(F.lit("REMOTE"), F.lit("OFFICE"))).otherwise(F.array(F.lit("OFFICE"))).alias("workplace"))
    return F.to_json(item)


@query("q_talentdays", sql=f"""
SELECT * FROM (
  SELECT conv_id, {_RN} AS position, 'talentdays' AS source, nullif(role, '') AS company, nullif(title, '') AS title,
         CASE WHEN turn % 5 <> 4 THEN 'https://talentdays.pl/praca-i-staz/c' || CAST(conv_id AS VARCHAR) || '-'
              || CAST(turn AS VARCHAR) END AS url,
         CASE WHEN turn % 2 = 0 THEN 'Wrocław' END AS city, CAST(turn * 100 AS DOUBLE) AS salary_from,
         CASE WHEN turn % 3 = 0 THEN CAST(turn * 150 AS DOUBLE) END AS salary_to, 'PLN' AS salary_currency,
         'Staż' AS contract_type, CASE WHEN turn % 2 = 0 THEN 'zero' ELSE 'JUNIOR' END AS experience_level,
         turn % 3 = 0 AS remote
  FROM {{{{turns_cv}}}}) WHERE url IS NOT NULL AND upper(experience_level) = 'ZERO'""")
def q_talentdays(spark, sf):
    from jobtide.functions.classify import entry_level
    from jobtide.sources.landing import TALENTDAYS_ITEM
    t = adapter(spark, sf, "turns_cv")
    docs = _per_conv(t, _td_item_json(), "items")
    arr = F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]"))
    k = F.col("conv_id") % 3
    payload = (F.when(k == 0, F.concat(F.lit('{"json": {"data": '), arr, F.lit(', "meta": {"nextCursor": null}}}')))
               .when(k == 1, F.concat(F.lit('{"result": {"data": '), arr, F.lit("}}")))
               .otherwise(F.concat(F.lit('{"items": '), arr, F.lit("}"))))
    items = ingest_items(docs.select("conv_id", payload.alias("payload")))
    typed = items.select("conv_id", F.col("item_pos").alias("position"),
                         F.try_variant_get("item", "$", TALENTDAYS_ITEM.simpleString()).alias("item"))
    out = require(to_common(typed, "talentdays", keep=("conv_id", "position")))
    out = out.where(entry_level(None, "experience_level", exp_filter="ZERO"))
    return out.select("conv_id", F.col("position").cast("bigint").alias("position"), "source", "company", "title", "url",
                      "city", "salary_from", "salary_to", "salary_currency", "contract_type", "experience_level", "remote")


_PR_LABELS = "list_filter(list_value(title, 'Pełny etat', lang || ' ' || source, text), lambda x: length(x) BETWEEN 1 AND 59)"
_PR_SAL = ("CASE doc_id % 3 WHEN 0 THEN '5 000–7 000 zł / mies.' WHEN 1 THEN '30,50–45 zł/godz.' "
           "ELSE 'wynagrodzenie w zł' END")
_PR_F, _PR_T, _PR_C = sqlx.salary(_PR_SAL, "pracuj")


@query("q_pracuj_cards", sql=f"""
SELECT doc_id, 'pracuj' AS source, title, source AS company, 'https://www.pracuj.pl/praca/x,oferta,' || CAST(doc_id AS VARCHAR) AS url,
       {_PR_F} AS salary_from, {_PR_T} AS salary_to, {_PR_C} AS salary_currency,
       (list_filter({_PR_LABELS}, lambda x: regexp_matches(lower(x), '{CONTRACT_LABEL_RE}')))[1] AS contract_type,
       (list_filter({_PR_LABELS}, lambda x: regexp_matches(lower(x), '{EXPERIENCE_LABEL_RE}')))[1] AS experience_level,
       CASE WHEN regexp_matches(lower(array_to_string({_PR_LABELS}, ' | ')), 'zdaln') THEN true
            WHEN regexp_matches(lower(array_to_string({_PR_LABELS}, ' | ')), 'stacjonarn') THEN false END AS remote
FROM {{{{text_doc}}}} WHERE length(title) > 0""")
def q_pracuj_cards(spark, sf):
    d = adapter(spark, sf, "text_doc")
    cards = d.select(
        "doc_id", "title", F.col("source").alias("company"), F.lit(None).cast("string").alias("city"),
        F.concat(F.lit("https://www.pracuj.pl/praca/x,oferta,"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("5 000–7 000 zł / mies."))
        .when(F.col("doc_id") % 3 == 1, F.lit("30,50–45 zł/godz.")).otherwise(F.lit("wynagrodzenie w zł")).alias("salaryText"),
        F.array("title", F.lit("Pełny etat"), F.concat_ws(" ", "lang", "source"), F.col("text")).alias("labels"),
        F.lit(None).cast("string").alias("published_at"))
    rows = ingest_cards(cards, "pracuj")
    out = to_common(rows, "pracuj", keep=("doc_id",))
    return out.select("doc_id", "source", "title", "company", "url", "salary_from", "salary_to", "salary_currency",
                      "contract_type", "experience_level", "remote")


# ---------------------------------------------------------------- detail JSON bodies → fields (I10–I12 on responses)

@query("q_detail_fields", sql=f"""
WITH g AS (SELECT conv_id,
                  string_agg('<p>' || text || '</p>', '' ORDER BY turn) AS d,
                  coalesce(list(label ORDER BY turn) FILTER (WHERE role = 'user'), []) AS musts,
                  CASE WHEN conv_id % 2 = 0 THEN ['PL'] ELSE [] END AS langs,
                  CASE WHEN conv_id % 3 <> 0 THEN coalesce(list(label ORDER BY turn) FILTER (WHERE role <> 'user'), [])
                       ELSE [] END AS nices,
                  CASE WHEN conv_id % 4 = 1 THEN coalesce(list(label ORDER BY turn) FILTER (WHERE turn % 3 = 0), [])
                       ELSE [] END AS daily,
                  coalesce(list('task ' || CAST(turn AS VARCHAR) ORDER BY turn) FILTER (WHERE turn % 3 = 0), []) AS resp,
                  list_concat(CASE WHEN conv_id % 4 = 0 THEN ['kawa'] ELSE [] END,
                              CASE WHEN conv_id % 5 = 0 THEN ['owoce'] ELSE [] END) AS ben
           FROM {{{{turns_cv}}}} GROUP BY conv_id),
     h AS (SELECT conv_id, {sqlx.html_text('d', 'nofluffjobs')} AS d, musts, langs, nices,
                  CASE WHEN len(daily) > 0 THEN daily ELSE resp END AS resp, ben FROM g)
SELECT conv_id, {"{SECTIONS}"} AS description,
       CASE WHEN len(musts) > 0 THEN array_to_string(musts, '|') END AS skills_required,
       CASE WHEN len(nices) > 0 THEN array_to_string(nices, '|') END AS skills_nice
FROM h""".replace("{SECTIONS}", "__SECTIONS__"))
def q_detail_fields(spark, sf):
    from jobtide.functions.detail import with_detail_fields
    t = adapter(spark, sf, "turns_cv")
    lab = lambda s: s["label"]
    cid = F.col("conv_id")
    g = t.groupBy("conv_id").agg(
        _all_turns().alias("d"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "label")))).alias("u"),
        F.sort_array(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "label")))).alias("o"),
        F.sort_array(F.collect_list(F.when(F.col("turn") % 3 == 0, F.struct("turn", "label")))).alias("k"),
        F.sort_array(F.collect_list(F.when(F.col("turn") % 3 == 0, F.struct(
            "turn", F.concat(F.lit("task "), F.col("turn").cast("string")).alias("label"))))).alias("r"))
    empty = F.array().cast("array<string>")
    musts = F.when(cid % 2 == 0, F.to_json(F.transform("u", lab))) \
        .otherwise(F.to_json(F.transform("u", lambda s: F.struct(s["label"].alias("value")))))
    nices = F.to_json(F.struct(F.when(cid % 3 != 0, F.transform("o", lambda s: F.struct(s["label"].alias("name"))))
                               .otherwise(F.array().cast("array<struct<name:string>>")).alias("items")))
    langs = F.to_json(F.when(cid % 2 == 0, F.array(F.struct(F.lit("PL").alias("code"))))
                      .otherwise(F.array().cast("array<struct<code:string>>")))
    specs = F.to_json(F.struct(F.when(cid % 4 == 1, F.transform("k", lab)).otherwise(empty).alias("dailyTasks"),
                               F.transform("r", lab).alias("responsibilities")))
    ben = F.to_json(F.struct(F.when(cid % 4 == 0, F.array(F.lit("kawa"))).alias("benefits"),
                             F.lit(None).cast("array<string>").alias("equipment"),
                             F.when(cid % 5 == 0, F.array(F.lit("owoce"))).alias("officePerks")))
    body = F.concat(F.lit('{"details": '), F.to_json(F.struct(F.col("d").alias("description"))),
                    F.lit(', "requirements": {"musts": '), musts, F.lit(', "nices": '), nices,
                    F.lit(', "languages": '), langs, F.lit('}, "specs": '), specs, F.lit(', "benefits": '), ben, F.lit("}"))
    g = with_detail_fields(g.select("conv_id", body.alias("body")), "body", "nofluffjobs", "f")
    return g.select("conv_id", F.col("f.description").alias("description"),
                    F.array_join("f.skills_required", "|").alias("skills_required"),
                    F.array_join("f.skills_nice", "|").alias("skills_nice"))


def _sections_from(desc, musts, langs, nices, resp, ben):
    bul = "array_to_string(list_transform({x}, lambda z: '- ' || z), chr(10))"
    d = f"nullif({sqlx.js_trim(desc)}, '')"
    req = ("nullif(concat_ws(chr(10), CASE WHEN len(" + musts + ") > 0 THEN " + bul.format(x=musts) + " END, "
           "CASE WHEN len(" + langs + ") > 0 THEN 'Języki: ' || array_to_string(" + langs + ", ', ') END), '')")
    parts = [(d, "OPIS:"), (req, "WYMAGANIA:"),
             (f"CASE WHEN len({nices}) > 0 THEN {bul.format(x=nices)} END", "MILE WIDZIANE:"),
             (f"CASE WHEN len({resp}) > 0 THEN {bul.format(x=resp)} END", "OBOWIĄZKI:"),
             (f"CASE WHEN len({ben}) > 0 THEN {bul.format(x=ben)} END", "BENEFITY:")]
    joined = "concat_ws(chr(10) || chr(10), " + ", ".join(
        f"CASE WHEN ({b}) IS NOT NULL THEN '{lab}' || chr(10) || ({b}) END" for b, lab in parts) + ")"
    return f"nullif({sqlx.js_trim(sqlx.sub(joined, chr(10) + '{3,}', chr(10) + chr(10)))}, '')"


from jobtide.plans.registry import ORACLE as _ORACLE  # noqa: E402

_ORACLE["q_detail_fields"] = _ORACLE["q_detail_fields"].replace(
    "__SECTIONS__", _sections_from("d", "musts", "langs", "nices", "resp", "ben"))
