"""Per-source mapping to the common offer schema (C1–C3, C10), as declarative
column dictionaries evaluated in one ``select``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.classify import CONTRACT_LABEL_RE, EXPERIENCE_LABEL_RE, contract_type, infer_remote, pick_label, \
    seniority
from jobtide.functions.common import blank_to_null, js_trim, trimmed_or_null
from jobtide.functions.dates import date_or_raw, epoch_to_iso
from jobtide.functions.salary import parse_salary
from jobtide.functions.text import clean_city
from jobtide.functions.urls import abs_url, query_id
from jobtide.schema import OFFER

# Base URLs per source.
BASE = {
    "justjoin": "https://justjoin.it/job-offer/",
    "rocketjobs": "https://rocketjobs.pl/oferta-pracy/",
    "talentdays": "https://talentdays.pl/praca-i-staz/",
    "nofluffjobs": "https://nofluffjobs.com",
    "nofluffjobs_rel": "https://nofluffjobs.com/pl/job/",
    "olx": "https://www.olx.pl",
    "indeed": "https://pl.indeed.com",
    "indeed_view": "https://pl.indeed.com/viewjob?jk=",
}


def _num(v: Column) -> Column:
    """A JSON number from a VARIANT field (strings and other types → null)."""
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"),
                  F.try_variant_get(v, "$", "double"))


def _str(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def board_api(item: str = "item", source: str = "justjoin") -> dict[str, Column]:
    """justjoin / rocketjobs list item (typed struct)."""
    i = F.col(item)
    et = F.get(i["employmentTypes"], 0)
    return {
        "company": blank_to_null(i["companyName"]),
        "title": blank_to_null(i["title"]),
        "url": F.when(blank_to_null(i["slug"]).isNotNull(), F.concat(F.lit(BASE[source]), i["slug"])),
        "city": F.coalesce(blank_to_null(i["city"]), blank_to_null(F.get(i["multilocation"], 0)["city"])),
        "salary_from": et["from"], "salary_to": et["to"],
        "salary_currency": et["currency"], "contract_type": et["type"],
        "experience_level": blank_to_null(i["experienceLevel"]),
        "published_at": blank_to_null(i["publishedAt"]),
        "remote": F.coalesce(i["workplaceType"] == "remote", F.lit(False)),
    }


def nofluffjobs_posting(item: str = "item") -> dict[str, Column]:
    """nofluffjobs posting (VARIANT)."""
    v = F.col(item)
    remote = F.coalesce(F.try_variant_get(v, "$.location.fullyRemote", "boolean") & (
        F.schema_of_variant(F.variant_get(v, "$.location.fullyRemote", "variant")) == "BOOLEAN"), F.lit(False))
    places = F.try_variant_get(v, "$.location.places", "array<variant>")
    city = F.get(F.filter(F.coalesce(places, F.array()), lambda p: F.length(_str(p, "$.city")) > 0), 0)
    sal_v = F.try_variant_get(v, "$.salary", "variant")
    sal = F.when(F.schema_of_variant(sal_v).startswith("ARRAY"), F.try_variant_get(sal_v, "$[0]", "variant")) \
        .otherwise(sal_v)
    sen_arr = F.try_variant_get(v, "$.seniority", "array<string>")
    sen_str = F.when(F.schema_of_variant(F.try_variant_get(v, "$.seniority", "variant")) == "STRING", _str(v, "$.seniority"))
    pub = F.coalesce(*[F.when(F.length(_str(v, f"$.{k}")) > 0, _str(v, f"$.{k}")) for k in ("posted", "renewed", "published")])
    link = F.coalesce(*[F.when(F.length(js_trim(_str(v, f"$.{k}"))) > 0, js_trim(_str(v, f"$.{k}")))
                        for k in ("url", "slug", "postingUrl")])
    return {
        "company": trimmed_or_null(_str(v, "$.name")),
        "title": trimmed_or_null(_str(v, "$.title")),
        "url": abs_url(link, BASE["nofluffjobs"], BASE["nofluffjobs_rel"]),
        "city": F.coalesce(js_trim(_str(city, "$.city")), F.when(remote, F.lit("Remote"))),
        "salary_from": _num(F.try_variant_get(sal, "$.from", "variant")),
        "salary_to": _num(F.try_variant_get(sal, "$.to", "variant")),
        "salary_currency": blank_to_null(_str(sal, "$.currency")),
        "contract_type": blank_to_null(_str(sal, "$.type")),
        "experience_level": F.coalesce(F.when(F.size(sen_arr) > 0, F.array_join(sen_arr, ", ")), blank_to_null(sen_str)),
        "published_at": epoch_to_iso(pub),
        "remote": remote,
    }


def talentdays_item(item: str = "item") -> dict[str, Column]:
    i = F.col(item)
    return {
        "company": blank_to_null(i["employer"]["name"]), "title": blank_to_null(i["position"]),
        "url": F.when(blank_to_null(i["slug"]).isNotNull(), F.concat(F.lit(BASE["talentdays"]), i["slug"])),
        "city": blank_to_null(i["city"]["name"]),
        "salary_from": i["wages"]["min"], "salary_to": i["wages"]["max"], "salary_currency": i["wages"]["currency"],
        "contract_type": blank_to_null(i["jobType"]), "experience_level": blank_to_null(i["experience"]),
        "published_at": F.lit(None).cast("string"),
        "remote": F.coalesce(F.array_contains(i["workplace"], "REMOTE"), F.lit(False)),
    }


def olx_card() -> dict[str, Column]:
    sal = parse_salary(F.col("salaryRaw"), "olx")
    href = F.col("url")
    return {
        "company": F.lit(None).cast("string"), "title": F.col("title"),
        "url": F.when(href.startswith("/"), F.concat(F.lit(BASE["olx"]), href)).otherwise(blank_to_null(href)),
        "city": blank_to_null(F.col("city")),
        "salary_from": sal["salary_from"], "salary_to": sal["salary_to"], "salary_currency": sal["salary_currency"],
        "contract_type": F.lit(None).cast("string"), "experience_level": F.lit(None).cast("string"),
        "published_at": blank_to_null(F.col("dateText")),
        "remote": infer_remote("any", "title", "city"),
    }


def pracuj_card() -> dict[str, Column]:
    sal = parse_salary(F.col("salaryText"), "pracuj")
    labels = F.coalesce(F.col("labels"), F.array().cast("array<string>"))
    return {
        "company": blank_to_null(F.col("company")), "title": F.col("title"), "url": F.col("url"),
        "city": blank_to_null(F.col("city")),
        "salary_from": sal["salary_from"], "salary_to": sal["salary_to"], "salary_currency": sal["salary_currency"],
        "contract_type": pick_label(labels, CONTRACT_LABEL_RE),
        "experience_level": pick_label(labels, EXPERIENCE_LABEL_RE),
        "published_at": blank_to_null(F.col("published_at")),
        "remote": infer_remote("labels", labels),
    }


def theprotocol_card() -> dict[str, Column]:
    sal = parse_salary(F.col("salaryRaw"), "theprotocol")
    return {
        "company": blank_to_null(F.col("company")), "title": blank_to_null(F.col("title")), "url": F.col("href"),
        "city": F.when(blank_to_null(F.col("cityRaw")).isNotNull(), clean_city("cityRaw", "first_part")),
        "salary_from": sal["salary_from"], "salary_to": sal["salary_to"], "salary_currency": sal["salary_currency"],
        "contract_type": blank_to_null(F.col("contractRaw")), "experience_level": blank_to_null(F.col("levelRaw")),
        "published_at": F.when(blank_to_null(F.col("dateRaw")).isNotNull(), date_or_raw(F.col("dateRaw"))),
        "remote": infer_remote("only_true", "workModeRaw", "cityRaw"),
    }


def indeed_card() -> dict[str, Column]:
    jk = F.coalesce(blank_to_null(F.col("jk")), query_id(F.col("href"), "jk"))
    href = blank_to_null(F.col("href"))
    url = F.when(jk.isNotNull(), F.concat(F.lit(BASE["indeed_view"]), jk)) \
        .when(href.isNotNull(), F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(BASE["indeed"]), href)))
    meta = F.concat_ws(" ", F.coalesce(F.col("metaText"), F.lit("")), F.coalesce(F.col("cardText"), F.lit("")))
    exp = F.concat_ws(" ", F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("cardText"), F.lit("")))
    sal = parse_salary(F.col("salaryText"), "indeed")
    return {
        "company": blank_to_null(F.col("company")), "title": blank_to_null(F.col("title")), "url": url,
        "city": clean_city("loc", "postal"),
        "salary_from": sal["salary_from"], "salary_to": sal["salary_to"], "salary_currency": sal["salary_currency"],
        "contract_type": contract_type(meta), "experience_level": seniority(exp),
        "published_at": blank_to_null(F.col("publishedAt")),
        "remote": infer_remote("word", "loc", "cardText"),
        "jk": jk,
    }


MAPPINGS: dict[str, Callable[[], dict[str, Column]]] = {
    "justjoin": lambda: board_api("item", "justjoin"),
    "rocketjobs": lambda: board_api("item", "rocketjobs"),
    "nofluffjobs": lambda: nofluffjobs_posting("item"),
    "talentdays": lambda: talentdays_item("item"),
    "olx": olx_card, "pracuj": pracuj_card, "theprotocol": theprotocol_card, "indeed": indeed_card,
}


def to_common(df: DataFrame, source: str, keep: tuple[str, ...] = ("run_id", "position")) -> DataFrame:
    """C1 + C10: map one source's rows to the common schema (missing fields → null)."""
    m = MAPPINGS[source]()
    cols = [F.lit(source).alias("source")]
    for f in OFFER.fields[1:]:
        expr = m.get(f.name)
        cols.append((expr if expr is not None else F.lit(None)).cast(f.dataType).alias(f.name))
    extra = [F.col(k) for k in keep if k in df.columns and k not in m]
    extra += [m[k].alias(k) for k in m if k not in OFFER.fieldNames()]
    return df.select(*extra, *cols)


# Row requirement per source.
REQUIRE = {"justjoin": "url", "rocketjobs": "url", "talentdays": "url", "pracuj": "url", "theprotocol": "url",
           "nofluffjobs": "title_or_url", "olx": "title", "indeed": "title_or_url"}


def require(df: DataFrame) -> DataFrame:
    """Rows of any sources that meet their source's requirement (default: a url); one filter."""
    url, title = (F.coalesce(F.col(c) != "", F.lit(False)) for c in ("url", "title"))
    rule = {"url": url, "title": title, "title_or_url": url | title}
    ok = None
    for source, name in REQUIRE.items():
        hit = F.col("source") == source
        ok = F.when(hit, rule[name]) if ok is None else ok.when(hit, rule[name])
    return df.where(ok.otherwise(url))


def conform(df: DataFrame) -> DataFrame:
    """Select against the common schema; missing columns become typed nulls."""
    out = []
    for f in OFFER.fields:
        out.append((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    others = [F.col(c) for c in df.columns if c not in OFFER.fieldNames()]
    return df.select(*others, *out)


def drop_temp(df: DataFrame) -> DataFrame:
    """C11: remove temporary columns (leading underscore) before a write."""
    return df.drop(*[c for c in df.columns if c.startswith("_") and c != "_src"])
