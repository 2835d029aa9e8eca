"""Per-source detail response shapes → fields, and the olx fill-only merge."""

import datetime as dt
import json

from pyspark.sql import functions as F

from jobtide.functions.detail import detail_fields
from jobtide.plans.run import run_details
from jobtide.schema import DESC_CACHE


def _f(spark, body, source):
    return spark.createDataFrame([(body,)], "b string").select(detail_fields(F.col("b"), source).alias("f")).first()["f"]


def test_nofluffjobs_sections(spark):
    body = json.dumps({"details": {"description": "<p>D</p>"},
                       "requirements": {"musts": [{"value": "SQL"}, "  "], "nices": {"items": [{"name": "Git"}]},
                                        "languages": [{"code": "PL"}]},
                       "specs": {"dailyTasks": [], "responsibilities": ["Raporty"]},
                       "benefits": {"benefits": ["Kawa"], "equipment": None, "officePerks": ["Owoce"]}})
    f = _f(spark, body, "nofluffjobs")
    assert f["description"] == ("OPIS:\nD\n\nWYMAGANIA:\n- SQL\nJęzyki: PL\n\nMILE WIDZIANE:\n- Git\n\n"
                                "OBOWIĄZKI:\n- Raporty\n\nBENEFITY:\n- Kawa\n- Owoce")
    assert f["skills_required"] == ["SQL"] and f["skills_nice"] == ["Git"]


def test_talentdays_rocketjobs_olx(spark):
    td = _f(spark, json.dumps({"result": {"data": {"content": "", "summary": "<p>a</p><ul><li>b</li></ul>",
                                                    "application": {"url": "https://x"}, "expirationDate": "2024-06-01"}}}),
            "talentdays")
    assert (td["description"], td["apply_url"], td["expires_at"]) == ("a\n\n- b", "https://x", "2024-06-01")
    ld = json.dumps([{"@type": "Organization"}, {"@type": "JobPosting", "description": "<h3>Zadania</h3><p>x</p>",
                                                  "validThrough": "2024-07-01"}])
    rj = _f(spark, f'<script type="application/ld+json">{ld}</script>', "rocketjobs")
    assert (rj["description"], rj["valid_through"]) == ("ZADANIA:\nx", "2024-07-01")
    olx = _f(spark, json.dumps({"data": {"description": "a<br>b", "user": {"name": " Acme "},
                                         "params": [{"key": "agreement", "value": {"label": "Umowa"}},
                                                    {"key": "agreement", "value": {"label": "B"}},
                                                    {"key": "salary", "value": {"from": 5000, "to": 6000, "currency": "PLN"}}]}}),
             "olx")
    assert (olx["description"], olx["company"], olx["contract_type"], olx["salary_from"]) == ("a\nb", "Acme", "Umowa", 5000.0)


def test_olx_fill_merge(spark):
    offers = spark.createDataFrame([("R1", "olx", 1, "https://www.olx.pl/oferta/a-ID1234567.html", None, 4000.0),
                                    ("R1", "olx", 2, "https://www.olx.pl/oferta/b-ID7654321.html", "List Co", None)],
                                   "run_id string, source string, position long, url string, company string, salary_from double")
    body = json.dumps({"data": {"description": "opis", "user": {"name": "Acme"},
                                "params": [{"key": "salary", "value": {"from": 5000, "to": 6000, "currency": "PLN"}}]}})
    details = spark.createDataFrame([("R1", "olx", 1, "u", 200, body, None), ("R1", "olx", 2, "u", 200, body, None)],
                                    "run_id string, source string, position long, url string, status int, body string, error string")
    r = run_details(offers, details, spark.createDataFrame([], DESC_CACHE), "olx", now=dt.datetime(2024, 1, 1))
    got = {x["position"]: (x["company"], x["salary_from"], x["salary_to"], x["description"]) for x in r["offers"].collect()}
    assert got == {1: ("Acme", 4000.0, None, "opis"), 2: ("List Co", 5000.0, 6000.0, "opis")}
