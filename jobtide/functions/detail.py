"""Detail response bodies → enrichment fields, per source (I9–I13 applied to the landed
response shapes).  One struct column, built only from native expressions:

* justjoin    HTML page: first JSON-LD block's ``description`` (textContent profile) and
              the escaped ``requiredSkills`` / ``niceToHaveSkills`` lists of the page payload
* rocketjobs  HTML page: first JSON-LD ``JobPosting`` (object or array element),
              description with headings, ``validThrough``
* nofluffjobs JSON: sections composed from details / requirements / specs / benefits;
              musts and nices also become the skill lists
* talentdays  JSON: root at ``json`` / ``result.data`` / ``result`` / top level; content
              else summary; application url; expiration date
* olx         JSON ``data``: description, seller name, params (agreement else type,
              experience, salary triple)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.common import col_of, js_trim, trimmed_or_null
from jobtide.functions.html import first_job_posting, html_to_text, jsonld_blocks
from jobtide.functions.jsonx import embedded_skill_list, list_values
from jobtide.functions.literals import let
from jobtide.functions.text import compose_sections, format_skills
from jobtide.operators.positional import concat_lists

FIELDS = ["description", "skills_required", "skills_nice", "valid_through", "apply_url", "expires_at",
          "company", "contract_type", "experience_level", "salary_from", "salary_to", "salary_currency"]
_TYPES = {"skills_required": "array<string>", "skills_nice": "array<string>", "salary_from": "double",
          "salary_to": "double"}


def _s(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _nonempty(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def _pack(**cols) -> Column:
    return F.struct(*[(cols[f] if f in cols else F.lit(None)).cast(_TYPES.get(f, "string")).alias(f) for f in FIELDS])


def _param(params: Column, key: str) -> Column:
    return F.get(F.filter(params, lambda p: _s(p, "$.key") == F.lit(key)), 0)


def content_stages(body, source: str) -> list[dict[str, Column]]:
    """Columns, stage by stage, that read a body's structured content once: ``_dv`` (VARIANT) and, for justjoin, ``_ld``
    (its first JSON-LD block, which may be no JSON)."""
    b = col_of(body)
    if source == "justjoin":
        return [{"_ld": F.get(jsonld_blocks(b), 0)}, {"_dv": F.try_parse_json("_ld")}]
    return [{"_dv": first_job_posting(b) if source == "rocketjobs" else F.try_parse_json(b)}]


def content_found(source: str) -> tuple[Column, Column]:
    """``detail_has_content`` and ``detail_malformed`` of a body whose content stages are at hand."""
    if source == "justjoin":
        return F.col("_ld").isNotNull(), F.col("_ld").isNotNull() & F.col("_dv").isNull()
    if source == "olx":
        return F.try_variant_get("_dv", "$.data", "variant").isNotNull(), F.lit(False)
    return F.col("_dv").isNotNull(), F.lit(False)


def detail_fields(body, source: str, content: Column | None = None) -> Column:
    """The fields; ``content``: the body's ``_dv``, where it was read before."""
    b = col_of(body)
    if source == "justjoin":
        ld = F.try_parse_json(F.get(jsonld_blocks(b), 0)) if content is None else content
        req = format_skills(embedded_skill_list(b, "requiredSkills"))
        nice = format_skills(embedded_skill_list(b, "niceToHaveSkills"))
        return _pack(description=html_to_text(_s(ld, "$.description"), "justjoin"), skills_required=req,
                     skills_nice=nice)
    if source == "rocketjobs":
        jp = first_job_posting(b) if content is None else content
        return _pack(description=html_to_text(_s(jp, "$.description"), "rocketjobs"),
                     valid_through=trimmed_or_null(_s(jp, "$.validThrough")))
    v = F.try_parse_json(b) if content is None else content
    if source == "nofluffjobs":
        def lst(path):
            return list_values(F.try_variant_get(v, path, "variant"))
        musts, nices = lst("$.requirements.musts"), lst("$.requirements.nices")
        desc = html_to_text(F.coalesce(_s(v, "$.details.description"), _s(v, "$.description")), "nofluffjobs")
        req_txt = html_to_text(_s(v, "$.requirements.description"), "nofluffjobs")
        benefits = concat_lists(lst("$.benefits.benefits"), lst("$.benefits.equipment"), lst("$.benefits.officePerks"))
        text = compose_sections(desc, musts, lst("$.requirements.languages"), nices, lst("$.specs.dailyTasks"),
                                lst("$.specs.responsibilities"), benefits, requirements_text=req_txt)
        return _pack(description=text, skills_required=F.when(F.size(musts) > 0, musts),
                     skills_nice=F.when(F.size(nices) > 0, nices))
    if source == "talentdays":
        def read(root):
            html = F.coalesce(_nonempty(_s(root, "$.content")), _nonempty(_s(root, "$.summary")))
            return _pack(description=html_to_text(html, "talentdays"),
                         apply_url=_nonempty(_s(root, "$.application.url")),
                         expires_at=_nonempty(_s(root, "$.expirationDate")))
        return let(F.coalesce(F.try_variant_get(v, "$.json", "variant"), F.try_variant_get(v, "$.result.data", "variant"),
                              F.try_variant_get(v, "$.result", "variant"), v), read)
    if source == "olx":
        # Whole paths: ``data`` as a VARIANT would be copied, text and all, at each use.
        params = F.coalesce(F.try_variant_get(v, "$.data.params", "array<variant>"), F.array().cast("array<variant>"))
        agreement = F.coalesce(_param(params, "agreement"), _param(params, "type"))
        sal = _param(params, "salary")
        return _pack(description=html_to_text(_s(v, "$.data.description"), "olx"),
                     company=F.nullif(js_trim(_s(v, "$.data.user.name")), F.lit("")),
                     contract_type=F.nullif(_s(agreement, "$.value.label"), F.lit("")),
                     experience_level=F.nullif(_s(_param(params, "experience"), "$.value.label"), F.lit("")),
                     salary_from=F.try_variant_get(sal, "$.value.from", "double"),
                     salary_to=F.try_variant_get(sal, "$.value.to", "double"),
                     salary_currency=F.nullif(_s(sal, "$.value.currency"), F.lit("")))
    raise ValueError(f"no detail shape for source {source!r}")


def with_detail_fields(df: DataFrame, body: str, source: str, out: str = "_det", content: str | None = None,
                       where: Column | None = None) -> DataFrame:
    """``detail_fields``, for the rows that ``where`` holds for, staged over several projections: the JSON body is parsed once (or taken from the column
    ``content``) and every list is computed once per row (a single nested expression would re-evaluate
    them in each section test).  Other sources are a single projection."""
    given = F.col(content) if content else None
    wanted = F.col(body).isNotNull() if where is None else F.col(body).isNotNull() & where
    if source != "nofluffjobs":
        return df.withColumn(out, F.when(wanted, detail_fields(F.col(body), source, given)))
    v = F.col("_dn")
    x = df.withColumn("_dn", F.when(wanted, F.try_parse_json(F.col(body)) if given is None else given))

    def lst(path):
        return list_values(F.try_variant_get(v, path, "variant"))

    # Columns of their own: fields of one struct would be folded back into each of their uses.
    staged = {
        "_musts": lst("$.requirements.musts"), "_nices": lst("$.requirements.nices"), "_langs": lst("$.requirements.languages"),
        "_daily": lst("$.specs.dailyTasks"), "_resp": lst("$.specs.responsibilities"),
        "_ben": concat_lists(lst("$.benefits.benefits"), lst("$.benefits.equipment"), lst("$.benefits.officePerks")),
        "_desc": html_to_text(F.coalesce(_s(v, "$.details.description"), _s(v, "$.description")), "nofluffjobs"),
        "_req": html_to_text(_s(v, "$.requirements.description"), "nofluffjobs")}
    x = x.withColumns(staged)
    text = compose_sections("_desc", "_musts", "_langs", "_nices", "_daily", "_resp", "_ben", requirements_text="_req")
    fields = _pack(description=text, skills_required=F.when(F.size("_musts") > 0, F.col("_musts")),
                   skills_nice=F.when(F.size("_nices") > 0, F.col("_nices")))
    return x.withColumn(out, F.when(wanted, fields)).drop("_dn", *staged)
