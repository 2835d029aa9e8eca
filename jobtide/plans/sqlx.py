"""DuckDB expression builders for the oracle SQL (kept next to the Spark versions'
semantics; these strings are only ever run by the oracle, never by the engine)."""

from __future__ import annotations


def url_key(x: str) -> str:
    return f"lower(regexp_replace(split_part(coalesce({x}, ''), '?', 1), '/+$', ''))"


def num_text(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = floor({x}) AND abs({x}) < 1e15 "
            f"THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END")


def salary_text(f: str, t: str, c: str, raw: str = "''") -> str:
    return (f"CASE WHEN {f} IS NOT NULL OR {t} IS NOT NULL THEN concat_ws('–', {num_text(f)}, {num_text(t)}) || "
            f"CASE WHEN coalesce({c}, '') <> '' THEN ' ' || {c} ELSE '' END ELSE coalesce({raw}, '') END")


def place_form(remote: str, city: str) -> str:
    return (f"CASE WHEN coalesce({remote}, false) THEN 'Zdalnie' "
            f"WHEN lower(coalesce({city}, '')) LIKE '%wroc%' THEN 'Biuro - Wrocław' "
            f"WHEN coalesce({city}, '') <> '' THEN 'Biuro - poza Wrocławiem' ELSE 'Niejasne' END")


SOURCE_NAMES_SQL = ("CASE {s} WHEN 'justjoin' THEN 'JustJoin.it' WHEN 'rocketjobs' THEN 'RocketJobs' "
                    "WHEN 'nofluffjobs' THEN 'NoFluffJobs' WHEN 'talentdays' THEN 'TalentDays' "
                    "WHEN 'pracuj' THEN 'Pracuj.pl' WHEN 'theprotocol' THEN 'theProtocol.it' WHEN 'olx' THEN 'OLX' "
                    "WHEN 'indeed' THEN 'Indeed' ELSE coalesce({s}, '') END")


def source_display(s: str) -> str:
    return SOURCE_NAMES_SQL.format(s=s)


WS = r"[\s\x{a0}\x{202f}\x{feff}]"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tracker_cols(prefix: str = "") -> str:
    p = prefix
    return (f"coalesce({p}company, '') AS company, coalesce({p}title, '') AS title, coalesce({p}url, '') AS url, "
            f"{source_display(p + 'source')} AS source_name, "
            f"{salary_text(p + 'salary_from', p + 'salary_to', p + 'salary_currency')} AS salary, "
            f"{place_form(p + 'remote', p + 'city')} AS place_form, '' AS applied_at, 'Nie wysłane' AS cv_sent, "
            f"'Do wysłania' AS status, '' AS contact_at, '' AS duplicate, '' AS notes")


def fold(x: str) -> str:
    return f"strip_accents(replace(replace({x}, 'ł', 'l'), 'Ł', 'L'))"


def slug(x: str, variant: str) -> str:
    v = fold(f"coalesce({x}, '')")
    if variant == "spaces":
        return f"regexp_replace({js_trim(f'lower({v})')}, '\\s+', '-', 'g')"
    if variant == "dash":
        d = f"regexp_replace({js_trim(f'lower({v})')}, '[^a-z0-9]+', '-', 'g')"
        return f"regexp_replace({d}, '^-+|-+$', '', 'g')"
    if variant == "trim":
        return f"lower({js_trim(v)})"
    return f"lower({v})"


AL, AR = "(^|[^a-z0-9_])", "($|[^a-z0-9_])"
UL = "(^|[^\\pL\\pN_])"


def w(word: str) -> str:
    return f"{AL}{word}{AR}"


CONTRACT = [
    ("umowa o prac", "umowa o pracę"),
    (f"{w('b2b')}|kontrakt b2b", "B2B"),
    ("umowa zlecen", "umowa zlecenie"),
    ("umowa o dzieł", "umowa o dzieło"),
    ("kontrakt", "kontrakt"),
    (f"{UL}staż|praktyk", "staż"),
]
SENIORITY = [
    (f"{w('senior')}|starszy", "senior"),
    (f"{w('lead')}|team lead|kierownik|menedżer|{w('manager')}", "lead"),
    (f"{w('mid')}|{w('regular')}", "mid"),
    (f"{w('junior')}|młodszy", "junior"),
    (f"{w('intern')}|praktykant|{UL}staż|praktyk", "intern"),
]
ENTRY = f"sta[zż]yst|staż|staz{AR}|praktyk|intern|trainee"


def classify(x: str, rules) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN '{lab}'" for p, lab in rules)
    return f"CASE WHEN coalesce({x}, '') = '' THEN NULL {whens} END"


def salary(x: str, dialect: str) -> tuple[str, str, str]:
    """(from, to, currency) DuckDB expressions over text column x."""
    t = f"translate({x}, '\u00a0\u202f', '  ')"
    nul = f"({x} IS NULL OR {x} = '')"
    if dialect == "olx":
        toks = f"regexp_extract_all(regexp_replace({t}, '\\s(\\d)', '\\1', 'g'), '\\d+(?:[.,]\\d+)?')"
        nums = f"list_filter(list_transform({toks}, lambda z: TRY_CAST(replace(z, ',', '.') AS DOUBLE)), lambda n: n IS NOT NULL)"
        frm, to = f"({nums})[1]", f"({nums})[2]"
        cur = (f"CASE WHEN len({nums}) > 0 THEN CASE WHEN regexp_matches(lower({t}), 'zł|pln') THEN 'PLN' "
               f"WHEN regexp_matches(lower({t}), 'eur|€') THEN 'EUR' END END")
    elif dialect == "indeed":
        ok = f"regexp_matches(lower({t}), 'zł|pln')"
        toks = f"regexp_extract_all({t}, '\\d[\\d .]*\\d|\\d+')"
        nums = (f"list_filter(list_transform({toks}, lambda z: TRY_CAST(regexp_replace(z, '[ .]', '', 'g') AS DOUBLE)),"
                f" lambda n: n IS NOT NULL AND n >= 100)")
        only_to = (f"(regexp_matches({t}, '(?i)(^|[^A-Za-z0-9_])do($|[^A-Za-z0-9_])') AND NOT "
                   f"regexp_matches({t}, '(?i)(^|[^A-Za-z0-9_])od($|[^A-Za-z0-9_])'))")
        n = f"len({nums})"
        frm = f"CASE WHEN {ok} AND {n} >= 2 THEN ({nums})[1] WHEN {ok} AND {n} = 1 AND NOT {only_to} THEN ({nums})[1] END"
        to = f"CASE WHEN {ok} AND {n} >= 2 THEN ({nums})[2] WHEN {ok} AND {n} = 1 AND {only_to} THEN ({nums})[1] END"
        cur = f"CASE WHEN ({frm}) IS NOT NULL OR ({to}) IS NOT NULL THEN 'PLN' END"
    elif dialect == "pracuj":
        toks = f"regexp_extract_all({t}, '\\d[\\d\\s.]*\\d|\\d')"
        nums = (f"list_filter(list_transform({toks}, lambda z: TRY_CAST(regexp_replace(z, '[\\s.]', '', 'g') AS DOUBLE)),"
                f" lambda n: n IS NOT NULL AND n >= 10)")
        frm, to = f"({nums})[1]", f"({nums})[2]"
        cur = (f"CASE WHEN regexp_matches(lower({t}), 'z[łl]|pln') THEN 'PLN' WHEN regexp_matches(lower({t}), 'eur|€') "
               f"THEN 'EUR' WHEN regexp_matches(lower({t}), '\\$|usd') THEN 'USD' END")
    else:
        s = f"regexp_replace({t}, '\\s', ' ', 'g')"
        toks = f"regexp_extract_all({s}, '\\d[\\d ]*\\d|\\d')"
        nums = f"list_filter(list_transform({toks}, lambda z: TRY_CAST(replace(z, ' ', '') AS DOUBLE)), lambda n: n IS NOT NULL)"
        frm, to = f"({nums})[1]", f"({nums})[2]"
        cur = (f"CASE WHEN regexp_matches(lower({s}), 'zł|pln') THEN 'PLN' WHEN regexp_matches(lower({s}), 'eur|€') "
               f"THEN 'EUR' WHEN regexp_matches(lower({s}), '\\$|usd') THEN 'USD' END")
    return (f"CASE WHEN NOT {nul} THEN CAST({frm} AS DOUBLE) END", f"CASE WHEN NOT {nul} THEN CAST({to} AS DOUBLE) END",
            f"CASE WHEN NOT {nul} THEN {cur} END")


NAMED = [("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"),
         ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"),
         ("&ndash;", "–"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"),
         ("&bdquo;", "„"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&lsquo;", "‘"),
         ("&rsquo;", "’"), ("&euro;", "€"), ("&bull;", "•"), ("&shy;", "\u00ad"), ("&oacute;", "ó"), ("&Oacute;", "Ó"),
         # names that also exist in capitals: headings are upper-cased before they are decoded
         ("&LT;", "<"), ("&GT;", ">"), ("&QUOT;", '"'), ("&COPY;", "©"), ("&REG;", "®"), ("&AMP;", "&"), ("&amp;", "&")]


def decode_entities(x: str) -> str:
    for ent, ch in NAMED:
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def sub(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, '{pat}', '{rep}', 'g')"


def dom_text(x: str) -> str:
    x = sub(x, "(?is)<head\\b.*?</head>", "")
    x = sub(x, "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->", "")
    x = sub(x, "<[a-zA-Z/!?][^>]*>", "")
    return decode_entities(x)


def heading_caps(x: str) -> str:
    head = "(?is)<h[1-6][^>]*>.*?</h[1-6]>"
    h = f"(regexp_extract_all({x}, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1))[i]"
    fmt = "'\n\n' || upper(replace(" + sub(js_trim(sub(sub(h, "<[a-zA-Z/!?][^>]*>", " "), "\\s+", " ")), "[:\\s]+$", "") + ", 'ß', 'SS')) || ':\n'"
    return (f"CASE WHEN regexp_matches({x}, '{head}') THEN array_to_string(list_transform(string_split_regex({x}, '{head}'), "
            f"lambda p, i: p || coalesce({fmt}, '')), '') ELSE {x} END")


def html_text(x: str, profile: str) -> str:
    if profile == "justjoin":
        t = js_trim(sub(sub(dom_text(x), "\r", ""), "\n{3,}", "\n\n"))
    elif profile == "rocketjobs":
        h = sub(sub(sub(heading_caps(x), "(?i)<br\\s*/?>", "\n"), "(?i)<li[^>]*>", "\n- "),
                "(?i)</(p|div|li|ul|ol|tr|table|section)>", "\n")
        t = sub(f"translate({dom_text(h)}, '\u00a0', ' ')", "[ \t]+", " ")
        t = js_trim(sub(sub(t, " *\n *", "\n"), "\n{3,}", "\n\n"))
    elif profile == "nofluffjobs":
        h = sub(sub(x, "(?i)<br\\s*/?>", "\n"), "(?i)</(p|li|div|h[1-6]|tr|ul|ol|section)>", "\n")
        st = f"CASE WHEN regexp_matches({x}, '[<&]') THEN {js_trim(dom_text(h))} ELSE {js_trim(x)} END"
        t = js_trim(sub(sub(sub(st, "\r", ""), "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))
    elif profile == "talentdays":
        h = sub(sub(sub(sub(x, "(?i)<br\\s*/?>", "\n"), "(?i)<li[^>]*>", "- "), "(?i)</(li|tr)>", "\n"),
                "(?i)</(p|div|section|article|ul|ol|table|h[1-6])>", "\n\n")
        t = f"translate({dom_text(h)}, '\u00a0', ' ')"
        t = js_trim(sub(sub(sub(t, "\r", ""), "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))
    else:
        h = sub(sub(sub(x, "(?i)<br\\s*/?>", "\n"), "(?i)</(p|li|div|h[1-6]|ul|ol|tr)>", "\n"), "(?i)<li[^>]*>", "- ")
        t = js_trim(sub(sub(sub(dom_text(h), "\r", ""), "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))
    return f"nullif({t}, '')"


def block(body: str, status: str, needles) -> str:
    head = f"lower(coalesce({body}, ''))"
    return f"(coalesce({status} IN (403, 429), false) OR regexp_matches({head}, '{'|'.join(needles)}'))"
