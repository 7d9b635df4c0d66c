"""SQL twins of the catalogue, for DuckDB over the same parquet tables.

Each twin states what a query means in the most direct way (pair joins, member lists,
one SELECT per rule), which need not be how the Spark job gets there.
"""

from __future__ import annotations

from rosterproof.functions import fixed, rule_texts
from rosterproof.plans import standins

WS, BLANK, THAI, DOT, NOT_WS = fixed.WS, fixed.BLANK, fixed.THAI, fixed.DOT, fixed.NOT_WS
ORACLES: dict[str, str] = {}
AS_OF = f"timestamp '{standins.AS_OF}'"


# --- SQL fragments --------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def alt(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def rr(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def rx(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {group})"


def rall(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({c}, {q(pattern)}, {group})"


def rm(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def nn(c: str) -> str:
    return f"coalesce({c}, '')"


def trim(c: str) -> str:
    return rr(c, rf"^{WS}+|{WS}+\z")


def squeeze(c: str) -> str:
    return rr(c, f"{WS}+", " ")


def strip(c: str) -> str:
    return trim(squeeze(rr(nn(c), "<[^>]*>")))


def digits(c: str) -> str:
    return rr(c, "[^0-9]")


def name_key(c: str) -> str:
    return f"lower({rr(nn(c), rf'[{BLANK}()._/' + chr(92) * 2 + '–—-]')})"


def code_key(c: str) -> str:
    s = trim(nn(c))
    return f"case when {rm(s, '[0-9]')} then ltrim({digits(s)}, '0') else lower({s}) end"


def has_any(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def ctes(*parts: str, select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select


def std(sql: str) -> str:
    names = ("part", "customer", "nation", "orders", "pages", "events")
    return sql.format(**{n: n for n in names})


def join_thai(c: str) -> str:
    # No lookahead here: each pass joins every other gap of a run, so two passes do.
    p = rf"([{THAI}])[ \t]+([{THAI}])"
    return rr(rr(c, p, r"\1\2"), p, r"\1\2")


def ascii_digits(c: str) -> str:
    return f"translate({c}, '{fixed.THAI_DIGITS}', '{fixed.ASCII_DIGITS}')"


def normal(c: str) -> str:
    t = rr(join_thai(ascii_digits(nn(c))), r"[\x{200B}-\x{200D}\x{FEFF}]")
    t = rr(rr(t, "[“”„]", '"'), "[‘’]", "'")
    return rr(t, r"[ \t]{2,}", " ")


def skeleton(c: str) -> str:
    return rr(rr(join_thai(c), f"[{fixed.THAI_MARKS}]"), f"[^{THAI}]")


def boilerplate(c: str) -> str:
    return has_any(c, fixed.BOILERPLATE)


def junk(c: str, ratio: float = 0.5, lo: int = 4, hi: int = 90) -> str:
    v = trim(nn(c))
    terms = ", ".join(q(t) for t in fixed.GENERIC_TERMS)
    return (
        f"(length({v}) < {lo} or length({v}) > {hi} or {rm(v, chr(91) + '=|><' + chr(34) + chr(92) * 2 + chr(93))}"
        f" or {boilerplate(v)} or {v} in ({terms})"
        f" or length({v}) - length({rr(v, f'[{THAI}]')}) < {ratio} * length({v}))"
    )


def clean_facility(c: str) -> str:
    v = rr(nn(c), rf"^{DOT}*?(?:{alt(fixed.FACILITY_LEAD)})")
    v = rr(rr(v, "^ชื่อ"), rf"(?:{alt(fixed.FACILITY_END)}){DOT}*\z")
    return rr(v, rf"^[{BLANK}:.,ๆ]+|[{BLANK}:.,ๆ]+\z")


def clean_person(c: str) -> str:
    v = rr(nn(c), rf"^{DOT}*?(?:{alt(fixed.PERSON_LEAD)}){WS}*")
    v = rr(rr(v, rf"(?:{alt(fixed.PERSON_END)}){DOT}*\z"), f"[^{THAI} ]")
    return trim(rr(v, " +", " "))


def labelled(t: str, labels, n: int) -> str:
    return trim(rx(t, rf"(?i)(?:{alt(labels)}){WS}*[:{BLANK}.]*([^\n]{{2,{n}}})"))


def check_digit(d: str) -> str:
    total = " + ".join(
        f"try_cast(substr({d}, {i}, 1) as int) * {w}" for i, w in enumerate(range(13, 1, -1), 1)
    )
    ok = f"(11 - ({total}) % 11) % 10 = try_cast(substr({d}, 13, 1) as int)"
    return f"(case when length({d}) = 13 then {ok} else false end)"


def valid_id(c: str) -> str:
    return check_digit(digits(nn(c)))


_MON = alt(fixed.THAI_MONTHS)
_W = f"{WS}*"
_ERA = rf"(?:พ\.?ศ\.?)?{_W}"
P_ISO = "([0-9]{4})-([0-9]{2})-([0-9]{2})"
P_NUM = rf"([0-9]{{1,2}}){_W}[/.\-]{_W}([0-9]{{1,2}}){_W}[/.\-]{_W}([0-9]{{2,4}})"
P_WORD = rf"([0-9]{{1,2}}){_W}({_MON}){_W}{_ERA}([0-9]{{2,4}})"
P_LONG = rf"วันที่{_W}([0-9]{{1,2}}){_W}เดือน{_W}({_MON}){_W}{_ERA}([0-9]{{2,4}})"
P_ANY = (
    rf"[0-9]{{1,2}}{_W}(?:{_MON}){_W}{_ERA}[0-9]{{2,4}}"
    rf"|[0-9]{{1,2}}{_W}[/.\-]{_W}[0-9]{{1,2}}{_W}[/.\-]{_W}[0-9]{{2,4}}"
)


def parse_date(c: str) -> str:
    t = ascii_digits(join_thai(nn(c)))

    def num(p: str, g: int) -> str:
        return f"try_cast({rx(t, p, g)} as int)"

    def year(p: str) -> str:
        y = f"({num(p, 3)} + case when length({rx(t, p, 3)}) = 2 then 2500 else 0 end)"
        return f"({y} - case when {y} > 2400 then 543 else 0 end)"

    def month(p: str) -> str:
        whens = " ".join(f"when {q(k)} then {v}" for k, v in fixed.THAI_MONTHS.items())
        return f"(case {rx(t, p, 2)} {whens} end)"

    def day(y: str, m: str, d: str) -> str:
        ok = f"{y} <> 0 and {m} between 1 and 12 and {d} between 1 and 31"
        return f"case when {ok} then make_date({y} + case when {y} < 100 then 1900 else 0 end, {m}, 1) + ({d} - 1) end"

    return (
        f"(case when {rm(t, P_ISO)} then {day(num(P_ISO, 1), num(P_ISO, 2), num(P_ISO, 3))}"
        f" when {rm(t, P_NUM)} then {day(year(P_NUM), num(P_NUM, 2), num(P_NUM, 1))}"
        f" when {rm(t, P_WORD)} then {day(year(P_WORD), month(P_WORD), num(P_WORD, 1))}"
        f" when {rm(t, P_LONG)} then {day(year(P_LONG), month(P_LONG), num(P_LONG, 1))} end)"
    )


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def expiry_ctes(src: str, out: str) -> list[str]:
    """``out``(k, raw, d, method) of the texts ``t`` of ``src``(k, t)."""
    lab = rf"(?i)(?:{alt(fixed.LABELS['expiry'])})[^\n]{{0,20}}?({P_ANY})"
    return [
        f"{out}_l as (select k, {trim(rx('t', lab))} raw, {parse_date(rx('t', lab))} d from {src})",
        f"{out}_a as (select k, unnest(l) r, generate_subscripts(l, 1) pos from (select k, {rall('t', f'({P_ANY})')} l from {src}))",
        f"{out}_b as (select k, {trim('r')} raw, {parse_date('r')} d, pos from {out}_a)",
        f"{out}_c as (select * from {out}_b where d is not null qualify row_number() over (partition by k order by d desc, pos) = 1)",
        f"{out} as (select s.k, case when l.d is not null then l.raw else c.raw end raw, coalesce(l.d, c.d) d, "
        f"case when l.d is not null then 'labelled' when c.d is not null then 'latest-date' end method "
        f"from {src} s left join {out}_l l on l.k = s.k left join {out}_c c on c.k = s.k)",
    ]


def similarity_ctes(src: str, key: str, out: str) -> list[str]:
    """``out``(key, match, score, via) of the names a, b of ``src``(key, a, b)."""
    titles = f"^(?i:{'|'.join(fixed.NAME_TITLES)}){WS}*"
    thai_titles = f"^(?:{'|'.join(fixed.THAI_TITLES)}){WS}*"

    def norm(c: str) -> str:
        return f"lower({trim(squeeze(rr(c, titles)))})"

    def both(a: str, b: str) -> str:
        return f"(contains({a}, {b}) or contains({b}, {a}))"

    def tokens(c: str) -> str:
        return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"

    hits = f"len(list_filter(pa, lambda x: len(list_filter(pb, lambda y: contains(x, y) or contains(y, x))) > 0))"
    return [
        f"{out}_n as (select {key}, {norm('a')} na, {norm('b')} nb, {skeleton(rr('a', thai_titles))} sa,"
        f" {skeleton(rr('b', thai_titles))} sb, {nn('a')} <> '' and {nn('b')} <> '' ok from {src})",
        f"{out}_p as (select *, {tokens('na')} pa, {tokens('nb')} pb from {out}_n)",
        f"{out}_s as (select {key}, case when not ok then 0.0 when na = nb then 1.0 when {both('na', 'nb')} then 0.9"
        f" when length(sa) >= 4 and length(sb) >= 4 and {both('sa', 'sb')} then 0.85"
        f" else {hits}::double / greatest(len(pa), len(pb)) end::double score,"
        f" case when ok and not {both('na', 'nb')} and length(sa) >= 4 and length(sb) >= 4 and {both('sa', 'sb')}"
        f" then 'skeleton' end via, ok from {out}_p)",
        f"{out} as (select {key}, ok and score >= 0.5 as match, score, via from {out}_s)",
    ]


# --- common tables -----------------------------------------------------------------------

G = f"g as ({std(standins.REGISTRY_SQL)})"
GK = (
    f"gk as (select *, {code_key('code')} code_key, {name_key('name')} name_key,"
    f" {name_key('owner')} owner_key from g)"
)
S = f"s as ({std(standins.SUBMISSIONS_SQL)})"
D = f"d as ({std(standins.DOCS_SQL)})"
GEN = "gen as (select name_key from gk where name_key <> '' group by 1 having count(*) >= 10)"
_AGG = "string_agg(id, ',' order by id) members, count(*) n, min(input_order) first_order, arg_min(name, input_order) first_name"
CLUSTERS = [
    G,
    GK,
    GEN,
    f"cc as (select code_key, {_AGG} from gk where code_key <> '' group by 1 having count(*) >= 2)",
    f"oa as (select name_key, owner_key, {_AGG} from gk where name_key <> '' and owner_key <> ''"
    " and name_key not in (select name_key from gen) group by 1, 2 having count(*) >= 2)",
    "oc as (select * from oa where members not in (select members from cc))",
    f"nc as (select name_key, {_AGG} from gk where name_key <> '' and name_key not in (select name_key from gen)"
    " group by 1 having count(*) >= 2 and members not in (select members from cc) and members not in (select members from oa))",
    f"""cl as (
      select 'code:' || code_key cluster_id, 'code' kind, 'strong' severity, {q(fixed.LABEL_CODE)} || code_key as label, n, first_order from cc
      union all select 'name+owner:' || name_key || ' ' || owner_key, 'name+owner', 'strong', {q(fixed.LABEL_NAME_OWNER)} || first_name, n, first_order from oc
      union all select 'name:' || name_key, 'name', 'weak', {q(fixed.LABEL_NAME)} || first_name, n, first_order from nc)""",
    """ed as (
      select 'code:' || code_key cluster_id, gk.* from gk join cc using (code_key)
      union all select 'name+owner:' || name_key || ' ' || owner_key, gk.* from gk join oc using (name_key, owner_key)
      union all select 'name:' || name_key, gk.* from gk join nc using (name_key))""",
]
IDS = "ids as (select distinct id, severity from ed join cl using (cluster_id))"


def audit_ctes(base: list[str], sla: int) -> list[str]:
    flags = f"""list_filter([
      case when st.id is not null then 'fail:{fixed.FLAG_STRONG}' when wk.id is not null then 'warn:{fixed.FLAG_WEAK}' end,
      case when {nn('code')} = '' then 'fail:{fixed.FLAG_NO_CODE}' end,
      case when gk.name_key in (select name_key from gen) then 'warn:{fixed.FLAG_GENERIC}' end,
      case when o.n >= 5 then 'warn:' || replace('{fixed.FLAG_OWNER}', '%d', o.n::varchar) end,
      case when sla >= {sla} then 'warn:' || replace('{fixed.FLAG_SLA}', '%d', sla::varchar) end], lambda x: x is not null)"""
    return [
        *base,
        IDS,
        "oc5 as (select owner_key, count(*) n from gk where owner_key <> '' group by 1)",
        f"""fl as (select gk.*, {flags} fl from gk
          left join (select id from ids where severity = 'strong') st on st.id = gk.id
          left join (select id from ids where severity = 'weak') wk on wk.id = gk.id
          left join oc5 o on o.owner_key = gk.owner_key)""",
        """au as (select *, array_to_string(fl, '|') flags, len(fl) > 0 flagged, len(fl) n_flags,
          len(list_filter(fl, lambda x: starts_with(x, 'fail'))) > 0 failed from fl)""",
    ]


_REQ = (
    "rq as (select *, " + code_key("case when coalesce(hcode, '') = '' then health_unit_hcode else hcode end") + " code_key, "
    + name_key("health_unit_name") + " name_key, " + name_key("authority_name") + " owner_key from s)"
)
PAIRS = [
    G,
    GK,
    GEN,
    S,
    _REQ,
    """pr as (select r.request_id, r.code_key rc, r.name_key rn, r.owner_key ro, gk.id, gk.code, gk.name, gk.status, gk.input_order,
      r.code_key <> '' and r.code_key = gk.code_key same_code, r.name_key <> '' and r.name_key = gk.name_key same_name,
      r.owner_key <> '' and r.owner_key = gk.owner_key same_owner, r.name_key in (select name_key from gen) generic
      from rq r join gk on gk.id <> r.hu_id)""",
    f"""dm as (select *, case when same_code then '{fixed.WHY_CODE}' when same_name and same_owner and not generic then '{fixed.WHY_NAME_OWNER}'
      when same_name and not generic then '{fixed.WHY_NAME}' end why from pr where same_code or same_name or same_owner)""",
    f"""dc as (select rq.request_id, count(*) filter (why = '{fixed.WHY_CODE}') strong_code_n,
      count(*) filter (why = '{fixed.WHY_NAME_OWNER}') strong_owner_n, count(*) filter (why = '{fixed.WHY_NAME}') weak_n,
      count(*) filter (same_owner) owner_n, rq.name_key in (select name_key from gen) generic, (select count(*) from g) checked
      from rq left join dm on dm.request_id = rq.request_id group by rq.request_id, rq.name_key)""",
    f"""tk as (select m.request_id, row_number() over (partition by m.request_id order by input_order) as rank, why, id, name, code, status,
      greatest(case when strong_code_n + strong_owner_n > 0 then strong_code_n + strong_owner_n else weak_n end - 8, 0) remaining
      from dm m join dc using (request_id)
      where why is not null and (why <> '{fixed.WHY_NAME}' or strong_code_n + strong_owner_n = 0) qualify rank <= 8)""",
    """ow as (select m.request_id, owner_n units, row_number() over (partition by m.request_id order by input_order) as rank, id, name, code,
      status, greatest(owner_n - 6, 0) remaining from dm m join dc using (request_id) where same_owner qualify rank <= 6)""",
]


# --- registry ------------------------------------------------------------------------------

_raw = std(standins.RAW_REGISTRY_SQL)
ORACLES["registry_clean"] = f"""
select {strip('hu_id')} id, {strip('hu_code')} code, {strip('hu_name')} name, {strip('hu_type_name')} type, {strip('status')} status,
  {strip("coalesce(member_fname, '') || ' ' || coalesce(member_lname, '')")} owner,
  coalesce(try_cast({digits(strip('sla'))} as bigint), 0) sla, {strip('create_date')} create_date, input_order
from ({_raw}) r"""
_LANDED = [
    f"lp as ({std(standins.LANDED_SQL)})",
    f"""pg as (select snapshot, copy, start::bigint start, count(*) n, max(total) total from lp group by 1, 2, 3
      union all select 'cut', 0, {2 * standins.PAGES_OF}, 0, 0)""",
    """ck as (select *, greatest(coalesce(max(start + n) over (partition by snapshot order by start, n desc, copy
        rows between unbounded preceding and 1 preceding), 0), 0) covered,
      arg_min(total, start) over (partition by snapshot) records_total,
      coalesce(min(case when n = 0 then start end) over (partition by snapshot), 1000000000) stop from pg)""",
    """rp as (select *, greatest(start - covered, 0) missing_before, least(greatest(covered - start, 0), n) repeated,
      start = 0 or (start < records_total and start < stop) used from ck)""",
]
ORACLES["registry_pages"] = ctes(
    *_LANDED, select="select snapshot, start, n as rows, records_total, missing_before, repeated, used from rp"
)
ORACLES["registry_landings"] = ctes(
    *_LANDED,
    select="""select *, greatest(records_total - rows_read, 0) rows_missing, rows_read >= records_total complete from (
  select snapshot, count(*) pages, max(records_total) records_total, coalesce(sum(n - repeated) filter (where used), 0)::bigint rows_read,
    coalesce(sum(repeated) filter (where used), 0)::bigint rows_repeated from rp group by 1)""",
)
ORACLES["registry_assembled"] = ctes(
    *_LANDED,
    select=f"""select r.snapshot, {strip('hu_id')} id, {strip('hu_code')} code, {strip('hu_name')} name, {strip('hu_type_name')} type, {strip('status')} status,
  {strip("coalesce(member_fname, '') || ' ' || coalesce(member_lname, '')")} owner,
  coalesce(try_cast({digits(strip('sla'))} as bigint), 0) sla, {strip('create_date')} create_date, r.place input_order
from lp r join rp on rp.snapshot = r.snapshot and rp.copy = r.copy and rp.start = r.start
where used and r.place - r.start >= repeated""",
)
ORACLES["registry_keys"] = ctes(G, GK, select="select id, code_key, name_key, owner_key from gk")
ORACLES["generic_names"] = ctes(
    G, GK, select="select name_key, count(*) n from gk where name_key <> '' group by 1 having count(*) >= 10"
)
ORACLES["owner_counts"] = ctes(
    G, GK, select="select owner_key, count(*) n from gk where owner_key <> '' group by 1"
)
ORACLES["dup_clusters"] = ctes(*CLUSTERS, select="select * from cl")
ORACLES["cluster_edges"] = ctes(
    *CLUSTERS, select="select cluster_id, kind, severity, n, id, code, name, status from ed join cl using (cluster_id)"
)
ORACLES["flagged_ids"] = ctes(*CLUSTERS, IDS, select="select id, severity from ids")
ORACLES["sweep_totals"] = ctes(
    *CLUSTERS,
    select="""select severity || '_clusters' measure, count(*) n from cl group by 1
union all select 'generic_names', count(*) from gen union all select 'scanned', count(*) from g""",
)
ORACLES["weak_cluster_topk"] = ctes(
    *CLUSTERS,
    "tp as (select * from cl where severity = 'weak' order by first_order limit 60)",
    select="select cluster_id, label, n, id, substr(name, 1, 28) short_name, status from ed join tp using (cluster_id)",
)
_audit_cols = "id, code, name, status, flags, flagged, failed"
ORACLES["registry_audit"] = ctes(*audit_ctes(CLUSTERS, 45), select=f"select {_audit_cols} from au")
_BIG = """g as (select o_orderkey::varchar id,
  case when o_orderkey % 50 = 0 then '' else lpad((o_orderkey - case when o_orderkey % 20 = 7 then 1 else 0 end)::varchar, 12, '0') end code,
  case when o_orderkey % 3 = 0 then c_mktsegment else c_mktsegment || ' ' || (o_orderkey // 6)::varchar end as name,
  o_orderpriority as type, o_orderstatus status, c_name as owner, datediff('day', o_orderdate::date, date '2001-08-02') sla,
  o_orderkey input_order from orders join customer on o_custkey = c_custkey)"""
ORACLES["registry_audit_big"] = ctes(
    *audit_ctes([_BIG, *CLUSTERS[1:]], 2000), select=f"select {_audit_cols} from au"
)
ORACLES["audit_headline"] = ctes(
    *audit_ctes(CLUSTERS, 15),
    select="""select count(*) scanned, count(*) filter (failed) failed, count(*) filter (flagged and not failed) review,
  count(*) filter (not flagged) clean, (select count(*) from cl where severity = 'strong') strong_clusters,
  (select count(*) from cl where severity = 'weak') weak_clusters from au""",
)
ORACLES["flagged_topk"] = ctes(
    *audit_ctes(CLUSTERS, 15),
    select="""select id, code, substr(name, 1, 30) short_name, status, flags, n_flags, failed from au where flagged
  order by failed desc, n_flags desc, input_order limit 300""",
)
ORACLES["flagged_shown"] = ctes(
    *audit_ctes(CLUSTERS, 15),
    select="""select id, n_flags, least(300, n_flagged) n_shown, n_flagged
  from (select *, count(*) over () n_flagged from au where flagged)
  order by failed desc, n_flags desc, input_order limit 300""",
)
ORACLES["flagged_report"] = ctes(
    *audit_ctes(CLUSTERS, 15), select="select id, code, name, status, flags from au where flagged"
)
_queue = f"select id, '{standins.HOST}/admin/checklist/' || id as url, input_order from g where contains(status, '{fixed.PENDING_STATUS}') and id <> ''"
ORACLES["pending_requests"] = ctes(G, select=_queue)
ORACLES["deep_check_queue"] = ctes(G, select=_queue + " order by input_order limit 25")

# --- duplicate lookup -------------------------------------------------------------------------

ORACLES["dup_counts"] = ctes(*PAIRS, select="select * from dc")
ORACLES["dup_matches"] = ctes(
    *PAIRS,
    select=f"""select request_id, case why when '{fixed.WHY_CODE}' then 'code' when '{fixed.WHY_NAME_OWNER}' then 'name+owner' else 'name' end kind,
  case when why = '{fixed.WHY_CODE}' then rc else '' end g_code, case when why = '{fixed.WHY_CODE}' then '' else rn end g_name,
  case when why = '{fixed.WHY_NAME_OWNER}' then ro else '' end g_owner, case when why = '{fixed.WHY_NAME}' then 'weak' else 'strong' end severity,
  why, count(*) n from dm where why is not null group by all""",
)
ORACLES["dup_group_members"] = ctes(
    G,
    GK,
    select="""select 'code' kind, code_key g_code, '' g_name, '' g_owner, id, code, name, status from gk where code_key <> ''
union all select 'name', '', name_key, '', id, code, name, status from gk where name_key <> ''
union all select 'name+owner', '', name_key, owner_key, id, code, name, status from gk where name_key <> '' and owner_key <> ''
union all select 'owner', '', '', owner_key, id, code, name, status from gk where owner_key <> ''""",
)
ORACLES["dup_topk"] = ctes(*PAIRS, select="select * from tk")
ORACLES["owner_footprint"] = ctes(*PAIRS, select="select * from ow")

# --- validators ---------------------------------------------------------------------------------


def code_status(c: str) -> str:
    v = trim(c)
    return (
        f"case when {nn(c)} = '' then null when {rm(v, '^[A-Za-z]+$')} then 'fail' when {rm(v, '^(?i:TEST)')} then 'fail'"
        f" when {rm(v, '^[A-Za-z0-9]{9}$')} then 'pass' else 'warn' end"
    )


def email_status(c: str) -> str:
    part = f"[^{BLANK}@]+"
    ok = rm(c, f"^{part}@{part}[.]{part}$")
    return f"case when {nn(c)} = '' then 'warn' when {ok} then 'pass' else 'fail' end"


def presence(c: str, missing: str = "fail") -> str:
    return f"case when length({trim(nn(c))}) > 0 then 'pass' else '{missing}' end"


PHONE_OK = rm(rr("phone", f"[{BLANK}-]"), "^0[0-9]{8,9}$")
POSTAL_OK = rm("postal_code", "^[0-9]{5}$")


def id_reason(c: str) -> str:
    d = digits(nn(c))
    return (
        f"case when {nn(c)} = '' then 'ไม่มีเลขบัตร' when length({d}) <> 13 then 'ต้อง 13 หลัก (พบ ' || length({d})::varchar || ')'"
        f" when {check_digit(d)} then 'Checksum ถูกต้อง ' else 'Checksum ไม่ถูกต้อง ' end"
    )


ORACLES["code_format"] = ctes(S, select=f"select request_id, hcode, {code_status('hcode')} status from s")
ORACLES["email_check"] = ctes(S, select=f"select request_id, email, {email_status('email')} status from s")
ORACLES["phone_check"] = ctes(
    S, select=f"select request_id, {presence('phone', 'warn')} status, phone <> '' and {PHONE_OK} format_ok from s"
)
ORACLES["postal_check"] = ctes(
    S, select=f"select request_id, {presence('postal_code', 'warn')} status, postal_code <> '' and {POSTAL_OK} format_ok from s"
)
ORACLES["thai_id_check"] = ctes(
    S,
    select=f"""select request_id, {valid_id('authority_id')} as valid, {id_reason('authority_id')} reason,
  {digits('authority_id')} = {digits('admin_id')} same_person from s""",
)
_canon = f"{rm('hcode', '^[0-9]{9}$')} or {rm('hcode', '^[A-Z]{2}[0-9]{7}$')}"
ORACLES["presence_check"] = ctes(
    S,
    select=f"""select request_id, {presence('health_unit_type')} unit_type, {presence('address', 'warn')} address,
  case when hcode <> '' then case when {_canon} then 'pass' else 'warn' end end canonical_code from s""",
)
ORACLES["person_names"] = """
select c_custkey, case when c_custkey % 4 > 0 or c_custkey % 5 > 0 then
  trim(case when c_custkey % 3 = 0 then 'นาย ' else '' end || case when c_custkey % 4 > 0 then c_name || ' ' else '' end
    || case when c_custkey % 5 > 0 then c_mktsegment else '' end) end as name from customer"""
ORACLES["name_similarity"] = ctes(
    S,
    "src as (select request_id, authority_name a, admin_name b from s)",
    *similarity_ctes("src", "request_id", "sim"),
    select="select request_id, a authority, b as admin, match, round(score, 4) score, via from src join sim using (request_id)",
)
ORACLES["name_similarity_registry"] = ctes(
    G,
    "x as (select input_order, name || ' ' || type || ' ' || owner a from g)",
    "src as (select x.input_order, x.a, y.a b from x join x y on y.input_order - 1 = x.input_order)",
    *similarity_ctes("src", "input_order", "sim"),
    select="select input_order, match, round(score, 4) score, via from sim",
)

# --- text, dates -------------------------------------------------------------------------------

LINES = "ln as (select k, generate_subscripts(l, 1) - 1 line, unnest(l) v from (select k, string_split(text, chr(10)) l from d))"
T = f"tx as (select k, {normal('text')} t from d)"
ORACLES["text_normalise"] = ctes(
    D, select=f"select k, {join_thai('text')} joined, {ascii_digits('text')} digits, {normal('text')} normalised from d"
)
ORACLES["skeleton"] = ctes(D, select=f"select k, {skeleton('text')} skeleton from d")
ORACLES["html_text"] = f"select page_id, {strip('html')} as text from pages"
ORACLES["junk_filter"] = ctes(
    D,
    LINES,
    select=f"select k, line, {boilerplate('v')} boilerplate, {junk('v')} junk, {junk('v', 0.3, 2, 20)} junk_loose from ln",
)
ORACLES["clean_names"] = ctes(
    D, LINES, select=f"select k, line, {clean_facility('v')} facility, {clean_person('v')} person from ln"
)
_months = "[" + ", ".join(q(m) for m in fixed.THAI_MONTHS) + "]"
ORACLES["thai_dates"] = ctes(
    f"""f as (select o_orderkey, (o_orderkey % 32)::varchar dd, {_months}[o_orderkey % 24 + 1] mm, year(o_orderdate) + 543 yy,
      o_orderdate od, o_orderkey k from orders)""",
    """r as (select o_orderkey, case k % 6 when 0 then strftime(od, '%Y-%m-%d') when 1 then dd || '/' || (k % 14)::varchar || '/' || yy::varchar
      when 2 then dd || '-' || (k % 13)::varchar || '-' || (yy % 100)::varchar when 3 then dd || ' ' || mm || ' พ.ศ. ' || yy::varchar
      when 4 then 'วันที่ ' || dd || ' เดือน ' || mm || ' พ.ศ. ' || yy::varchar else dd || mm || '๖๘' end raw from f)""",
    select=f"select o_orderkey, raw, {iso(parse_date('raw'))} parsed from r",
)
EXP = expiry_ctes("tx", "ex")
ORACLES["expiry_extract"] = ctes(D, T, *EXP, select=f"select k, raw, {iso('d')} as day, method from ex")
_years_off = "(epoch(timestamp '2010-01-01 00:00:00') - epoch(d::timestamp)) / (365.25 * 86400)"
ORACLES["expiry_status"] = ctes(
    D,
    T,
    *EXP,
    select=f"select k, d::timestamp < {AS_OF} expired, coalesce({_years_off} > 10, false) implausible from ex",
)

# --- documents -----------------------------------------------------------------------------------

_GAP = rf"[{BLANK}-]*"


def thai_id(t: str) -> str:
    u = f"translate({t}, '{fixed.CONFUSABLE_LETTERS}{fixed.THAI_DIGITS}', '{fixed.CONFUSABLE_DIGITS}{fixed.ASCII_DIGITS}')"
    grouped = digits(
        rx(u, rf"([0-9]{_GAP}[0-9]{{4}}{_GAP}[0-9]{{5}}{_GAP}[0-9]{{2}}{_GAP}[0-9])(?:[^0-9]|$)")
    )
    # Every non-digit is doubled so that neighbouring runs keep a border each.
    bare = rall(rr(u, "([^0-9])", r"\1\1"), "(?:^|[^0-9])([0-9]{13})(?:[^0-9]|$)")
    lines = f"list_filter(string_split({join_thai(u)}, chr(10)), lambda x: {has_any('x', fixed.LABELS['id_number'])})"
    found = f"list_filter(list_concat(list_concat([{grouped}], {bare}), list_transform({lines}, lambda x: {digits('x')})), lambda x: length(x) = 13)"
    return f"(select coalesce(list_filter(z, lambda x: {check_digit('x')})[1], z[1]) from (select {found} z))"


def doc_type(t: str) -> str:
    whens = " ".join(f"when {has_any(f'lower({t})', w)} then '{n}'" for n, w in fixed.DOC_TYPE_WORDS)
    return f"case {whens} else 'general' end"


_TITLED = f"(?:{'|'.join(fixed.THAI_TITLES)})"


def person(t: str, labels) -> str:
    v = trim(squeeze(rx(labelled(t, labels, 55), f"({_TITLED}[{THAI}{BLANK}]{{2,45}})")))
    return f"case when not {junk(v)} then {v} end"


def unless_junk(v: str, ratio: float = 0.5) -> str:
    return f"case when not {junk(v, ratio)} then {v} end"


_RUN = rf"({NOT_WS}{{0,30}}(?:{'|'.join(fixed.FACILITY_KINDS)})[^\n]{{0,40}})"
_L = fixed.LABELS
_distinct = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_names = rall("t", rf"({_TITLED}{WS}*[{THAI}]+{WS}+[{THAI}]+)")
_orgs = rall("t", rf"((?:{'|'.join(fixed.ORGANISATION_KINDS)}){WS}*{NOT_WS}+)")
NAMES = f"case when len({_names}) > 0 then array_to_string({_distinct.format(l=_names)}[1:5], '|') end"
_org_kept = f"list_filter({_distinct.format(l=_orgs)}, lambda x: not {boilerplate('x')})"
ORGS = f"case when len({_orgs}) > 0 then array_to_string({_org_kept}[1:5], '|') end"
EXCERPT = f"case when length({trim('t')}) > 0 then {squeeze(f'substr({trim(chr(116))}, 1, 120)')} end"
_LATIN = rf"Name{WS}*[:{BLANK}]*((?:Mr\.|Mrs\.|Ms\.)?{WS}*[A-Za-z]+(?:{WS}+[A-Za-z]+)*)"
_kinds = "|".join(fixed.FACILITY_KIND_WORDS)
_LIC = "doc_type in ('pharmacy_license', 'license_sp7', 'license_sp19')"
_ALL = "concat_ws(' ', label, url, text)"
READ = [
    D,
    f"dt as (select *, {doc_type(_ALL)} doc_type, {normal('text')} t from d)",
    *expiry_ctes("dt", "ex"),
    f"""f1 as (select dt.*, ex.raw e_raw, ex.d e_d, ex.method e_m,
      {_LIC} lic, doc_type = 'id_card' card, doc_type = 'general' gen,
      {thai_id('t')} tid, {clean_facility(labelled('t', _L['facility_name'], 80))} fac1,
      list_transform({rall('t', _RUN)}, lambda x: {clean_facility('x')}) runs,
      {person('t', _L['owner_name'])} own, {person('t', _L['operator_name'])} ope, {person('t', _L['pharmacist_name'])} pha,
      {rx(labelled('t', _L['license_number'], 30), '(?i)[ก-ฮA-Z0-9/-]{2,}[0-9]+', 0)} lno,
      {unless_junk(labelled('t', _L['address'], 120), 0.3)} adr_l, {unless_junk(labelled('t', _L['address'], 110), 0.3)} adr_c,
      {unless_junk(labelled('t', _L['facility_type'], 60))} fty,
      coalesce(nullif({clean_person(labelled('t', _L['person_name'], 60))}, ''),
        nullif({clean_person(rx('t', f'({_TITLED}[{THAI}]{{2,40}})'))}, '')) per,
      nullif({trim(squeeze(rx('t', _LATIN)))}, '') lat, {NAMES} nms, {ORGS} ogs, {EXCERPT} exc
      from dt join ex on ex.k = dt.k)""",
    f"""f2 as (select *, case when lic then case when not {junk('fac1')} then fac1
        else list_filter(runs, lambda x: not {junk('x')} and length({trim(rr('x', _kinds))}) >= 3)[1] end end facility_name,
      case when card and length(per) >= 4 and not {boilerplate('per')} then per end name_th from f1)""",
    f"""rd as (select k, request_id, doc_ordinal, url, label, status, text, doc_type,
      case when card then tid end id_number, case when card and tid is not null then {valid_id('tid')} end id_number_valid, name_th,
      {skeleton('name_th')} name_th_skeleton, name_th as name, case when card then lat end name_en,
      case when lic or card then e_raw end expiry_date, case when lic or card then {iso('e_d')} end expiry_date_parsed,
      case when lic then e_m end expiry_method, case when lic then adr_l when card then adr_c end address,
      case when lic then nullif(lno, '') end license_number, facility_name,
      case when doc_type = 'license_sp19' then coalesce(own, ope) when lic then own end owner_name,
      case when lic then ope end operator_name, case when lic then pha end pharmacist_name, case when lic then fty end facility_type,
      case when doc_type = 'pharmacy_license' then facility_name end pharmacy_name,
      case when gen and {valid_id('tid')} then tid end id_numbers, case when gen then nms end names_found,
      case when gen then ogs end organizations_found, case when gen then e_raw end dates_found, gen, exc from f2)""",
    """rf as (select * exclude (gen, exc), case when gen and coalesce(id_numbers, names_found, organizations_found, dates_found) is null then exc end text_excerpt from rd)""",
]
_fields = [
    "id_number", "name_th", "name_th_skeleton", "name", "name_en", "expiry_date", "expiry_date_parsed", "expiry_method",
    "address", "license_number", "facility_name", "owner_name", "operator_name", "pharmacist_name", "facility_type",
    "pharmacy_name", "text_excerpt", "id_number_valid", "id_numbers", "names_found", "organizations_found", "dates_found",
]
_any = "coalesce(" + ", ".join(f for f in _fields if f != "id_number_valid") + ") is not null"
ORACLES["thai_id_extract"] = ctes(D, T, select=f"select k, {thai_id('t')} id_number from tx")
ORACLES["labelled_values"] = ctes(
    D,
    T,
    select=f"""select k, {labelled('t', _L['facility_name'], 80)} facility, {labelled('t', _L['owner_name'], 55)} as owner,
  {labelled('t', _L['license_number'], 30)} license, {labelled('t', _L['person_name'], 60)} person from tx""",
)
ORACLES["doc_type"] = ctes(D, select=f"select k, label, {doc_type(_ALL)} doc_type from d")
_img = rf"contains(content_type, 'image') or {rm('url', '(?i)[.](jpg|jpeg|png|gif|bmp|webp)([?]|$)')}"
_pdf = rf"contains(content_type, 'pdf') or {rm('url', '(?i)[.]pdf([?]|$)')}"
_ct = "lower(trim(split_part(content_type, ';', 1)))"
ORACLES["doc_routes"] = ctes(
    D,
    select=f"""select k, case when {_img} then 'image' when {_pdf} then 'pdf' else 'fallback' end route,
  case when {_img} then case when contains(content_type, 'image') then content_type when {rm('url', '(?i)[.]png([?]|$)')} then 'image/png' else 'image/jpeg' end end image_type,
  case when {_ct} = 'image/jpg' then 'image/jpeg' when {_ct} in ({", ".join(q(m) for m in fixed.MODEL_MIME_TYPES)}) then {_ct}
    when {rm('url', '(?i)[.]pdf([?]|$)')} then 'application/pdf' when {rm('url', '(?i)[.]png([?]|$)')} then 'image/png'
    when {rm('url', '(?i)[.](jpe?g)([?]|$)')} then 'image/jpeg' end model_mime,
  length({trim('text')}) < 20 scanned from d""",
)
ORACLES["doc_fields"] = ctes(
    *READ,
    select=f"""select k, doc_type, {", ".join(_fields)}, case when status = 'error' then 'fail' when {_any} then 'pass'
  when length({trim('text')}) > 0 then 'warn' else 'fail' end outcome from rf""",
)
ORACLES["free_text_entities"] = ctes(
    D, T, select=f"select k, {NAMES} as names, {ORGS} organisations, {EXCERPT} excerpt from tx"
)

# --- comparisons ---------------------------------------------------------------------------------

_HA = r"(?i)HospitalAdmin|hospital_admin|\bHA\b"
ROUTE = f"""rt as (select x.*, s.health_unit_name, is_admin_doc,
  case when is_admin_doc then '{fixed.PERSON_ADMIN}' else '{fixed.PERSON_AUTHORITY}' end person_label,
  case when is_admin_doc then admin_name else authority_name end person_name,
  case when is_admin_doc then admin_id else authority_id end person_id
  from (select *, {rm("concat_ws(' ', url, label)", _HA)} is_admin_doc from {{src}}) x join s on s.request_id = x.request_id)"""
ORACLES["doc_person_route"] = ctes(
    S, D, ROUTE.format(src="d"), select="select k, is_admin_doc, person_label, person_name, person_id from rt"
)
_g = "coalesce({}, '') <> ''"
_src = "coalesce(nullif(label, ''), doc_type)"
_exp_off = f"(epoch({AS_OF}) - epoch(exd::timestamp)) / (365.25 * 86400)"


def _cmp(row: int, field: str, form: str, doc: str, match: str, score: str, note: str, where: str) -> str:
    return (
        f"select request_id, doc_ordinal, {row}::bigint as row, {_src} source, {field} field, {form} form_value, {doc} document_value,"
        f" {match} as match, ({score})::double score, {note} note from cm where {where}"
    )


COMPARE = [
    S,
    *READ,
    ROUTE.format(src="rf"),
    f"""c0 as (select *, coalesce(nullif(facility_name, ''), pharmacy_name) fac, coalesce(owner_name, operator_name, pharmacist_name, name_th) own,
      {parse_date("coalesce(nullif(expiry_date_parsed, ''), expiry_date)")} exd from rt where status = 'success')""",
    "su as (select k, fac a, health_unit_name b from c0)",
    "sp as (select k, own a, person_name b from c0)",
    *similarity_ctes("su", "k", "simu"),
    *similarity_ctes("sp", "k", "simp"),
    """cm as (select c0.*, simu.match um, simu.score us, simp.match pm, simp.score ps, simp.via pv
      from c0 join simu on simu.k = c0.k join simp on simp.k = c0.k)""",
    "cmp as ("
    + " union all ".join(
        [
            _cmp(0, q(fixed.FIELD_FACILITY), "health_unit_name", "fac", "um", "us", "''", f"{_g.format('fac')} and {_g.format('health_unit_name')}"),
            _cmp(1, f"'{fixed.FIELD_NAME}' || person_label", "person_name", "own", "pm", "ps", f"case when pv = 'skeleton' then '{fixed.NOTE_SKELETON}' else '' end", f"{_g.format('own')} and {_g.format('person_name')}"),
            _cmp(1, f"'{fixed.FIELD_NAME}' || person_label", "person_name", f"name_en || '{fixed.SUFFIX_ENGLISH}'", "false", "0", q(fixed.NOTE_ENGLISH_ONLY), f"not ({_g.format('own')}) and {_g.format('name_en')} and {_g.format('person_name')}"),
            _cmp(2, f"'{fixed.FIELD_ID}' || person_label", "person_id", "id_number", f"{digits('id_number')} = {digits('person_id')}", f"case when {digits('id_number')} = {digits('person_id')} then 1 else 0 end", f"case when {digits('id_number')} = {digits('person_id')} then '{fixed.NOTE_ID_SAME}' else '{fixed.NOTE_ID_DIFFERENT}' end", f"{_g.format('id_number')} and {_g.format('person_id')}"),
            _cmp(3, q(fixed.FIELD_LICENSE), q(fixed.FORM_HAS_NO_LICENSE), "license_number", "true", "1", q(fixed.NOTE_LICENSE), _g.format("license_number")),
            _cmp(4, q(fixed.FIELD_EXPIRY), f"case when exd is null then '{fixed.EXPIRY_UNREADABLE}' when {_exp_off} > 10 then '{fixed.EXPIRY_IMPLAUSIBLE}' when exd < {AS_OF} then '{fixed.EXPIRED}' else '{fixed.NOT_EXPIRED}' end", "expiry_date", f"coalesce(exd >= {AS_OF}, false)", f"case when exd >= {AS_OF} then 1 else 0 end", f"case when exd is null then '{fixed.NOTE_MANUAL}' when {_exp_off} > 10 then '{fixed.NOTE_IMPLAUSIBLE}' when exd < {AS_OF} then '{fixed.NOTE_EXPIRED}' else '{fixed.NOTE_NOT_EXPIRED}' end", _g.format("expiry_date")),
        ]
    )
    + ")",
    f"""mr as (select *, case when contains(note, '{fixed.MANUAL_WORD}') then 'manual' when match then 'match' else 'mismatch' end verdict from cmp)""",
]
ORACLES["comparisons"] = ctes(*COMPARE, select="select * replace (round(score, 4) as score) from cmp")
ORACLES["match_rows"] = ctes(*COMPARE, select="select * exclude (match, score) from mr")
ORACLES["match_counts"] = ctes(
    *COMPARE,
    select="""select s.request_id, coalesce(any_value(m.matched), 0) matched, coalesce(any_value(m.mismatched), 0) mismatched,
  coalesce(any_value(m.manual), 0) manual, count(*) filter (d.status = 'success') documents_read, count(d.request_id) documents_total
  from s left join d on d.request_id = s.request_id left join (select request_id, count(*) filter (verdict = 'match') matched, count(*) filter (verdict = 'mismatch') mismatched,
    count(*) filter (verdict = 'manual') manual from mr group by 1) m on m.request_id = s.request_id group by 1""",
)
_item_rows = " union all ".join(
    f"select {i + 1} gid, {q(t)} document, {j + 1} iid, {q(label)} as label"
    for i, t in enumerate(standins.GROUP_TITLES)
    for j, label in enumerate(standins.GROUP_ITEMS[i])
)
ITEMS = [f"it as ({_item_rows})", "si as (select request_id, k, it.* from s join it on it.gid <= s.n_groups)"]
_key = f"substr({rr('si.document', f'{WS}+')}, 1, 12)"


def _evidence(word: str) -> str:
    src = rr("c.source", f"{WS}+")
    return f"exists (select 1 from cmp c where c.request_id = si.request_id and c.match and contains(c.field, '{word}') and contains({src}, {_key}))"


ORACLES["uncovered_items"] = ctes(
    *COMPARE,
    *ITEMS,
    f"""cv as (select request_id, bool_or(contains(field, '{fixed.ITEM_NAME_WORD}')) hn, bool_or(contains(field, '{fixed.FIELD_EXPIRY}')) he from cmp group by 1)""",
    select=f"""select si.request_id, document, label from si left join cv on cv.request_id = si.request_id
  where not ((contains(label, '{fixed.ITEM_NAME_WORD}') and coalesce(hn, false)) or (contains(label, '{fixed.ITEM_EXPIRY_WORD}') and coalesce(he, false)))""",
)
VERDICTS = [
    *COMPARE,
    *ITEMS,
    f"""iv0 as (select si.*, (contains(label, '{fixed.ITEM_NAME_WORD}') and {_evidence(fixed.ITEM_NAME_WORD)})
      or (contains(label, '{fixed.ITEM_NOT_EXPIRED_WORD}') and {_evidence(fixed.FIELD_EXPIRY)}) ok from si)""",
    f"""iv as (select request_id, gid::varchar group_id, iid::varchar item_id, label, document, case when ok then 'verified' else 'pending' end state,
      case when ok then '{fixed.REASON_OK}' when contains(label, '{fixed.ITEM_NOT_EXPIRED_WORD}') then '{fixed.REASON_NO_EXPIRY}' else '{fixed.REASON_NO_EVIDENCE}' end reason from iv0)""",
]
ORACLES["item_verdicts"] = ctes(*VERDICTS, select="select * from iv")
ORACLES["item_verdict_counts"] = ctes(
    *VERDICTS,
    select="select request_id, count(*) filter (state = 'verified') verified, count(*) filter (state = 'pending') pending from (select request_id, state from iv union all select request_id, null from s) group by 1",
)

# --- rules --------------------------------------------------------------------------------------------

_hc = "coalesce(nullif(hcode, ''), nullif(health_unit_hcode, ''))"


def _has(c: str) -> str:
    return f"length({trim(nn(c))}) > 0"


def _if(cond: str, a: str, b: str) -> str:
    return f"case when {cond} then {a} else {b} end"


def _rule(n: int, rule: str, status: str, title: str, detail: str, category: str, where: str = "true") -> str:
    return (
        f"select request_id, source, {n} ord, '{rule}' rule_id, {status} status, {title} title, {detail} detail, {category} category"
        f" from sx where source = '{{source}}' and {where}"
    )


def _present(n: int, rule: str, c: str, title: str, found: str, absent: str, missing: str = "fail") -> str:
    return _rule(n, rule, presence(c, missing), q(title), _if(_has(c), found, q(absent)), "'basic'")


def _email(n: int, rule: str, title: str) -> str:
    st = email_status("email")
    detail = f"case ({st}) when 'warn' then 'ไม่พบอีเมล' when 'pass' then email || ' ' else email || ': รูปแบบไม่ถูกต้อง' end"
    return _rule(n, rule, st, q(title), detail, "case when coalesce(email, '') = '' then 'basic' else 'format' end")


def _idrule(n: int, rule: str, c: str, title: str) -> str:
    return _rule(
        n,
        rule,
        f"case when {nn(c)} = '' then 'warn' when {valid_id(c)} then 'pass' else 'fail' end",
        q(title),
        _if(f"{nn(c)} = ''", "'ไม่พบเลขบัตร'", f"{c} || ': ' || {id_reason(c)}"),
        "'identity'",
    )


_strong = "(strong_code_n + strong_owner_n)"


def _more(n: str, k: int) -> str:
    return f"case when {n} > {k} then chr(10) || '… อีก ' || ({n} - {k})::varchar || ' รายการ' else '' end"


def _dup(n: int) -> str:
    title = f"case when {_strong} > 0 then 'สถานพยาบาลซ้ำ (' || {_strong}::varchar || ')' when weak_n > 0 then 'ชื่อคล้ายกัน (' || weak_n::varchar || ')' else 'ตรวจสอบสถานพยาบาลซ้ำ' end"
    detail = (
        f"case when {_strong} > 0 then ' พบรายการซ้ำชัดเจน' || chr(10) || tops || {_more(_strong, 8)}"
        f" when weak_n > 0 then ' ชื่อตรงกันแต่คนละเจ้าของ/รหัส: ควรตรวจด้วยตนเอง' || chr(10) || tops || {_more('weak_n', 8)}"
        " when generic then 'ชื่อหน่วยบริการเป็นชื่อทั่วไป (เช่น \"เอกชน\"): ตรวจซ้ำด้วยชื่อไม่ได้'"
        " else ' ไม่พบซ้ำ (เทียบกับ ' || format('{:,}', checked) || ' รายการ)' end"
    )
    status = f"case when {_strong} > 0 then 'fail' when weak_n > 0 or generic then 'warn' else 'pass' end"
    return _rule(n, "duplicate-unit", status, title, detail.replace("{:,}", "{{:,}}"), "'basic'")


_doc_names = "[' สพ.7', ' สพ.19', ' บัตร', ' /files/' || request_id || '/3.pdf']"


def _docs(n: int) -> str:
    have = "least(n_docs, 4)"
    return _rule(
        n,
        "doc-links",
        "case when n_docs > 0 then 'pass' else 'warn' end",
        f"'เอกสารที่พบ (' || {have}::varchar || ' ไฟล์)'",
        f"case when n_docs > 0 then array_to_string({_doc_names}[1:{have}], chr(10)) else 'ไม่พบลิงก์เอกสาร: อาจต้องคลิก \"ตรวจเอกสาร\"' end",
        "'document'",
    )


def _agree(n: int, rule: str, c: str, title: str, yes: str, no: str, category: str) -> str:
    ok = f"coalesce({c}, false)"
    return _rule(n, rule, _if(ok, "'pass'", "'fail'"), q(title), _if(ok, q(yes), q(no)), q(category))


_agreed = "[agree_service, agree_processing, agree_sharing, agree_terms]"
_agree_titles = "['Service Agreement', 'Data Processing Addendum', 'Data Sharing Addendum', 'ยอมรับเงื่อนไขการให้บริการ']"
_known = f"len(list_filter({_agreed}, lambda x: x is not null))"
_yes = f"len(list_filter({_agreed}, lambda x: x))"
_known_names = f"array_to_string(list_transform(list_filter({_agree_titles}, lambda x, i: {_agreed}[i] is not null), lambda x: ' ' || x), chr(10))"
_groups = f"least(n_groups, {len(standins.GROUP_TITLES)})"
_ndocs = "least(n_docs, 4)"
_item_counts = [len(i) for i in standins.GROUP_ITEMS]
_autos = [sum(("ตรงกับ LOI" in x or "ไม่หมดอายุ" in x) for x in i) for i in standins.GROUP_ITEMS]


def _upto(values: list[int]) -> str:
    return f"list_sum({values}[1:{_groups}])::bigint::varchar"


def _group_text(i: int) -> str:
    lines = [standins.GROUP_TITLES[i]] + [
        f"   {x} " + ("(ตรวจอัตโนมัติได้ถ้า OCR อ่านออก)" if "ตรงกับ LOI" in x or "ไม่หมดอายุ" in x else "(ต้องตรวจเอง)")
        for x in standins.GROUP_ITEMS[i]
    ]
    return " || chr(10) || ".join(q(x) for x in lines)


_group_list = "[" + ", ".join(_group_text(i) for i in range(3)) + f"][1:{_groups}]"
_pct = "round(score * 100)::int::varchar"
_hv = trim(_hc)
CHECKLIST_RULES = [
    _present(0, "hcode-present", _hc, "มีรหัสหน่วยบริการ (HCode)", f"'รหัส: ' || {_hc}", "ไม่พบรหัสหน่วยบริการ"),
    _rule(1, "hcode-format", code_status(_hc), "'รูปแบบ HCode'",
          f"case when {rm(_hv, '^[A-Za-z]+$')} then {_hv} || ' ไม่มีตัวเลข น่าจะเป็นข้อมูลทดสอบ' when {rm(_hv, '^(?i:TEST)')} then {_hv} || ' ขึ้นต้นด้วย TEST น่าจะเป็นข้อมูลทดสอบ'"
          f" when {rm(_hv, '^[A-Za-z0-9]{9}$')} then {_hv} || ' รูปแบบมาตรฐาน 9 หลัก' else {_hv} || ' ยาว ' || length({_hv})::varchar || ' หลัก ไม่ใช่ 9 หลักมาตรฐาน' end",
          "'format'", f"{nn(_hc)} <> ''").replace("{9}", "{{9}}"),
    _present(2, "unit-name", "health_unit_name", "ชื่อหน่วยบริการ", "'ชื่อ: ' || health_unit_name", "ไม่พบชื่อหน่วยบริการ"),
    _present(3, "unit-type", "health_unit_type", "ประเภทหน่วยบริการ", "'ประเภท: ' || health_unit_type", "ไม่พบประเภทหน่วยบริการ"),
    _present(4, "address", "address", "ที่อยู่", "'ที่อยู่: ' || address", "ไม่พบที่อยู่", "warn"),
    _present(5, "province", "province", "จังหวัด", "'จังหวัด: ' || province", "ไม่พบจังหวัด", "warn"),
    _present(6, "postal-code", "postal_code", "รหัสไปรษณีย์", f"'รหัสไปรษณีย์: ' || postal_code || {_if(POSTAL_OK, chr(39) * 2, q(': รูปแบบไม่ถูกต้อง'))}".replace("{5}", "{{5}}"), "ไม่พบรหัสไปรษณีย์", "warn"),
    _present(7, "phone", "phone", "เบอร์โทรศัพท์", f"'เบอร์: ' || phone || {_if(PHONE_OK, q(' '), q(': รูปแบบไม่ปกติ'))}".replace("{8,9}", "{{8,9}}"), "ไม่พบเบอร์โทรศัพท์", "warn"),
    _email(8, "email", "อีเมลหน่วยงาน"),
    _present(9, "authority-name", "authority_name", "ชื่อผู้มีอำนาจ", "'ชื่อ: ' || authority_name", "ไม่พบชื่อผู้มีอำนาจ"),
    _idrule(10, "authority-id", "authority_id", "เลขบัตร ปชช. ผู้มีอำนาจ"),
    _present(11, "authority-id-doc", "authority_doc", "เอกสารสำเนาบัตรผู้มีอำนาจ", "'พบลิงก์เอกสาร '", "ไม่พบลิงก์เอกสารสำเนาบัตร"),
    _present(12, "admin-name", "admin_name", "ชื่อ Hospital Admin (HA)", "'ชื่อ: ' || admin_name", "ไม่พบชื่อ HA", "warn"),
    _idrule(13, "admin-id", "admin_id", "เลขบัตร ปชช. HA"),
    _rule(14, "cross-names", "'info'", "case when authority_name <> '' and admin_name <> '' then 'ผู้มีอำนาจ vs HA' else 'เปรียบเทียบชื่อ' end",
          f"case when not (authority_name <> '' and admin_name <> '') then 'มีข้อมูลชื่อไม่ครบ ไม่สามารถเปรียบเทียบ' when match then 'เป็นคนเดียวกัน (' || {_pct} || '%): ' || authority_name"
          " else 'คนละคน:' || chr(10) || 'ผู้มีอำนาจ: ' || authority_name || chr(10) || 'HA: ' || admin_name end", "'cross'", "(authority_name <> '' or admin_name <> '')"),
    _dup(15),
    _docs(16),
    _rule(17, "agreements", f"case when {_known} = 0 then 'info' when {_yes} < {_known} then 'fail' else 'pass' end",
          f"'การยอมรับข้อตกลง' || case when {_known} > 0 then ' (' || {_yes}::varchar || '/' || {_known}::varchar || ')' else '' end",
          f"case when {_known} = 0 then 'ไม่พบช่องยอมรับข้อตกลงในหน้านี้' else {_known_names} end", "'agreement'"),
    _rule(18, "doc-coverage", f"case when {_groups} > {_ndocs} then 'fail' else 'pass' end",
          f"'เอกสารครบตามรายการ (' || least({_groups}, {_ndocs})::varchar || '/' || {_groups}::varchar || ')'",
          f"case when {_groups} > {_ndocs} then ' ต้องมีเอกสาร ' || {_groups}::varchar || ' ฉบับ แต่พบ ' || {_ndocs}::varchar || ' ฉบับ' else ' พบเอกสารครบ ' || {_ndocs}::varchar || ' ฉบับตามรายการตรวจ' end",
          "'document'", "n_groups > 0"),
    _rule(19, "owner-footprint", "case when owner_n = 0 then 'pass' when owner_n >= 5 then 'warn' else 'info' end",
          "case when owner_n = 0 then 'เจ้าของยื่นคำร้องอื่น' else 'เจ้าของมีคำร้องอื่น (' || owner_n::varchar || ')' end",
          f"case when owner_n = 0 then ' ไม่พบคำร้องอื่นของเจ้าของรายนี้' else units || {_more('owner_n', 6)} end", "'cross'"),
    _rule(20, "adaptive-checklist", "'info'", f"'รายการตรวจของคำร้องนี้ (' || {_groups}::varchar || ' เอกสาร / ' || {_upto(_item_counts)} || ' ข้อ)'",
          f"array_to_string({_group_list}, chr(10)) || chr(10) || chr(10) || 'ตรวจอัตโนมัติได้สูงสุด ' || {_upto(_autos)} || '/' || {_upto(_item_counts)} || ' ข้อ'", "'checklist'", "n_groups > 0"),
    _rule(21, "checklist-panel", "case when least(n_ticked, n_panel) = n_panel then 'pass' else 'warn' end",
          "'ความคืบหน้า Checklist (' || least(n_ticked, n_panel)::varchar || '/' || n_panel::varchar || ')'",
          "case when least(n_ticked, n_panel) = n_panel then 'ติ๊กครบทุกข้อแล้ว' else 'ยังไม่ได้ติ๊ก ' || (n_panel - n_ticked)::varchar || ' ข้อ (ดูรายละเอียดในการ์ด \"รายการตรวจของคำร้องนี้\")' end",
          "'checklist'", "n_panel > 0"),
]
MODAL_RULES = [
    _present(0, "hcode-present", "hcode", "มีรหัสหน่วยบริการ", "'รหัส: ' || hcode", "ไม่พบ HCode"),
    _present(1, "unit-name", "health_unit_name", "ชื่อหน่วยบริการ", "health_unit_name", "ไม่พบชื่อ"),
    _dup(2),
    _present(3, "admin-name", "admin_name", "ชื่อ Admin", "admin_name", "ไม่พบ", "warn"),
    _email(4, "admin-email", "อีเมล Admin"),
    _present(5, "authority-name", "authority_name", "ชื่อผู้มีอำนาจ", "authority_name", "ไม่พบ", "warn"),
    _agree(6, "thai-id-verify", "verified", "ยืนยัน ThaiID", "ยืนยันแล้ว", "ยังไม่ยืนยัน", "identity"),
    _agree(7, "svc-agree", "agree_service", "Service Agreement", "", "ยังไม่ยอมรับ", "agreement"),
    _agree(8, "dp-agree", "agree_processing", "Data Processing Addendum", "", "ยังไม่ยอมรับ", "agreement"),
    _agree(9, "ds-agree", "agree_sharing", "Data Sharing Addendum", "", "ยังไม่ยอมรับ", "agreement"),
    _docs(10),
]


def _fill(rule: str, source: str) -> str:
    return rule.replace("{source}", source).replace("{{", "{").replace("}}", "}")


def _or_no_code(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '{rule_texts.NO_CODE}')"


_SIM_SRC = "nsrc as (select request_id, authority_name a, admin_name b from s)"
CHECKED = [
    *PAIRS,
    f"""tt as (select request_id, string_agg(' [' || why || '] ' || name || ' (' || {_or_no_code('code')} || '): id ' || id || ', ' || status, chr(10) order by rank) tops from tk group by 1)""",
    f"""oo as (select request_id, string_agg(' ' || name || ' (' || {_or_no_code('code')} || '): ' || status, chr(10) order by rank) units from ow group by 1)""",
    _SIM_SRC,
    *similarity_ctes("nsrc", "request_id", "nsim"),
    """sx as (select s.*, dc.* exclude (request_id), tt.tops, oo.units, nsim.match, nsim.score from s join dc on dc.request_id = s.request_id
      join nsim on nsim.request_id = s.request_id left join tt on tt.request_id = s.request_id left join oo on oo.request_id = s.request_id)""",
    "ra as (" + "\nunion all ".join([_fill(r, "checklist") for r in CHECKLIST_RULES] + [_fill(r, "modal") for r in MODAL_RULES]) + ")",
    "rl as (select request_id, source, row_number() over (partition by request_id order by ord) - 1 ordinal, rule_id, status, title, detail, category from ra)",
]
for _source in ("checklist", "modal"):
    ORACLES[f"rule_results_{_source}"] = ctes(
        *CHECKED, select=f"select * exclude (source) from rl where source = '{_source}'"
    )
ORACLES["rule_score"] = ctes(
    *CHECKED,
    select=f"""select request_id, count(*) filter (status = 'pass') passed, count(*) total,
  case when bool_or(status = 'fail') then '{fixed.BADGE_FAIL}' else '{fixed.BADGE_PASS}' end badge from rl group by 1""",
)


def _merge(first: list[str], second: list[str]) -> list[str]:
    """Both lists of tables, each name once."""
    seen = {p.split(" as ", 1)[0] for p in first}
    return [*first, *[p for p in second if p.split(" as ", 1)[0] not in seen]]


def _summary(compared: bool) -> str:
    rows = "select request_id, status st, 0 ev from rl"
    if compared:
        rows += " union all select request_id, case when match then 'pass' else 'fail' end, 1 from cmp"
    return f"""sm as (select *, case when fail > 0 then 'fail' when doc_evidence = 0 or warn > 0 then 'warn' else 'pass' end verdict,
      case when fail > 0 then replace('{fixed.MESSAGE_FAIL}', '%d', fail::varchar) when doc_evidence = 0 then '{fixed.MESSAGE_NO_EVIDENCE}'
        when warn > 0 then replace('{fixed.MESSAGE_WARN}', '%d', warn::varchar) else '{fixed.MESSAGE_PASS}' end message
      from (select request_id, count(*) filter (st = 'pass') pass, count(*) filter (st = 'fail') fail, count(*) filter (st = 'warn') warn,
        count(*) filter (st in ('pass', 'fail', 'warn')) total, sum(ev)::bigint doc_evidence from ({rows}) group by 1))"""


BOTH = _merge(CHECKED, COMPARE)
ORACLES["request_summary"] = ctes(*BOTH, _summary(True), select="select * from sm")

# --- deep check and reports --------------------------------------------------------------------------------

DEEP = [
    *_merge(_merge(CHECKED, CLUSTERS), [IDS, D]),
    _summary(False),
    "ur as (select request_id, count(*) filter (status = 'error') unreadable from d group by 1)",
    f"""fg as (select request_id, string_agg(f, '|' order by o, ordinal) flags from (
      select request_id, case status when 'fail' then 0 else 1 end o, ordinal, ' ' || title f from rl where status in ('fail', 'warn')
      union all select request_id, 2, 0, '{fixed.FLAG_IN_SWEEP}' from s where coalesce(nullif(hu_id, ''), request_id) in (select id from ids where severity = 'strong')
      union all select request_id, 3, 0, replace('{fixed.FLAG_UNREADABLE}', '%d', unreadable::varchar) from ur where unreadable > 0) group by 1)""",
    f"""dr as (select s.request_id, s.k, coalesce(nullif(hcode, ''), 'Unknown') hcode, coalesce(nullif(health_unit_name, ''), '-') as name, verdict status,
      doc_evidence, coalesce(flags, '') flags, case when verdict = 'fail' then '{fixed.DEEP_BADGE_FAIL}' when flags is not null then '{fixed.DEEP_BADGE_REVIEW}'
      else '{fixed.DEEP_BADGE_CLEAN}' end badge from s join sm on sm.request_id = s.request_id left join fg on fg.request_id = s.request_id)""",
]
ORACLES["deep_results"] = ctes(*DEEP, select="select * exclude (k) from dr")
ORACLES["deep_report"] = ctes(
    *DEEP,
    select="""select count(*) checked, count(*) filter (flags <> '' or status = 'fail') review,
  count(*) filter (not (flags <> '' or status = 'fail')) clean from dr""",
)
_signal = (
    f"case when {_strong} > 0 then replace('{fixed.DUPLICATES_STRONG}', '%d', {_strong}::varchar)"
    f" when weak_n > 0 then replace('{fixed.DUPLICATES_WEAK}', '%d', weak_n::varchar) else '{fixed.DUPLICATES_NONE}' end"
)
ORACLES["outcome_export"] = ctes(
    *BOTH,
    select=f"""select request_id, 'rule' part, 0::bigint doc_ordinal, ordinal, json_object('check', title, 'result', status)::varchar payload from rl
union all select request_id, 'comparison', doc_ordinal, row, json_object('field', field, 'result', case when match then 'MATCH' else 'MISMATCH' end)::varchar from cmp
union all select request_id, 'duplicates', 0, 0, json_object('signal', {_signal})::varchar from sx
union all select request_id, 'documents', 0, 0, json_object('read', count(*) filter (status = 'success'), 'total', count(*))::varchar from d group by request_id""",
)
ORACLES["report_sink"] = ctes(
    *_merge(DEEP, audit_ctes(CLUSTERS, 15)),
    select="""select 'flagged' report, id as key, flags line from au where flagged
union all select 'clusters', cluster_id, concat_ws('|', kind, severity, label, n::varchar) from cl
union all select 'members', cluster_id || '|' || id, concat_ws('|', code, name, status) from ed
union all select 'headline', 'all', concat_ws('|', count(*)::varchar, (count(*) filter (failed))::varchar, (count(*) filter (flagged and not failed))::varchar,
  (count(*) filter (not flagged))::varchar, (select count(*) from cl where severity = 'strong')::varchar, (select count(*) from cl where severity = 'weak')::varchar) from au
union all select 'deep', request_id, concat_ws('|', hcode, name, status, flags) from dr""",
)

# --- links, pages, JSON ---------------------------------------------------------------------------------------

_EXT = "|".join(fixed.FILE_EXTENSIONS)
_ANCHOR = r"(?is)<(?:a|button)\b[^>]*>.*?</(?:a|button)>"
_VIEWER = r"(?is)<(?:iframe|embed|object)\b[^>]*>"
_ONCLICK = [
    rf"(?i)['\"]([^'\"]+\.(?:{_EXT}))['\"]",
    r"(?i)window\.open\(['\"]([^'\"]+)['\"]",
    r"(?i)downloadFile\(['\"]([^'\"]+)['\"]",
    r"(?i)['\"]([^'\"]+/[^'\"]+)['\"]",
]


def unescape(c: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = f"replace({c}, {q(entity)}, {q(char)})"
    return c


def attr(tag: str, name: str) -> str:
    p = rf"(?is)^<[^>]*?\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return f"case when {rm(tag, p)} then {unescape(f'({rx(tag, p, 1)} || {rx(tag, p, 2)})')} end"


def is_file(c: str) -> str:
    return rm(c, rf"(?i)[.]({_EXT})([?]|$)")


def dir_of(url: str) -> str:
    path = f"regexp_replace({url}, '[?#].*$', '')"
    return (
        f"case when {rm(path, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/')} then regexp_replace({path}, '[^/]*$', '') else {path} || '/' end"
    )


def resolve(href: str, page: str) -> str:
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
    origin = rx(page, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0)
    full = (
        f"case when {rm(href, scheme)} then {href} when starts_with({href}, '//') then {rx(page, scheme, 0)} || {href}"
        f" when starts_with({href}, '/') then {origin} || {href}"
        f" when starts_with({href}, '?') then regexp_replace({page}, '[?#].*$', '') || {href}"
        f" when starts_with({href}, '#') then regexp_replace({page}, '#.*$', '') || {href}"
        f" else {dir_of(page)} || {href} end"
    )
    # Dot segments by repeated replacement, enough for the depth of the stand-in's links.
    flat = "regexp_replace(u, '/([.]/)+', '/', 'g')"
    for _ in range(4):
        flat = f"regexp_replace({flat}, '/[^/.][^/]*/[.][.](/|$)', '/')"
    flat = f"regexp_replace({flat}, '^([a-z]+://[^/]+)(/[.][.])+/', '\\1/')"
    enc = (
        "array_to_string(list_transform(string_split(u, ''), lambda c: case when c = ' ' then '%20'"
        f" when {rm('c', r'[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} then url_encode(c) else c end), '')"
    )
    return f"(select {enc} from (select {flat} u from (select {full} u)))"


_SITE = rx("page", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0) + " || '/'"


def _elements(pattern: str) -> str:
    return (
        f"select page_id, page, generate_subscripts(l, 1) - 1 pos, unnest(l) tag from"
        f" (select page_id, url page, {rall('html', pattern, 0)} l from pg)"
    )


_script = "coalesce(" + ", ".join(f"nullif({rx('oc', p)}, '')" for p in _ONCLICK) + ")"
CLICK = [
    f"pg as ({std(standins.PAGES_SQL)})",
    f"e0 as ({_elements(_ANCHOR)})",
    f"""e1 as (select *, {trim(unescape(rr('tag', '(?s)<[^>]*>')))} as text, {attr('tag', 'data-src')} ds, {attr('tag', 'href')} ah,
      {attr('tag', 'onclick')} oc, {rm('tag', r'(?i)^<a' + chr(92) + 'b')} is_link from e0)""",
    f"""e2 as (select *, case when coalesce(ah, '') = '' or starts_with(ah, 'javascript:') or ah = '#' then {_script}
      else {resolve('ah', 'page')} end href from e1)""",
]
# The links of the hard pages, as read by hand: part, pos, address, text, whether a link.
_HARD_LINKS = """hard as (
  select -page_id - 1 page_id, v.* from pages, (values
    (0, 0, '/files/a', '.pdf', 'a', true), (0, 1, '/files/n', '.pdf?a=1&copy=2', 'b' || chr(160) || '…', true),
    (0, 2, '/files/u', '.pdf', 'un', true), (0, 3, '/files/q', '.pdf', 'both', true),
    (0, 4, '/upload/z', null, 'both', false), (0, 5, '/files/dup', '.pdf', 'first', true),
    (0, 6, '/admin/checklist/', '', 'ตรวจเอกสาร', true), (0, 7, '/files/again.pdf', null, 'one', true),
    (0, 8, '/files/again.pdf', null, 'two', true), (1, 0, '/files/again.pdf', null, '', false),
    (1, 1, '/files/v.pdf', null, '', false)) v(part, pos, front, back, text, is_link)),
  hl as (select hard.page_id, part, pos, text, is_link, SITE || front ||
    case when back is null then '' else (-hard.page_id - 1)::varchar || back end u
    from hard join (select -page_id - 1 page_id, url page from pages) p on p.page_id = hard.page_id)""".replace(
    "SITE", rx("page", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0)
)
ORACLES["page_links"] = ctes(
    *CLICK,
    _HARD_LINKS,
    f"v0 as ({_elements(_VIEWER)})",
    f"v1 as (select *, coalesce(nullif({attr('tag', 'src')}, ''), {attr('tag', 'data')}) src from v0)",
    f"""l0 as (select page_id, 0 part, pos, page, case when coalesce({is_file('ds')}, false) then ds
        when {is_file('href')} or (text <> '' and ({has_any('text', fixed.LINK_TEXT_WORDS)} or {has_any('href', fixed.LINK_HREF_WORDS)})) then href end h, text from e2
      union all select page_id, 1, pos, page, case when {is_file('src')} then src end, '' from v1)""",
    f"l1 as (select *, {resolve('h', _SITE)} u from l0 where coalesce(h, '') <> '')",
    """l2 as (select * from l1 where coalesce(u, '') <> '' and not starts_with(u, 'javascript:') and not ends_with(u, '#')
      qualify row_number() over (partition by page_id, u order by part, pos) = 1)""",
    select=f"""select page_id, part::bigint part, pos, u url, case when text = '' then {rx('u', '[^/]*$', 0)} else text end as text,
  {doc_type("text || ' ' || u")} as type from l2
union all select page_id, part::bigint, pos, u, case when text = '' then {rx('u', '[^/]*$', 0)} else text end, {doc_type("text || ' ' || u")} from hl
  where not (u like '%/again.pdf' and text <> 'one')""",
)
ORACLES["modal_links"] = ctes(
    *CLICK,
    _HARD_LINKS,
    f"""m0 as (select page_id, pos, text, coalesce(href, ah) u, case when ah <> '#' then {resolve('ah', 'page')} end own from e2 where is_link)""",
    select=f"""select page_id, 0::bigint part, pos, u url, text, null::varchar as type from m0 where coalesce(u, '') <> '' and {has_any('u', fixed.MODAL_HREF_WORDS)}
union all select page_id, 1, pos, own, '{fixed.REVIEW_LINK_TEXT}', 'review_page' from m0 where contains(text, '{fixed.REVIEW_LINK_TEXT}') and coalesce(own, '') <> ''
union all select page_id, 0, pos, u, text, null from hl where is_link and {has_any('u', fixed.MODAL_HREF_WORDS)}
union all select page_id, 1, pos, u, '{fixed.REVIEW_LINK_TEXT}', 'review_page' from hl where text = 'ตรวจเอกสาร'""",
)


def canonical(c: str) -> str:
    h = standins.HOST
    return (
        f"case when starts_with({c}, 'http://') then 'https://' || substr({c}, 8) when starts_with({c}, '/') then '{h}' || {c}"
        f" when not starts_with({c}, 'http') then '{h}/' || {c} else {c} end"
    )


_api = f"(?i){'|'.join(fixed.API_URL_PATTERNS)}"
ORACLES["url_canonical"] = ctes(
    "u as (select page_id, url, regexp_replace(url, '^[a-z]+://[^/]*', '') p from pages)",
    select=f"""select page_id, {canonical('url')} as absolute, {canonical('p')} from_path, {canonical("regexp_replace(p, '^/', '')")} from_name,
  {rm("'/api' || p", _api)} is_api from u""",
)
_pt = f"pt as ({std(standins.PAGE_TEXT_SQL)})"


def _found(c: str, p: str) -> str:
    return f"nullif({trim(rx(c, p))}, '')"


def _after(label: str, value: str) -> str:
    """A value behind a label that colons and blanks may follow."""
    return f"{label}[:{BLANK}]*({value})"


_to_line_end = f"{DOT}+"
_unit_code = _after(f"รหัสหน่วย{WS}*งานบริการ{WS}*สุขภาพ", "[A-Za-z0-9_]+")
_mail = _after("อีเมล", f"[^{BLANK}]+@[^{BLANK}]+")


def _to_mail(label: str) -> str:
    return rf"(?s){label}[:{BLANK}]*(.+?)(?:\n|อีเมล)"


ORACLES["page_header_fields"] = ctes(
    _pt,
    select=f"""select k, coalesce({_found('text', _after('รหัสหน่วยบริการ', '[A-Za-z0-9_]+'))}, {_found('text', _unit_code)}) hcode,
  {_found('text', _unit_code)} health_unit_hcode, {_found('text', _after('ประเภทการสมัคร', _to_line_end))} request_type,
  coalesce({_found('text', _after(f'ชื่อหน่วยงาน/ชื่อสถาน{WS}*พยาบาล', _to_line_end))},
    {_found('heading', f'(?i)check{WS}*list{WS}*:{WS}*({_to_line_end})')}) health_unit_name, {_found('url', '/checklist/([0-9]+)')} hu_id from pt""",
)
ORACLES["modal_fields"] = ctes(
    _pt,
    rf"ps as (select *, {rx('text', r'(?s)ข้อมูลผู้มีอำนาจ(.*?)(?:รายการตรวจสอบ|สถานะ|\z)')} sec from pt)",
    select=f"""select k, {_found('text', _to_mail(f'ชื่อ{WS}*Admin'))} admin_name, {_found('text', _mail)} admin_email,
  {_found('sec', _to_mail('ชื่อ'))} authority_name, {_found('sec', _mail)} authority_email, contains(sec, 'ยืนยันตัวตนแล้ว') verified from ps""",
)
_num = rf"รายการตรวจสอบ{WS}*([0-9]+){WS}*:{WS}*({DOT}+)"
ORACLES["checklist_headings"] = ctes(
    _pt,
    f"h as (select k, unnest({rall('text', _num, 1)})::bigint number, unnest({rall('text', _num, 2)}) rest from pt)",
    select=f"""select k, 'checklist' page, number, {trim('rest')} as name from h
union all select k, 'modal', number, {trim(rx('rest', '^(.+?)(?:รายการ|สถานะ|$)'))} from h""",
)
_TITLE = rf"^รายการตรวจสอบ{WS}*[0-9]+{WS}*/{WS}*[0-9]+{WS}*:{WS}*"
_BOX = r'(?is)<label\b[^>]*>\s*<input\b[^>]*name="check_detail\[[0-9]+\]\[[0-9]+\]"[^>]*>.*?</label>'
_NAME = r"check_detail\[([0-9]+)\]\[([0-9]+)\]"
ORACLES["checklist_groups"] = ctes(
    S,
    _pt,
    f"""hh as (select k, unnest(l) h, generate_subscripts(l, 1) p from (select k, {rall('html', '<h3>(.*?)</h3>')} l from pt))""",
    f"""ht as (select k, {rr(squeeze(trim('h')), _TITLE)} document, row_number() over (partition by k order by p) - 1 pos from hh where {rm(squeeze(trim('h')), _TITLE)})""",
    f"bx as (select k, unnest(l) b, generate_subscripts(l, 1) p from (select k, {rall('html', _BOX, 0)} l from pt))",
    f"""b2 as (select k, p, {rx('b', _NAME, 1)} group_id, {rx('b', _NAME, 2)} item_id, {squeeze(trim(rr('b', '(?s)<[^>]*>')))} as label,
      {rm(rx('b', r'(?is)<input' + chr(92) + 'b[^>]*>', 0), r'(?i)' + chr(92) + 's' + 'checked' + chr(92) + 'b')} checked from bx)""",
    "gp as (select k, group_id, row_number() over (partition by k order by min(p)) - 1 pos from b2 group by 1, 2)",
    select="""select b2.k, gp.pos, b2.group_id, ht.document, row_number() over (partition by b2.k, b2.group_id order by p) - 1 item, item_id, label, checked,
  length(label) > 5 and not contains(label, 'เลือก') panel
  from b2 join gp on gp.k = b2.k and gp.group_id = b2.group_id left join ht on ht.k = b2.k and ht.pos = gp.pos
  union all select -s.k - 1, v.pos, group_id, document, item, item_id, case when label = 'cell' then 'cell ' || s.k::varchar else label end l, checked,
    length(l) > 5 from s, (values
    (0, '7', 'ก & ข', 0, '1', '', false), (0, '7', 'ก & ข', 1, '2', 'near text', false), (0, '7', 'ก & ข', 2, '3', 'one', false),
    (0, '7', 'ก & ข', 3, '4', 'two', true), (1, '3', null, 0, '1', 'cell', true), (1, '3', null, 1, '2', 'outer deep', true),
    (1, '3', null, 2, '3', 'bold', false)) v(pos, group_id, document, item, item_id, label, checked)""",
)
_labels = "[" + ", ".join(q(x) for x in standins.DOC_LABELS) + "]"
_url_rows = f"""ua as (select request_id, 0 rank, i pos, '/files/' || request_id || '/' || i::varchar || '.pdf' url, {_labels}[i + 1] as text, null::varchar as type
  from s, (select unnest(range(4)) i) where i < n_docs)"""
_more_urls = f"""ub as (select request_id, 1 rank, p pos, '/files/' || request_id || '/' || i::varchar || '.pdf' url, {_labels}[i + 1] as text, null::varchar as type
    from s, (select unnest([0, 2]) i, unnest([0, 1]) p) where k % 2 = 0
  union all select request_id, 2, 0, '/files/' || request_id || '/1.pdf', 'file', null from s where k % 3 = 0
  union all select request_id, 2, 1, '/storage/' || request_id, 'scan', null from s where k % 3 = 0
  union all select request_id, 3, 0, authority_doc, '{fixed.CARD_TEXT_AUTHORITY}', 'id_card' from s where coalesce(authority_doc, '') <> ''
  union all select request_id, 4, 0, admin_doc, '{fixed.CARD_TEXT_ADMIN}', 'id_card' from s where coalesce(admin_doc, '') <> '')"""
_new = """select * from {t} where not exists (select 1 from ua where ua.request_id = {t}.request_id and ua.url = {t}.url)
  qualify row_number() over (partition by request_id, url order by rank, pos) = 1"""
ORACLES["doc_url_union"] = ctes(
    S,
    _url_rows,
    _more_urls,
    f"un as (select * from ua union all select * from ({_new.format(t='ub')}))",
    select="select request_id, rank::bigint as rank, pos::bigint pos, url, text, type from un",
)
ORACLES["doc_url_merge"] = ctes(
    S,
    D,
    _url_rows,
    "ub as (select request_id, 1 rank, k pos, url, label as text, null::varchar as type from d)",
    f"un as (select * from ua union all select * from ({_new.format(t='ub')}))",
    select="select request_id, rank::bigint as rank, pos::bigint pos, url, text from un",
)
_ev = f"ev as ({std(standins.EVENTS_SQL)})"
_file = "regexp_matches(v, '(?i)[.](pdf|jpg|jpeg|png)$') or contains(v, '/storage/') or contains(v, '/files/') or contains(v, 'upload')"
LINKS = ctes(
    _ev,
    f"ek as (select event_id, body from ev where {rm('url', _api)} and contains(content_type, 'application/json'))",
    "jt as (select event_id, t.key, t.id, t.type, t.value ->> '$' v from ek, lateral (select * from json_tree(ek.body)) t)",
    f"jf as (select * from jt where type = 'VARCHAR' and length(v) > 5 and ({_file}))",
    select="select event_id, row_number() over (partition by event_id order by id) - 1 pos, key, v as value from jf",
)
ORACLES["json_file_links"] = LINKS
ORACLES["stream_links"] = LINKS


def js(key: str) -> str:
    return f"nullif(j ->> '$.{key}', '')"


_rep = [
    f"rp as ({std(standins.REPLIES_SQL)})",
    r"r1 as (select *, regexp_extract(text, '(?s)\{.*\}', 0) sp from rp)",
    "r2 as (select *, case when json_valid(sp) and sp <> '' then sp::json end j from r1)",
    f"""mo as (select request_id, url, case when sp = '' then 'โมเดลไม่ได้ตอบเป็น JSON' when j is null then 'JSON parse error' end error,
      {js('documentType')} doc_type, {js('facilityName')} facility_name, coalesce({js('ownerName')}, {js('operatorName')}) owner_name,
      {js('operatorName')} operator_name, {js('personName')} name_th, {js('personName')} as name, nullif({digits(js('idNumber'))}, '') id_number,
      case when nullif({digits(js('idNumber'))}, '') is not null then {valid_id(js('idNumber'))} end id_number_valid, {js('licenseNumber')} license_number,
      {js('expiryDate')} expiry_date, {js('expiryDate')} expiry_date_parsed, {js('address')} address,
      case when j is not null then coalesce(json_type(j, '$.isHandwritten') = 'BOOLEAN' and (j ->> '$.isHandwritten') = 'true', false) end is_handwritten,
      case when json_type(j, '$.confidence') in ('UBIGINT', 'BIGINT', 'DOUBLE') then (j ->> '$.confidence')::double end confidence from r2)""",
]
ORACLES["model_response_parse"] = ctes(*_rep, select="select * exclude (url) from mo")
_mcols = ["facility_name", "owner_name", "operator_name", "id_number", "id_number_valid", "license_number", "expiry_date_parsed", "address"]
# The merge query addresses each document by its own key.
_read_by_key = [
    p.replace(
        f"dt as (select *, {doc_type(_ALL)}",
        f"dt as (select *, {doc_type(_ALL.replace('url', chr(39) + '/files/' + chr(39) + ' || k::varchar'))}",
    )
    for p in READ
]
ORACLES["field_merge"] = ctes(
    *_read_by_key,
    *_rep,
    select=f"""select rf.k, coalesce(mo.doc_type, rf.doc_type) doc_type, {", ".join(f"coalesce(mo.{c}, rf.{c}) {c}" for c in _mcols)},
  coalesce(mo.is_handwritten, false) is_handwritten, mo.confidence model_confidence
  from rf left join (select * from mo where error is null) mo on mo.request_id = rf.k::varchar""",
)
ORACLES["payload_decode"] = """
select doc_id, case when trim(text) <> '' then strlen(text) end n_chars, case when trim(text) <> '' then md5(text) end digest,
  case when trim(text) <> '' then 'raw-text' end as method, case when trim(text) <> '' then 'success' else 'error' end status from documents"""

ORACLES["landed_sources"] = ctes(
    S,
    D,
    f"rp as ({std(standins.REPLIES_SQL)})",
    f"ev as ({std(standins.EVENTS_SQL)})",
    select="""select 'submissions' as source, request_id as key, health_unit_name as value from s
union all select 'documents', url, status from d union all select 'replies', request_id, text from rp
union all select 'events', event_id::varchar, body from ev""",
)

# --- streaming: the batch equivalents ---------------------------------------------------------------------------

ORACLES["stream_verify"] = ctes(*CHECKED, select="select request_id, ordinal, rule_id, status from rl")
ORACLES["stream_dedup"] = "select distinct user_id::varchar hu_id from events"
