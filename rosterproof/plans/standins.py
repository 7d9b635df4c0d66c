"""Registry, submission, document and page tables derived from the star-schema tables.

The SQL below is plain enough to run unchanged on Spark and on DuckDB: table names stand
in braces. Every rule is relative to the row's own key, so group sizes do not grow with
the table, except for the placeholder names and owners, which are meant to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterproof.sources import schemas

AS_OF = "1999-01-01 00:00:00"
HOST = "https://registry.example"

# Registry: a quarter of the names are placeholders, a fifth of the owners are brands;
# the rest form small groups of neighbours.
REGISTRY_SQL = """
select cast(p_partkey as varchar(20)) as id,
  case when p_partkey % 97 = 0 then ''
    when p_partkey % 13 = 0 then concat('CA', lpad(cast(code_no as varchar(20)), 7, '0'))
    else lpad(cast(code_no as varchar(20)), 9, '0') end as code,
  case when p_partkey % 4 = 0 then p_name
    when p_partkey % 8 = 7 then concat('คลินิก-', cast(block as varchar(20)))
    else concat('คลินิก ', cast(block as varchar(20))) end as name,
  p_type as type,
  case p_partkey % 3 when 0 then 'รออนุมัติเอกสาร' when 1 then 'อนุมัติ' else 'ตีกลับ' end as status,
  case when p_partkey % 5 = 0 then p_brand
    when p_partkey % 11 = 0 then ''
    else concat('นายเจ้าของ ', cast(trio as varchar(20))) end as owner,
  p_size as sla,
  concat('2025-01-', lpad(cast(p_partkey % 28 + 1 as varchar(20)), 2, '0')) as create_date,
  p_partkey as input_order
from (
  select *, cast(floor(p_partkey / 8) as bigint) as block,
    cast(floor(p_partkey / 3) as bigint) as trio,
    case when floor(p_partkey / 8) % 5 = 0 then cast(floor(p_partkey / 8) as bigint) * 8 + 1
      when floor(p_partkey / 8) % 5 = 1 then cast(floor(p_partkey / 3) as bigint) * 3 + 1
      when p_partkey % 10 = 3 then p_partkey - 2
      else p_partkey end as code_no
  from {part}) t
"""

RAW_REGISTRY_SQL = f"""
select id as hu_id, concat('<b>', code, '</b>') as hu_code,
  concat('<a href="/x/', id, '">  ', name, '</a> ', chr(10)) as hu_name,
  concat(type, chr(9), ' ') as hu_type_name, concat('<span>', status, '</span>') as status,
  case when owner = '' then null else owner end as member_fname,
  case when input_order % 2 = 0 then null else ' ใจดี' end as member_lname,
  case when input_order % 7 = 0 then '' when input_order % 7 = 1 then concat('1.', cast(sla as varchar(20)), ' วัน')
    else concat(cast(sla as varchar(20)), ' วัน') end as sla,
  create_date, input_order
from ({REGISTRY_SQL}) g
"""

# Landed registry pages of 50 rows: a whole landing, one with pages that are short, missing
# or landed twice, one that an empty page ends.
PAGES_OF = 50
LANDED_SQL = f"""
select l.snapshot, copy, (pno * {PAGES_OF}) as start, total, r.*
from (select *, cast(floor(place / {PAGES_OF}) as bigint) as pno from (
  select g.*, row_number() over (order by g.input_order) - 1 as place, count(*) over () as total
  from ({RAW_REGISTRY_SQL}) g) q) r,
  (select 'whole' as snapshot, 0 as copy union all select 'torn', 0 union all select 'torn', 1 union all select 'cut', 0) l
where l.snapshot = 'whole'
  or l.snapshot = 'torn' and l.copy = 0 and pno % 5 <> 3 and (pno % 7 <> 2 or place % {PAGES_OF} < 40)
  or l.snapshot = 'torn' and l.copy = 1 and pno % 4 = 1 and place % {PAGES_OF} < 30
  or l.snapshot = 'cut' and pno <> 2
"""

# Twelve digits and their check digit; odd keys mostly get a wrong one.
_ID12 = "concat('3', lpad(cast({k} * 104729 as varchar(20)), 11, '0'))"
_CHECK = " + ".join(
    f"cast(substr({{id12}}, {i}, 1) as int) * {w}" for i, w in enumerate(range(13, 1, -1), 1)
)


def _id_number(id12: str, key: str) -> str:
    check = f"(11 - ({_CHECK.format(id12=id12)}) % 11) % 10"
    return f"concat({id12}, cast(case when {key} % 2 = 0 then {check} else 0 end as varchar(2)))"


SUBMISSIONS_SQL = f"""
select request_id, k, source, hu_id, hcode, health_unit_hcode, health_unit_name, health_unit_type,
  address, province, postal_code, phone, email, authority_name, admin_name,
  case when k % 10 = 9 then '' else {_id_number("id12", "k")} end as authority_id,
  case when k % 6 = 5 then '31009' else {_id_number("id12", "k")} end as admin_id,
  authority_doc, admin_doc, verified, agree_service, agree_processing, agree_sharing, agree_terms,
  n_docs, n_groups, n_panel, n_ticked
from (
  select c_custkey as k, cast(c_custkey as varchar(20)) as request_id,
    case when c_custkey % 3 = 0 then 'modal' else 'checklist' end as source,
    case when c_custkey % 17 = 0 then '' else cast(c_custkey as varchar(20)) end as hu_id,
    case c_custkey % 9 when 0 then '' when 1 then 'TEST12345' when 2 then 'ABCDEFGHI' when 3 then '12345'
      when 4 then code else code end as hcode,
    case when c_custkey % 18 = 9 then code else '' end as health_unit_hcode,
    case when c_custkey % 19 = 0 then '' else name end as health_unit_name,
    case when c_custkey % 23 = 0 then ' ' else type end as health_unit_type,
    case when c_custkey % 7 = 0 then null else concat('222 ม.', cast(c_custkey % 9 as varchar(20))) end as address,
    n_name as province,
    case c_custkey % 5 when 0 then '' when 1 then '660'
      else lpad(cast(c_custkey % 90000 + 10000 as varchar(20)), 5, '0') end as postal_code,
    case c_custkey % 6 when 0 then '' when 1 then '012345' when 2 then '088-774-9529'
      else concat('08', lpad(cast(c_custkey % 100000000 as varchar(20)), 8, '0')) end as phone,
    case c_custkey % 4 when 0 then '' when 1 then 'bad-email'
      else concat('u', cast(c_custkey as varchar(20)), '@example.com') end as email,
    case when c_custkey % 2 = 0 then owner
      else case c_custkey % 3 when 0 then 'นายสมชาย ใจดี' when 1 then 'นางสาวสมหญิง ใจงาม' else 'นาย' end
      end as authority_name,
    case c_custkey % 5 when 0 then 'สมชาย ใจดี' when 1 then 'สมหญิง ใจงาม' when 2 then 'สมชาย'
      when 3 then '' else 'นายสมศักดิ์ ดีมาก' end as admin_name,
    {_ID12.format(k="c_custkey")} as id12,
    case when c_custkey % 4 = 3 then '' else concat('/files/', cast(c_custkey as varchar(20)), '/0.pdf') end as authority_doc,
    case when c_custkey % 3 = 1 then null else concat('/files/', cast(c_custkey as varchar(20)), '/ha.pdf') end as admin_doc,
    case c_custkey % 4 when 0 then true when 1 then false when 2 then true else null end as verified,
    case c_custkey % 5 when 0 then null when 1 then false else true end as agree_service,
    case c_custkey % 5 when 0 then null when 2 then false else true end as agree_processing,
    case c_custkey % 5 when 0 then null when 3 then null else true end as agree_sharing,
    case c_custkey % 5 when 0 then null else true end as agree_terms,
    c_custkey % 5 as n_docs, c_custkey % 4 as n_groups, c_custkey % 3 as n_panel,
    c_custkey % 2 as n_ticked
  from {{customer}} join {{nation}} on c_nationkey = n_nationkey
    left join ({REGISTRY_SQL}) g on g.id = cast(c_custkey as varchar(20))) q
"""

# Document texts: five labels; labelled and bare dates, Thai digits, split glyphs,
# statutory lines, and an ID card block on every fifth document.
DOCS_SQL = f"""
select k, request_id, cast(k as bigint) as doc_ordinal,
  concat('/files/', request_id, '/', cast(k % 7 as varchar(20)), case when k % 2 = 0 then '.pdf' else '.jpg' end) as url,
  case k % 5 when 0 then 'สพ.7 ใบอนุญาต' when 1 then 'สพ.19' when 2 then 'สำเนาบัตร HA' when 3 then 'ขย.5' else '' end as label,
  case k % 3 when 0 then 'application/pdf' when 1 then '' else 'image/jpg; q=1' end as content_type,
  case when k % 23 = 0 then '' else concat(
    case when k % 5 = 2 then concat('เลขประจำตัวประชาชน ', {_id_number("id12", "k")}, chr(10),
      'ชื่อตัวและชื่อสกุล ', person, chr(10), 'Name Mr. Somchai Jaidee', chr(10)) else '' end,
    'ใบอนุญาตเลขที่ ', cast(k % 9000 + 1000 as varchar(20)), chr(10),
    case when k % 13 = 0 then '' else 'ชื่อสถานพยาบาล ' end,
    case k % 4 when 0 then 'คลินิกสุขใจ' when 1 then 'คลินิกรักษ์ดี' when 2 then 'โรงพยาบาลเมืองทอง' else 'ร้านยาใจดี' end,
    case when k % 6 = 0 then ' ประเภทไม่รับผู้ป่วย' else '' end, chr(10),
    'ผู้รับอนุญาต ', case when k % 11 = 0 then 'ต้องระวางโทษจำคุก' else person end, chr(10),
    case when k % 5 = 1 then concat('ผู้ดำเนินการ ', person, chr(10)) else '' end,
    case when k % 9 = 0 then concat('ตั้งอยู่ ถนนสุขุมวิท กรุงเทพ ', cast(k % 99 as varchar(20)), chr(10)) else '' end,
    case when k % 8 = 0 then '' else 'หมดอายุ ' end,
    cast(extract(day from o_orderdate) as varchar(2)), case when k % 2 = 0 then '/' else ' ' end,
    case when k % 2 = 0 then cast(extract(month from o_orderdate) as varchar(2)) else 'ธันวาคม' end,
    case when k % 2 = 0 then '/' else ' พ.ศ. ' end,
    cast(extract(year from o_orderdate) + 543 as varchar(4)), chr(10),
    case when k % 7 = 0 then 'ว ั น ท ี่ ก' else '' end,
    case when k % 5 = 0 then 'มาตรา ๕๕ ต้องระวางโทษ' else '' end,
    case when k % 14 = 0 then concat('นาย', chr(10), 'สมชาย', chr(10), 'ใจดี') else '' end) end as text,
  cast(90 as double) as confidence, 'pdf-text' as method,
  case when k % 23 = 0 then 'error' else 'success' end as status
from (
  select o_orderkey as k, cast(o_custkey as varchar(20)) as request_id, o_orderdate,
    case when o_orderkey % 3 = 0 then 'นางสาวสมหญิง ใจงาม' else 'นายสมชาย ใจดี' end as person,
    {_ID12.format(k="o_custkey")} as id12
  from {{orders}}) q
"""

# Pages with every way a document can be linked put behind their own HTML.
PAGES_SQL = """
select page_id, url, concat(html,
  '<a href="javascript:;" data-src="/files/', cast(page_id as varchar(20)), '/sp7.pdf">สพ.7</a>',
  '<a href="/files/', cast(page_id as varchar(20)), '/sp7.pdf"> สำเนา <b>สพ.7</b></a>',
  '<button onclick="window.open(''/upload/', cast(page_id as varchar(20)), '?a=1&amp;b=2'')">เอกสาร</button>',
  '<a href="#" onclick="downloadFile(''doc ', cast(page_id % 7 as varchar(20)), '.docx'')"></a>',
  '<a href="../storage/', cast(page_id % 3 as varchar(20)), '">บัตร</a><a href="/document/ü"></a>',
  '<a href="files/old/../new/./x.pdf">x</a><a href="?file=', cast(page_id % 5 as varchar(20)), '.pdf">q</a><a href="#part.pdf">s</a>',
  '<a href="javascript:void(0)">ตรวจเอกสาร</a><a href="/admin/checklist/', cast(page_id as varchar(20)), '">ตรวจเอกสาร</a>',
  case when page_id % 2 = 0 then '<iframe src="/files/viewer.pdf?x=1"></iframe>' else '' end) as html
from {pages}
"""

# Pages whose markup only a browser's reading gets right; what they link to is stated in the
# queries' twins.
HARD_PAGES_SQL = """
select -page_id - 1 as page_id, url, concat(
  '<a title="see href=''/no.pdf''" href="/files/a', cast(page_id as varchar(20)), '.pdf">a</a>',
  '<!-- <a href="/files/old.pdf">old</a> --><script>var x = ''<a href="/files/js.pdf">js</a>'';</script>',
  '<a href="&#47;files&#x2F;n', cast(page_id as varchar(20)), '.pdf?a=1&copy=2">b&nbsp;&hellip;</a>',
  '<a data-x=''<a href="/files/in.pdf">'' href=/files/u', cast(page_id as varchar(20)), '.pdf>un<!-- no --></a>',
  '<a href="/files/q', cast(page_id as varchar(20)), '.pdf"><button onclick="window.open(''/upload/z'')">bo<i>th</i></button></a>',
  '<textarea><a href="/files/t.pdf">t</a></textarea>',
  '<A HREF=''/files/dup', cast(page_id as varchar(20)), '.pdf'' href=''/files/second.pdf''>first',
  '<p><a href="/admin/checklist/', cast(page_id as varchar(20)), '">ตรวจเอกสาร</p></a><a href="/files/again.pdf">one</a>',
  '<a href="/files/again.pdf">two</a><embed src="/files/again.pdf"><iframe src="/files/v.pdf"><a href="/files/w.pdf">w</a></iframe>',
  '<a href="/files/never.pdf"') as html
from {pages}
"""

# Checklist boxes and step headings of a request's review page.
PAGE_TEXT_SQL = f"""
select k, request_id, concat('{HOST}/admin/checklist/', request_id) as url,
  concat('Check List : ', case when k % 3 = 0 then 'คลินิก' else health_unit_name end) as heading,
  concat('รหัสหน่วยบริการ: ', hcode, chr(10), 'ประเภทการสมัคร: ใหม่ ', source, ' ', chr(10),
    case when k % 2 = 0 then concat('ชื่อหน่วยงาน/ชื่อสถาน พยาบาล: ', health_unit_name, chr(10)) else '' end,
    'รหัสหน่วย งานบริการ สุขภาพ ', health_unit_hcode, chr(10),
    'ชื่อ Admin: ', admin_name, chr(10), 'อีเมล: ', email, chr(10),
    'ข้อมูลผู้มีอำนาจ', chr(10), 'ชื่อ: ', authority_name, ' อีเมล: a', request_id, '@example.org', chr(10),
    case when k % 4 = 0 then 'ยืนยันตัวตนแล้ว' else 'รอ' end, chr(10),
    'รายการตรวจสอบ 1 : สพ.7 ', province, chr(10), 'รายการตรวจสอบ 2: บัตร สถานะ ', province, chr(10),
    'รายการตรวจสอบ 3 / 3 : ข้าม') as text,
  concat('<h3> รายการตรวจสอบ 1 / 2 :  ใบอนุญาต ', province, '</h3>',
    '<label><input type="checkbox" name="check_detail[7][1]" checked> ชื่อตรงกับ LOI </label>',
    '<label class="x"> <input name="check_detail[3][1]" type="checkbox">ไม่หมดอายุ<br>', province, '</label>',
    '<label><input type="checkbox" name="check_detail[7][2]">เลือกทั้งหมด</label>',
    case when k % 2 = 0 then '<h3>รายการตรวจสอบ 2/2: บัตร</h3>' else '' end) as html
from ({SUBMISSIONS_SQL}) s
"""

# Checklists in markup where a box's label depends on the elements around it; the labels are
# stated in the query's twin.
HARD_CHECKLIST_SQL = f"""
select -k - 1 as k, concat('<h2>รายการตรวจสอบ 1 / 2 : <b>ก &amp; ข</b></h2><!-- <h3>รายการตรวจสอบ 2 / 2 : ค</h3> -->',
  '<table><tr><td><span><input type=checkbox name=check_detail[7][1]></span> far text',
  '<td><input type="checkbox" name="check_detail[7][2]" title=''not checked'' value="', cast(k as varchar(20)), '"> near <b>te&#120;t</b>',
  '<tr><td>cell ', cast(k as varchar(20)), ' <input type="CHECKBOX" name="check_detail[3][1]" data-x=">" checked></table>',
  '<label>outer <b><input type="checkbox" name="check_detail[3][2]" checked=""></b> deep</label>',
  '<b><input type="checkbox" name="check_detail[3][3]" data-note="checked"> bold</b> outside',
  '<ul><li><input type="checkbox" name="check_detail[7][3]">one<li><input type="checkbox" name="check_detail[7][4]" CHECKED>two</ul>',
  '<!-- <input type="checkbox" name="check_detail[9][9]"> --><label><input type="radio" name="check_detail[9][8]">no</label>') as html
from ({SUBMISSIONS_SQL}) s
"""

EVENTS_SQL = """
select event_id, ts, user_id,
  case event_id % 6 when 0 then concat('/api/v1/health_unit/', cast(user_id as varchar(20)))
    when 1 then '/API/x/Document' when 2 then '/admin/health_unit_datatable'
    when 3 then concat('/static/', event_type) when 4 then '/api/v2/register' else '/api/v2/file/list' end as url,
  case when event_id % 5 = 0 then 'text/html' else 'application/json; charset=utf-8' end as content_type,
  concat('{{"props":', props, ',"files":["/files/', cast(event_id as varchar(20)), '","a.pdf","short",7],',
    '"nested":{{"deep":[{{"link":"x', cast(event_id % 9 as varchar(20)), '.PNG","other":"nothing here"}}],"n":null}},',
    '"avatar":"', event_type, '/upload/', cast(user_id as varchar(20)), '"}}') as body
from {events}
"""

REPLIES_SQL = """
select cast(o_orderkey as varchar(20)) as request_id, concat('/files/', cast(o_orderkey as varchar(20))) as url,
  case o_orderkey % 7 when 0 then 'no object here'
    when 1 then concat('{{ "documentType": broken ', o_orderstatus, ' }}')
    else concat('Here is it: {{"documentType":"',
      case when o_orderkey % 2 = 0 then 'license_sp7' else 'id_card' end, '","facilityName":',
      case when o_orderkey % 3 = 0 then 'null' else '"คลินิก ก"' end, ',"ownerName":',
      case when o_orderkey % 4 = 0 then 'null' else '"นาย ก"' end, ',"operatorName":"นาย ข","personName":"',
      o_orderstatus, '","idNumber":', case when o_orderkey % 5 = 0 then 'null' else '"3-1009-99901-41-2"' end,
      ',"licenseNumber":"', cast(o_orderkey as varchar(20)), '","expiryDate":"2025-12-31","address":"",',
      '"isHandwritten":', case o_orderkey % 3 when 0 then 'true' when 1 then '"true"' else 'false' end,
      ',"confidence":', case o_orderkey % 3 when 0 then '0.9' when 1 then '"high"' else '1' end, '}} done') end as text
from {orders}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the cores where a table has fewer files than those.

    The tables that stand-ins are made of are single files of one row group, so one task
    would do all that is derived from them. A table of many files is left as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


_TABLES = ("part", "customer", "nation", "orders", "pages", "events")


def derive(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Run stand-in SQL over the parquet tables (or given frames) it names."""
    used = {n: frames.get(n) for n in _TABLES if "{%s}" % n in sql}
    args = {n: spread(table(spark, sf_dir, n)) if df is None else df for n, df in used.items()}
    if "part" in args and "customer" in args:
        # Its files say little of the rows made of it: by their size it would be broadcast.
        args["part"] = args["part"].hint("merge")
    return spark.sql(sql, **args)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, REGISTRY_SQL)


def big_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order: the larger registry used for timing."""
    orders = spread(table(spark, sf_dir, "orders"))
    return derive_big(orders, table(spark, sf_dir, "customer"))


def derive_big(orders: DataFrame, customer: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    block = F.floor(key / 6).cast("string")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            key.cast("string").alias("id"),
            F.when(key % 50 == 0, "")
            .otherwise(F.lpad((key - F.when(key % 20 == 7, 1).otherwise(0)).cast("string"), 12, "0"))
            .alias("code"),
            F.when(key % 3 == 0, F.col("c_mktsegment"))
            .otherwise(F.concat(F.col("c_mktsegment"), F.lit(" "), block))
            .alias("name"),
            F.col("o_orderpriority").alias("type"),
            F.col("o_orderstatus").alias("status"),
            F.col("c_name").alias("owner"),
            F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate")).alias("sla"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("create_date"),
            key.alias("input_order"),
        )
    )


# Fixed values of the stand-in forms: document labels and checklist groups.
DOC_LABELS = ["สพ.7", "สพ.19", "บัตร", ""]
GROUP_TITLES = ["สพ.7 ใบอนุญาต", "สำเนาบัตร", "ขย.5"]
GROUP_ITEMS = [["ตรวจชื่อตรงกับ LOI", "ไม่หมดอายุ"], ["ชื่อถูกต้อง"], ["วันหมดอายุชัดเจน", "ลายเซ็น"]]
PANEL_NAMES = ["ตรวจชื่อ", "ตรวจวัน"]


def nest_submissions(flat: DataFrame) -> DataFrame:
    """Submissions with their nested columns, from the flat stand-in."""
    k = F.col("k")

    def upto(n: str, build):
        """Array of build(i) for i below n, which is at most four."""
        items = F.array(*[F.when(F.col(n) > i, build(i)) for i in range(4)])
        return F.filter(items, lambda x: x.isNotNull())

    def link(i: int):
        return F.struct(
            F.concat(F.lit("/files/"), "request_id", F.lit(f"/{i}.pdf")).alias("url"),
            F.lit(DOC_LABELS[i]).alias("text"),
            F.lit(None).cast("string").alias("type"),
        )

    def group(i: int):
        if i >= len(GROUP_TITLES):
            return F.lit(None)
        items = [
            F.struct(
                F.lit(str(j + 1)).alias("item_id"),
                F.lit(label).alias("label"),
                (k % 2 == 0).alias("checked"),
            )
            for j, label in enumerate(GROUP_ITEMS[i])
        ]
        return F.struct(
            F.lit(str(i + 1)).alias("group_id"),
            F.lit(GROUP_TITLES[i]).alias("document"),
            F.array(*items).alias("items"),
        )

    def panel(i: int):
        if i >= len(PANEL_NAMES):
            return F.lit(None)
        return F.struct(
            F.lit(None).cast("int").alias("number"),
            F.lit(PANEL_NAMES[i]).alias("name"),
            (F.lit(i) < F.col("n_ticked")).alias("checked"),
            F.lit(True).alias("from_panel"),
        )

    api = F.array(
        F.struct(F.lit("file").alias("key"), F.concat(F.lit("/files/"), "request_id", F.lit("/1.pdf")).alias("value")),
        F.struct(F.lit("scan").alias("key"), F.concat(F.lit("/storage/"), "request_id").alias("value")),
    )
    nested = flat.withColumns(
        {
            "input_order": k,
            "url": F.concat(F.lit(f"{HOST}/admin/checklist/"), "request_id"),
            "authority_info": F.struct(
                F.col("authority_name").alias("name"),
                F.col("authority_id").alias("id_number"),
                F.col("authority_doc").alias("id_doc_url"),
                F.lit(None).cast("string").alias("email"),
                "verified",
            ),
            "admin_info": F.struct(
                F.col("admin_name").alias("name"),
                F.col("admin_id").alias("id_number"),
                F.col("email"),
                F.col("admin_doc").alias("id_doc_url"),
            ),
            "documents": upto("n_docs", link),
            "document_urls": F.when(k % 2 == 0, F.array(link(0), link(2))),
            "api_document_urls": F.when(k % 3 == 0, api),
            "checklist": upto("n_panel", panel),
            "agreements": F.struct(
                F.col("agree_service").alias("service_agreement"),
                F.col("agree_processing").alias("data_processing"),
                F.col("agree_sharing").alias("data_sharing"),
                F.col("agree_terms").alias("terms_accepted"),
            ),
            "checklist_groups": upto("n_groups", group),
        }
    )
    names = T.StructType.fromDDL(schemas.SUBMISSIONS).names
    return nested.select(*[n for n in names if n in nested.columns])


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest_submissions(derive(spark, sf_dir, SUBMISSIONS_SQL))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, DOCS_SQL, orders=spread(table(spark, sf_dir, "orders")))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, REPLIES_SQL, orders=spread(table(spark, sf_dir, "orders")))
