"""Schemas of the landed tables."""

REGISTRY = (
    "id string, code string, name string, type string, status string, owner string, "
    "sla int, create_date string, input_order bigint"
)

RAW_REGISTRY_PAGE = (
    "recordsTotal int, data array<struct<hu_id:string,hu_code:string,hu_name:string,"
    "hu_type_name:string,status:string,member_fname:string,member_lname:string,sla:string,"
    "create_date:string>>"
)

_LINK = "struct<url:string,text:string,type:string>"
_RECORD = "struct<id:string,code:string,name:string,owner:string,status:string>"
_MATCH = "struct<id:string,code:string,name:string,owner:string,status:string,why:string>"

SUBMISSIONS = (
    "request_id string, source string, url string, input_order bigint, hu_id string, "
    "hcode string, health_unit_hcode string, health_unit_name string, health_unit_type string, "
    "address string, province string, postal_code string, phone string, email string, "
    "authority_info struct<name:string,id_number:string,id_doc_url:string,email:string,"
    "verified:boolean>, "
    "admin_info struct<name:string,id_number:string,email:string,id_doc_url:string>, "
    f"documents array<{_LINK}>, document_urls array<{_LINK}>, "
    "api_document_urls array<struct<key:string,value:string>>, "
    "checklist array<struct<number:int,name:string,checked:boolean,from_panel:boolean>>, "
    "agreements struct<service_agreement:boolean,data_processing:boolean,"
    "data_sharing:boolean,terms_accepted:boolean>, "
    "checklist_groups array<struct<group_id:string,document:string,"
    "items:array<struct<item_id:string,label:string,checked:boolean>>>>, "
    f"duplicate_lists struct<strong:array<{_MATCH}>,weak:array<{_MATCH}>,"
    "generic:boolean,checked:int>, "
    f"owner_other_units array<{_RECORD}>"
)

DOC_TEXTS = (
    "request_id string, doc_ordinal bigint, url string, label string, content_type string, "
    "text string, confidence double, method string, status string"
)

MODEL_RESPONSES = "request_id string, url string, text string"

API_EVENTS = (
    "event_id bigint, url string, method string, status int, content_type string, "
    "body string, ts timestamp"
)
