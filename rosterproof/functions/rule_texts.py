"""Titles and details of the rule checks, ``%s`` standing for a value."""

# Presence rules: title, detail when present, detail when missing, status when missing.
CHECKLIST_PRESENCE = {
    "hcode-present": ("มีรหัสหน่วยบริการ (HCode)", "รหัส: %s", "ไม่พบรหัสหน่วยบริการ", "fail"),
    "unit-name": ("ชื่อหน่วยบริการ", "ชื่อ: %s", "ไม่พบชื่อหน่วยบริการ", "fail"),
    "unit-type": ("ประเภทหน่วยบริการ", "ประเภท: %s", "ไม่พบประเภทหน่วยบริการ", "fail"),
    "address": ("ที่อยู่", "ที่อยู่: %s", "ไม่พบที่อยู่", "warn"),
    "province": ("จังหวัด", "จังหวัด: %s", "ไม่พบจังหวัด", "warn"),
    "postal-code": ("รหัสไปรษณีย์", "รหัสไปรษณีย์: %s", "ไม่พบรหัสไปรษณีย์", "warn"),
    "phone": ("เบอร์โทรศัพท์", "เบอร์: %s", "ไม่พบเบอร์โทรศัพท์", "warn"),
    "authority-name": ("ชื่อผู้มีอำนาจ", "ชื่อ: %s", "ไม่พบชื่อผู้มีอำนาจ", "fail"),
    "authority-id-doc": ("เอกสารสำเนาบัตรผู้มีอำนาจ", "พบลิงก์เอกสาร ", "ไม่พบลิงก์เอกสารสำเนาบัตร", "fail"),
    "admin-name": ("ชื่อ Hospital Admin (HA)", "ชื่อ: %s", "ไม่พบชื่อ HA", "warn"),
}
MODAL_PRESENCE = {
    "hcode-present": ("มีรหัสหน่วยบริการ", "รหัส: %s", "ไม่พบ HCode", "fail"),
    "unit-name": ("ชื่อหน่วยบริการ", "%s", "ไม่พบชื่อ", "fail"),
    "admin-name": ("ชื่อ Admin", "%s", "ไม่พบ", "warn"),
    "authority-name": ("ชื่อผู้มีอำนาจ", "%s", "ไม่พบ", "warn"),
}
# Yes-or-no rules: title, detail for yes, detail for no.
MODAL_YES_NO = {
    "thai-id-verify": ("ยืนยัน ThaiID", "ยืนยันแล้ว", "ยังไม่ยืนยัน"),
    "svc-agree": ("Service Agreement", "", "ยังไม่ยอมรับ"),
    "dp-agree": ("Data Processing Addendum", "", "ยังไม่ยอมรับ"),
    "ds-agree": ("Data Sharing Addendum", "", "ยังไม่ยอมรับ"),
}
AGREEMENTS = {
    "service_agreement": "Service Agreement",
    "data_processing": "Data Processing Addendum",
    "data_sharing": "Data Sharing Addendum",
    "terms_accepted": "ยอมรับเงื่อนไขการให้บริการ",
}

POSTAL_BAD = ": รูปแบบไม่ถูกต้อง"
PHONE_OK = " "
PHONE_BAD = ": รูปแบบไม่ปกติ"

HCODE_TITLE = "รูปแบบ HCode"
HCODE_NO_DIGIT = "%s ไม่มีตัวเลข น่าจะเป็นข้อมูลทดสอบ"
HCODE_TEST = "%s ขึ้นต้นด้วย TEST น่าจะเป็นข้อมูลทดสอบ"
HCODE_STANDARD = "%s รูปแบบมาตรฐาน 9 หลัก"
HCODE_OTHER = "%s ยาว %s หลัก ไม่ใช่ 9 หลักมาตรฐาน"

EMAIL_TITLE = "อีเมลหน่วยงาน"
EMAIL_TITLE_ADMIN = "อีเมล Admin"
EMAIL_MISSING = "ไม่พบอีเมล"
EMAIL_OK = "%s "
EMAIL_BAD = "%s: รูปแบบไม่ถูกต้อง"

ID_TITLE_AUTHORITY = "เลขบัตร ปชช. ผู้มีอำนาจ"
ID_TITLE_ADMIN = "เลขบัตร ปชช. HA"
ID_MISSING = "ไม่พบเลขบัตร"
ID_DETAIL = "%s: %s"

NAMES_TITLE = "ผู้มีอำนาจ vs HA"
NAMES_TITLE_INCOMPLETE = "เปรียบเทียบชื่อ"
NAMES_INCOMPLETE = "มีข้อมูลชื่อไม่ครบ ไม่สามารถเปรียบเทียบ"
NAMES_SAME = "เป็นคนเดียวกัน (%s%): %s"
NAMES_DIFFERENT = "คนละคน:\nผู้มีอำนาจ: %s\nHA: %s"

NO_CODE = "ไม่มีรหัส"
MORE = "\n… อีก %s รายการ"
DUP_TITLE = "ตรวจสอบสถานพยาบาลซ้ำ"
DUP_TITLE_STRONG = "สถานพยาบาลซ้ำ (%s)"
DUP_TITLE_WEAK = "ชื่อคล้ายกัน (%s)"
DUP_RECORD = " [%s] %s (%s): id %s, %s"
DUP_NOT_CHECKED = "ดึงรายชื่อหน่วยบริการไม่สำเร็จ: ยังไม่ได้ตรวจ"
DUP_STRONG = " พบรายการซ้ำชัดเจน\n%s%s"
DUP_WEAK = " ชื่อตรงกันแต่คนละเจ้าของ/รหัส: ควรตรวจด้วยตนเอง\n%s%s"
DUP_GENERIC = 'ชื่อหน่วยบริการเป็นชื่อทั่วไป (เช่น "เอกชน"): ตรวจซ้ำด้วยชื่อไม่ได้'
DUP_NONE = " ไม่พบซ้ำ (เทียบกับ %s รายการ)"

OWNER_TITLE_NONE = "เจ้าของยื่นคำร้องอื่น"
OWNER_TITLE = "เจ้าของมีคำร้องอื่น (%s)"
OWNER_NONE = " ไม่พบคำร้องอื่นของเจ้าของรายนี้"
OWNER_RECORD = " %s (%s): %s"

DOCS_TITLE = "เอกสารที่พบ (%s ไฟล์)"
DOCS_NONE = 'ไม่พบลิงก์เอกสาร: อาจต้องคลิก "ตรวจเอกสาร"'

AGREEMENTS_TITLE = "การยอมรับข้อตกลง"
AGREEMENTS_TITLE_COUNT = "การยอมรับข้อตกลง (%s/%s)"
AGREEMENTS_NONE = "ไม่พบช่องยอมรับข้อตกลงในหน้านี้"

COVERAGE_TITLE = "เอกสารครบตามรายการ (%s/%s)"
COVERAGE_SHORT = " ต้องมีเอกสาร %s ฉบับ แต่พบ %s ฉบับ"
COVERAGE_OK = " พบเอกสารครบ %s ฉบับตามรายการตรวจ"

ADAPTIVE_TITLE = "รายการตรวจของคำร้องนี้ (%s เอกสาร / %s ข้อ)"
ADAPTIVE_GROUP = "เอกสาร %s"
ADAPTIVE_ITEM = "   %s %s"
ADAPTIVE_AUTO = "(ตรวจอัตโนมัติได้ถ้า OCR อ่านออก)"
ADAPTIVE_MANUAL = "(ต้องตรวจเอง)"
ADAPTIVE_TOTAL = "%s\n\nตรวจอัตโนมัติได้สูงสุด %s/%s ข้อ"
# Items about these can be decided from documents.
AUTO_ITEM_PATTERNS = [r"(?i)ตรงกับ\s*LOI", "ไม่หมดอายุ"]

PANEL_TITLE = "ความคืบหน้า Checklist (%s/%s)"
PANEL_DONE = "ติ๊กครบทุกข้อแล้ว"
PANEL_LEFT = 'ยังไม่ได้ติ๊ก %s ข้อ (ดูรายละเอียดในการ์ด "รายการตรวจของคำร้องนี้")'
PANEL_SELECT_WORD = "เลือก"
