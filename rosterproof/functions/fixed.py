"""Fixed values.

Word lists, titles, messages and patterns that have to be these exact values for
results to be right. Nothing here is computed.
"""

# --- character classes -------------------------------------------------------
# Blank characters (the body of a regex class): ASCII blanks plus the Unicode
# spaces, line separators and the byte order mark.
BLANK = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
# The same characters as a plain string.
BLANK_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = f"[{BLANK}]"
NOT_WS = f"[^{BLANK}]"
# Any character but a line terminator.
DOT = r"[^\n\r\x{2028}\x{2029}]"
THAI = r"\x{0E00}-\x{0E7F}"
THAI_MARKS = r"\x{0E31}\x{0E33}-\x{0E3A}\x{0E47}-\x{0E4E}"
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
ASCII_DIGITS = "0123456789"

# Letters OCR reads in place of digits, and the digits they stand for.
CONFUSABLE_LETTERS = "OolIsSBzZ"
CONFUSABLE_DIGITS = "001155822"

# --- months ------------------------------------------------------------------
THAI_MONTHS = {
    "มกราคม": 1,
    "กุมภาพันธ์": 2,
    "มีนาคม": 3,
    "เมษายน": 4,
    "พฤษภาคม": 5,
    "มิถุนายน": 6,
    "กรกฎาคม": 7,
    "สิงหาคม": 8,
    "กันยายน": 9,
    "ตุลาคม": 10,
    "พฤศจิกายน": 11,
    "ธันวาคม": 12,
    "ม.ค.": 1,
    "ก.พ.": 2,
    "มี.ค.": 3,
    "เม.ย.": 4,
    "พ.ค.": 5,
    "มิ.ย.": 6,
    "ก.ค.": 7,
    "ส.ค.": 8,
    "ก.ย.": 9,
    "ต.ค.": 10,
    "พ.ย.": 11,
    "ธ.ค.": 12,
}

# --- statutory phrases that are never a field value ----------------------------
BOILERPLATE = [
    "ประกอบกิจการสถานพยาบาล",
    "ดำเนินการสถานพยาบาล",
    "ดําเนินการสถานพยาบาล",
    "ต้องระวางโทษ",
    "จำคุก",
    "จําคุก",
    "ริบบรรดาสิ่ง",
    "ศาลจะสั่ง",
    "พระราชบัญญัติ",
    "และที่แก้ไขเพิ่มเติม",
    "ที่ไม่รับผู้ป่วยไว้ค้างคืน",
    "ที่รับผู้ป่วยไว้ค้างคืน",
    "ที่ใช้ในการ",
    "ด้วยก็ได้",
    "ไม่ได้รับอนุญาต",
    "มาตรา",
    "เป็นการ",
    "แสนบาท",
    "ผู้อนุญาต",
    "ให้ไว้ ณ วันที่",
    "ออกให้เพื่อ",
]

GENERIC_TERMS = [
    "สถานพยาบาล",
    "คลินิก",
    "โรงพยาบาล",
    "ร้านยา",
    "ดําเนินการ",
    "ดำเนินการ",
    "ประกอบกิจการ",
    "ผู้ป่วย",
    "ประเภท",
    "เลขที่",
    "ชื่อ",
]

# --- field labels on licences and ID cards -------------------------------------
LABELS = {
    "facility_name": [
        "ชื่อสถานพยาบาล",
        "สถานพยาบาลชื่อ",
        "ชื่อคลินิก",
        "ชื่อสถานประกอบการ",
        "ชื่อร้าน",
        "ชื่อร้านยา",
    ],
    "owner_name": ["ผู้รับอนุญาต", "ผู้รับใบอนุญาต", "ผู้ได้รับอนุญาต", "เจ้าของกิจการ", "ผู้ประกอบกิจการ"],
    "operator_name": ["ผู้ดำเนินการ", "ผู้ดําเนินการ", "ผู้ประกอบวิชาชีพ", "ผู้ดำเนินการสถานพยาบาล"],
    "pharmacist_name": ["เภสัชกร", "ผู้มีหน้าที่ปฏิบัติการ"],
    "license_number": ["ใบอนุญาตเลขที่", "เลขที่ใบอนุญาต", "ใบอนุญาตที่", "เลขที่", "License No", "No"],
    "expiry": [
        "วันหมดอายุ",
        "หมดอายุ",
        "ใช้ได้ถึง",
        "สิ้นสุด",
        "ถึงวันที่",
        "สิ้นอายุ",
        "วันสิ้นอายุ",
        "วันบัตรหมดอายุ",
    ],
    "address": ["ตั้งอยู่", "ที่ตั้ง", "ที่อยู่", "สถานที่ตั้ง"],
    "person_name": ["ชื่อตัวและชื่อสกุล", "ชื่อตัวและชื่อสกล", "ชื่อสกุล", "ชื่อตัว", "ชื่อ-สกุล", "ชื่อ"],
    "id_number": [
        "เลขประจำตัวประชาชน",
        "เลขประจําตัวประชาชน",
        "หมายเลขบัตรประจำตัวประชาชน",
        "เลขบัตรประชาชน",
        "Identification Number",
    ],
    "facility_type": ["ประเภท", "ลักษณะ"],
}

FACILITY_LEAD = ["สถานพยาบาลชื่อ", "ชื่อสถานพยาบาล", "ลักษณะสถานพยาบาล", "ณสถานพยาบาล", "ชื่อสถานประกอบการ"]
FACILITY_END = [
    "จํานวนเตียง",
    "จำนวนเตียง",
    "ประเภท",
    "ตั้งอยู่",
    "ที่ตั้ง",
    "เลขที่",
    "ผู้รับอนุญาต",
    "ผู้ดำเนินการ",
    "ผู้ดําเนินการ",
]
FACILITY_KINDS = ["สหคลินิก", "คลินิก", "โรงพยาบาล", "ร้านยา", "ศูนย์"]
FACILITY_KIND_WORDS = ["สหคลินิก", "คลินิก", "โรงพยาบาล", "สถานพยาบาล", "ร้านยา", "ศูนย์"]
ORGANISATION_KINDS = ["โรงพยาบาล", "คลินิก", "ร้านยา", "สถานพยาบาล", "ศูนย์"]
PERSON_LEAD = ["ชื่อตัวและชื่อสกุล", "ชื่อสกุล", "ชื่อตัว", "ชื่อ"]
PERSON_END = ["เกิดวันที่", "วันออกบัตร", "วันบัตรหมดอายุ", "ที่อยู่", "Name"]
# Longest title first: used when a title must be found in text.
THAI_TITLES = ["นางสาว", "นาง", "นาย"]
# Title order of the name comparison. "นาง" is tried before "นางสาว".
NAME_TITLES = ["นาย", "นาง", "นางสาว", r"Mr\.", r"Mrs\.", r"Ms\.", r"Dr\."]

# --- document types, first hit wins --------------------------------------------
DOC_TYPE_WORDS = [
    ("pharmacy_license", ["ขย.5", "ขย5", "ขายยา", "pharmacy"]),
    ("license_sp7", ["สพ.7", "สพ7", "กิจการ", "sp7", "sp_7"]),
    ("license_sp19", ["สพ.19", "สพ19", "ดำเนินการ", "sp19", "sp_19"]),
    ("id_card", ["บัตร", "ประชาชน", "id_card", "idcard", "director", "admin"]),
]

# --- registry ------------------------------------------------------------------
PENDING_STATUS = "รออนุมัติเอกสาร"
WHY_CODE = "รหัสหน่วยบริการซ้ำ"
WHY_NAME_OWNER = "ชื่อและเจ้าของซ้ำ"
WHY_NAME = "ชื่อซ้ำ"
LABEL_CODE = "รหัสซ้ำ "
LABEL_NAME_OWNER = "ชื่อ+เจ้าของซ้ำ: "
LABEL_NAME = "ชื่อซ้ำ: "
FLAG_STRONG = "ซ้ำชัดเจน (รหัส/ชื่อ+เจ้าของ)"
FLAG_WEAK = "ชื่อซ้ำกับรายการอื่น"
FLAG_NO_CODE = "ไม่มีรหัสหน่วยบริการ"
FLAG_GENERIC = "ชื่อทั่วไป ตรวจซ้ำด้วยชื่อไม่ได้"
FLAG_OWNER = "เจ้าของยื่น %d คำร้อง"
FLAG_SLA = "ค้าง %d วัน"
FLAG_IN_SWEEP = " อยู่ในกลุ่มซ้ำ (ตรวจทั้งระบบ)"
FLAG_UNREADABLE = " อ่านเอกสารไม่ได้ %d ฉบับ"

# --- links and events ----------------------------------------------------------
API_URL_PATTERNS = [
    r"/api/.*health.?unit",
    r"/api/.*register",
    r"/api/.*document",
    r"/api/.*file",
    r"/api/.*request",
    r"/admin/health_unit",
]
FILE_EXTENSIONS = ["pdf", "jpg", "jpeg", "png", "gif", "doc", "docx"]
LINK_TEXT_WORDS = ["เอกสาร", "สำเนา"]
LINK_HREF_WORDS = ["/upload", "/file", "/document", "/storage"]
MODAL_HREF_WORDS = ["checklist", "document", "file", "upload"]
REVIEW_LINK_TEXT = "ตรวจเอกสาร"
CARD_TEXT_AUTHORITY = "สำเนาบัตร ปชช. ผู้มีอำนาจ"
CARD_TEXT_ADMIN = "สำเนาบัตร ปชช. HA"
MODEL_MIME_TYPES = [
    "application/pdf",
    "image/png",
    "image/jpeg",
    "image/jpg",
    "image/webp",
    "image/heic",
]

# --- comparisons and verdicts ----------------------------------------------------
FIELD_FACILITY = "ชื่อสถานพยาบาล/ร้านยา"
FIELD_NAME = "ชื่อ"
FIELD_ID = "เลขบัตร ปชช. "
FIELD_LICENSE = "เลขที่ใบอนุญาต"
FIELD_EXPIRY = "วันหมดอายุ"
PERSON_ADMIN = " HA"
PERSON_AUTHORITY = "ผู้มีอำนาจ"
NOTE_SKELETON = "ตรงกันโดยเทียบพยัญชนะ (OCR ตกสระและวรรณยุกต์)"
NOTE_ENGLISH_ONLY = "อ่านได้เฉพาะชื่ออังกฤษ ต้องตรวจด้วยตนเอง"
SUFFIX_ENGLISH = " (อังกฤษ)"
NOTE_ID_SAME = "ตรงกัน"
NOTE_ID_DIFFERENT = "ไม่ตรง!"
FORM_HAS_NO_LICENSE = "(ไม่มีในฟอร์ม)"
NOTE_LICENSE = "พบในเอกสาร"
EXPIRY_IMPLAUSIBLE = "วันที่ไม่สมเหตุสมผล"
NOTE_IMPLAUSIBLE = "วันที่เก่าเกินไป น่าจะอ่านผิด ต้องตรวจด้วยตนเอง"
EXPIRY_UNREADABLE = "อ่านวันที่ไม่ได้"
NOTE_MANUAL = "ต้องตรวจด้วยตนเอง"
EXPIRED = "หมดอายุแล้ว!"
NOT_EXPIRED = "ยังไม่หมดอายุ"
NOTE_EXPIRED = "เอกสารหมดอายุ!"
NOTE_NOT_EXPIRED = "OK"
MANUAL_WORD = "ตนเอง"
ITEM_NAME_WORD = "ชื่อ"
ITEM_EXPIRY_WORD = "หมดอายุ"
ITEM_NOT_EXPIRED_WORD = "ไม่หมดอายุ"
REASON_OK = "ตรงกับเอกสาร"
REASON_NO_EXPIRY = "อ่านวันหมดอายุจากเอกสารไม่ได้"
REASON_NO_EVIDENCE = "ไม่มีหลักฐานจากเอกสาร"
MESSAGE_PASS = " ผ่านการตรวจสอบทุกรายการ"
MESSAGE_FAIL = " พบ %d รายการที่ไม่ผ่าน"
MESSAGE_NO_EVIDENCE = " ตรวจเอกสารอัตโนมัติไม่ได้: ต้องตรวจด้วยตนเอง"
MESSAGE_WARN = " พบ %d รายการที่ต้องตรวจสอบเพิ่ม"
BADGE_FAIL = "มีปัญหา"
BADGE_PASS = "พื้นฐานผ่าน"
DUPLICATES_NOT_CHECKED = "ไม่ได้ตรวจ"
DUPLICATES_STRONG = "พบซ้ำชัดเจน %d รายการ"
DUPLICATES_WEAK = "ชื่อคล้ายกัน %d รายการ"
DUPLICATES_NONE = "ไม่พบซ้ำ"
DEEP_BADGE_FAIL = " ไม่ผ่าน"
DEEP_BADGE_REVIEW = " ต้อง review"
DEEP_BADGE_CLEAN = " ไม่พบ flag"
