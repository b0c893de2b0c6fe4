"""Relations of the engine and its fixed dimension tables (tiny: their size doesn't depend on data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOKENS = "document_id bigint, page_id bigint, token_index int, token string, x0 int, y0 int, x1 int, y1 int, conf_pct double, block_num int, paragraph_num int, line_num int, word_num int"
PREDICTIONS = "page_id bigint, token_index int, token string, label string, confidence double, bbox array<int>, block_num int, paragraph_num int, line_num int"
CHUNK_PREDICTIONS = "page_id bigint, chunk_start int, local_index int, sub_index int, token string, label string, confidence double"
SPAN = "struct<page_id:bigint,page_number:int,text:string,bounding_boxes:array<array<double>>>"
STAGED = (
    "struct<temp_id:string,page_id:bigint,page_number:int,document_id:bigint,entity_type_label:string,extracted_value:string,original_prediction:string,"
    f"bounding_boxes:array<array<double>>,page_spans:array<{SPAN}>,confidence_score:double,validation_status:string,source:string,saved:boolean>"
)
DOCUMENTS = (
    "id bigint, name string, format string, owner_id string, document_type string, page_count int, timestamp timestamp, processing_started_at timestamp, "
    f"processing_finished_at timestamp, processing_duration_seconds double, status string, extracted_attributes array<{STAGED}>"
)
PAGES = "id bigint, document_id bigint, page_number int, image_path string, storage_key string"
ATTRIBUTES = (
    "id bigint, page_id bigint, document_id bigint, entity_type_label string, extracted_value string, bounding_boxes array<array<double>>, "
    f"page_spans array<{SPAN}>, confidence_score double, validation_status string, source string"
)
CORRECTIONS = "id bigint, attribute_id bigint, original_prediction string, corrected_value string, operator_user string, timestamp timestamp"
ANNOTATED_PAGE = (
    "document_id string, page_id int, page_number int, id string, image string, tokens array<string>, bboxes array<array<int>>, labels array<string>, "
    "confidences array<double>, document_type string, fields map<string,string>"
)
TEXT_EXAMPLE = "text string, label string"
CVAT = "_name string, box array<struct<_label:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double>>"

# Document types with display name, keywords, expected fields and label aliases, in order of precedence.
DOCUMENT_TYPES = {
    "invoice": {
        "display_name": "Invoice",
        "keywords": ["invoice", "bill to", "subtotal", "amount due", "invoice number", "due date"],
        "fields": ["invoice_number", "invoice_date", "vendor_name", "bill_to", "total_amount"],
        "aliases": {
            "invoice number": "invoice_number", "invoice_no": "invoice_number", "invoice no": "invoice_number", "number": "invoice_number", "date": "invoice_date",
            "name": "vendor_name", "total": "total_amount", "amount": "total_amount", "due date": "due_date", "address": "bill_to",
        },
    },
    "receipt": {
        "display_name": "Receipt",
        "keywords": ["receipt", "cashier", "subtotal", "tax", "change", "payment"],
        "fields": ["merchant_name", "purchase_date", "total_amount", "tax_amount"],
        "aliases": {"merchant": "merchant_name", "name": "merchant_name", "date": "purchase_date", "total": "total_amount", "amount": "total_amount", "tax": "tax_amount"},
    },
    "student_id": {
        "display_name": "Student ID",
        "keywords": ["student id", "student card", "id card", "school", "university", "campus"],
        "fields": ["student_name", "student_id", "issue_date", "expiry_date"],
        "aliases": {"name": "student_name", "student name": "student_name", "id": "student_id", "number": "student_id", "date": "issue_date", "expiry": "expiry_date"},
    },
    "transcript": {
        "display_name": "Transcript",
        "keywords": ["transcript", "course", "semester", "gpa", "credits", "grades"],
        "fields": ["student_name", "student_id", "program", "gpa"],
        "aliases": {"name": "student_name", "student id": "student_id", "id": "student_id", "program": "program", "gpa": "gpa"},
    },
    "form": {
        "display_name": "Form",
        "keywords": ["form", "please fill", "signature", "checkbox", "check box", "applicant"],
        "fields": ["applicant_name", "date", "signature"],
        "aliases": {"name": "applicant_name", "applicant": "applicant_name", "date": "date", "signature": "signature"},
    },
    "letter": {
        "display_name": "Letter",
        "keywords": ["dear", "greetings", "subject", "sincerely", "respectfully", "request for"],
        "fields": ["date", "recipient", "subject", "sender", "body"],
        "aliases": {"to": "recipient", "recipient": "recipient", "subject": "subject", "from": "sender", "sender": "sender", "date": "date", "body": "body"},
    },
}
UNKNOWN_TYPE, UNKNOWN_NAME = "unknown", "Unknown"

# The statuses of a document and where each may go.
TRANSITIONS = {
    "PENDING": ["QUEUED", "CANCELED"],
    "QUEUED": ["PROCESSING", "CANCELED"],
    "PROCESSING": ["PROCESSED", "FAILED", "CANCELED"],
    "PROCESSED": ["APPROVED", "PROCESSING"],
    "FAILED": ["QUEUED"],
    "APPROVED": ["PROCESSING"],
    "CANCELED": ["QUEUED"],
}

# Accepted file extensions and their media types.
FORMATS = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".jpeg": "image/jpeg",
    ".jpg": "image/jpeg",
    ".png": "image/png",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
}

# Attribute statuses that search, the table export and the training export take as valid.
SEARCHABLE = ("APPROVED", "PROCESSED")
EXPORTABLE = ("APPROVED", "VALIDATED", "CORRECTED")
TRAINABLE = ("APPROVED",)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def keyword_table(spark: SparkSession, types: dict = DOCUMENT_TYPES) -> DataFrame:
    """A keyword with a space in it counts twice."""
    rows = [(t, k, word, 2 if " " in word else 1) for k, (t, x) in enumerate(types.items()) for word in x["keywords"]]
    return _table(spark, rows, "document_type string, ordinal int, keyword string, weight int")


def alias_table(spark: SparkSession, types: dict = DOCUMENT_TYPES) -> DataFrame:
    return _table(spark, [(t, a, c) for t, x in types.items() for a, c in x["aliases"].items()], "document_type string, alias string, canonical string")


def field_table(spark: SparkSession, types: dict = DOCUMENT_TYPES) -> DataFrame:
    return _table(spark, [(t, f) for t, x in types.items() for f in x["fields"]], "document_type string, field string")


def line_label_map(types: dict = DOCUMENT_TYPES) -> dict[str, dict[str, str]]:
    """Labels that may open a line, by type: aliases, then expected fields as they are and with spaces (later ones win)."""
    return {t: {**x["aliases"], **{f: f for f in x["fields"]}, **{f.replace("_", " "): f for f in x["fields"]}} for t, x in types.items()}


def transition_table(spark: SparkSession) -> DataFrame:
    return _table(spark, [(a, b) for a, targets in TRANSITIONS.items() for b in targets], "source string, target string")


def format_table(spark: SparkSession) -> DataFrame:
    return _table(spark, list(FORMATS.items()), "extension string, media_type string")
