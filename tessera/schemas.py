"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


DECISION_FIELDS = (
    "result_id long, case_reference string, ecli string, judge_rapporteur string, petitioner string, popular_name string, decision_date string, "
    "announcement_date string, filing_date string, publication_date string, related_regulations array<string>, decision_form string, importance string, "
    "verdict string, topics_and_keywords array<string>, detail_url string, text_url string, full_text string"
)
PAGE_FIELDS = f"query string, page_index int, page_number int, page_size int, start_result int, end_result int, total_results int, total_pages int, results array<struct<{DECISION_FIELDS.replace(' ', ':').replace(',:', ',')}>>"
CHUNK_FIELDS = "id string, text string, case_reference string, ecli string, decision_date string, judge string, text_url string, chunk_index int, document_id long"
PAYLOAD_FIELDS = "original_id string, text string, case_reference string, ecli string, decision_date string, judge string, text_url string, chunk_index int, document_id long, source string, point_id_scheme string, content_checksum string"
POINT_FIELDS = f"id string, vector array<float>, payload struct<{PAYLOAD_FIELDS.replace(' ', ':').replace(',:', ',')}>"
HIT_FIELDS = "qid long, id string, text string, score double, source string, pos long"
LLM_OUTPUT = "struct<answer:string,reasoning:string,sources:array<string>,confidence:double>"
PLAN_STEPS = "array<struct<query:string,reason:string>>"
MESSAGES = "array<struct<role:string,content:string>>"
