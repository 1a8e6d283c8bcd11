"""Declared schemas: tables of the bank and the inputs that feed it. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

OPTIONS = "array<struct<label:string,text:string,image:string>>"
BOXES = "array<struct<page:int,bbox:array<double>>>"
COUNTS = "map<string,struct<questions:int,qids:int,labels:int>>"

TABLES = {
    "exam_pattern": "section string, questions int, marks_correct decimal(4,2), marks_wrong decimal(4,2), default_timer_sec int",
    "papers": "id string, exam_date date, time_slot string, source_filename string, stored_path string, sha256 string, key_status string",
    "mocks": "id string, paper_id string, section string, timer_sec int, status string",
    "questions": "id bigint, mock_id string, q_no int, ssc_question_id string, status string, current_version_id bigint",
    "question_versions": f"id bigint, question_id bigint, version int, content_hash string, stem_text string, stem_text_complete boolean, stem_image string, options {OPTIONS}, option_ids map<string,string>, official_answer string, answer_text_layer string, "
    f"answer_page_image string, key_status string, has_visual boolean, source_page int, source_bbox {BOXES}, question_crop string, topic string, subtopic string, topic_source string, created_at timestamp",
    "question_assets": "id bigint, question_version_id bigint, kind string, path string, shows_answer boolean",
    "answer_verifications": "id bigint, question_version_id bigint, solver_id string, model string, prompt_version string, method string, solver_answer string, matches_key boolean, steps array<string>, check_code string, check_passed boolean, check_note string, confidence double, valid boolean, created_at timestamp",
    "review_queue": "id bigint, question_id bigint, paper_id string, section string, q_no int, source string, reasons array<string>, status string, created_at timestamp",
}

SOURCE = f"date string, time_slot string, filename string, sha256 string, key_status string, accepted boolean, reasons array<string>, notes string, overflow_questions int, unlabeled_questions int, clipped_qids array<string>, sections {COUNTS}, stored_path string"
MANIFEST = f"sources array<struct<{SOURCE.replace(' array', ':array').replace(' map', ':map').replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace(', ', ',')}>>, duplicates array<struct<filename:string,sha256:string,same_as:string>>, excluded array<string>"
QUESTION_RECORD = (
    f"paper_id string, mock_id string, q_no int, section string, ssc_question_id string, option_ids map<string,string>, stem_text string, stem_text_complete boolean, stem_image string, options {OPTIONS}, official_answer string, answer_text_layer string, answer_page_image string, key_status string, "
    f"source_file string, source_page int, source_bbox {BOXES}, question_crop string, has_visual boolean, status string, review_reasons array<string>, topic string, subtopic string, topic_source string"
)
REVIEW_RECORD = "paper_id string, section string, q_no int, reasons array<string>"
RUN = "struct<question_version:string,solver_id:string,prompt_version:string,model:string,method:string,solver_answer:string,matches_key:boolean,steps:array<string>,check_code:string,check_passed:boolean,check_note:string,confidence:double,valid:boolean>"
VERIFICATION_RECORD = f"paper_id string, section string, q_no int, official_answer string, status string, verifications array<{RUN}>"

DOCS = "file string, sha256 string, page_count int, producer string, annotations int"
PAGES = "file string, page_no int, text string"
SPANS = "file string, page_no int, line_no int, span_no int, text string, color int, span_x0 double, span_y0 double, line_x0 double, line_y0 double, line_x1 double"


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
