"""The schemas of tags and edge types, as Spark types with nullability."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "bool": T.BooleanType()}


def struct(columns: str) -> T.StructType:
    """A schema from "name kind, ..."; a ! behind the kind says that it is never null, = gives a default."""
    fields = []
    for column in filter(None, map(str.strip, columns.split(","))):
        name, kind = column.split()
        kind, _, default = kind.partition("=")
        fields.append(T.StructField(name, _KINDS[kind.rstrip("!")], not kind.endswith("!"), {"default": default} if default else None))
    return T.StructType(fields)


# The schemas of extracted entities and relationships, all alike, and each tag's own key column.
UNIFORM_TAG = "label string!, entity_type string!, props string, confidence double, evidence_ids string, created_at long, updated_at long"
UNIFORM_EDGE = "confidence double, status string, evidence_ids string, props string, relationship_type string, created_at long"
TAG_OF = {"Person": "person", "Company": "company", "Organization": "organization", "Address": "address", "Country": "country", "Document": "document", "Phone": "phone", "Email": "email", "BankAccount": "bank_account", "Vehicle": "vehicle"}
KEY_COLUMN = {"country": "iso2", "document": "number", "phone": "number", "email": "address", "bank_account": "iban", "vehicle": "plate"}
EDGE_TYPES = ("WORKS_AT", "OWNS", "PAYS", "HAS_DOCUMENT", "HAS_PHONE", "HAS_EMAIL", "HAS_ACCOUNT", "OWNS_VEHICLE", "LOCATED_AT", "CITIZEN_OF", "RELATED_TO")
SYSTEM_TAGS = {
    "evidence": "label string!, entity_type string!, source_name string, source_type string, created_at long",
    "field_value": "label string!, entity_type string!, value string!, created_at long",
}
SYSTEM_EDGES = {
    "SUPPORTED_BY": "extraction_confidence double, created_at long",
    "HAS_FIELD_VALUE": "field_key string!, document_id string, document_type string, created_at long",
    "HAS_SUBJECT": "subject_role string!, added_at datetime!, added_by string!",
    "HAS_NOTE": "created_at datetime!",
}
INGEST_TAGS = {tag: UNIFORM_TAG + (f", {KEY_COLUMN[tag]} string" if tag in KEY_COLUMN else "") for tag in TAG_OF.values()} | SYSTEM_TAGS
INGEST_EDGES = dict.fromkeys(EDGE_TYPES, UNIFORM_EDGE) | SYSTEM_EDGES

# The wide, typed schema.
_BASE, _TIMES = "label string!, entity_type string!, risk_score double, confidence double, created_at datetime", ", updated_at datetime"
TYPED_TAGS = {
    "person": "full_name string!, date_of_birth date, nationality string, passport_number string, national_id string, status string, first_seen_at datetime, last_seen_at datetime",
    "company": "name string!, registration_number string, country string, incorporation_date date, status string, first_seen_at datetime, last_seen_at datetime",
    "address": "full_address string!, city string, country string",
    "phone": "number string!, type string",
    "email": "address string!",
    "bank_account": "account_number string!, bank_name string, iban string, swift string",
    "transaction": "amount double!, currency string, transaction_date datetime, description string",
    "document": "title string!, document_type string, language string",
    "country": "code string!, name string",
    "website": "url string!",
    "domain": "domain_name string!, registrar string",
    "ip_address": "ip string!",
    "crypto_wallet": "address string!, blockchain string",
    "sanction_entry": "sanction_list string!, sanctioned_name string, sanctioned_entity_type string, program string",
    "watchlist_entry": "watchlist_name string!, watchlisted_name string, category string",
}
TYPED_TAGS = {tag: f"{_BASE}{_TIMES}, {own}" for tag, own in TYPED_TAGS.items()}
_EDGE = "confidence double, source string, evidence_ids string, first_seen_at datetime"
TYPED_EDGES = {
    "RELATED_TO": "relationship_type string, last_seen_at datetime",
    "WORKS_AT": "position string, start_date date",
    "OWNS": "ownership_percentage double",
    "DIRECTOR_OF": "position string, appointment_date date",
    "SHAREHOLDER_OF": "shares_count int, share_class string",
    "LIVES_AT": "residence_type string",
    "TRANSFERRED_TO": "amount double, currency string, transaction_date datetime",
    "LINKED_WITH": "link_type string",
    "COMMUNICATED_WITH": "channel string, communication_date datetime",
    "REGISTERED_TO": "registration_type string, registration_date date",
    "LOCATED_AT": "location_type string",
}
TYPED_EDGES = {kind: f"{_EDGE}, {own}" for kind, own in TYPED_EDGES.items()}

# Jobs, reviews, cases, provenance and investigation.
OPERATIONAL_TAGS = {
    "background_job": "job_type string!, status string!, payload_json string!, result_json string, error string, progress int!=0, attempt int!=0, max_attempts int!=3, lease_owner string, lease_expires_at datetime, created_at datetime!, started_at datetime, completed_at datetime, updated_at datetime!",
    "audit_event": "event_type string!, actor_id string!, payload_json string!, occurred_at datetime!",
    "review_item": "queue_type string!, status string!, entity_type string!, proposed_action string!, payload_json string!, confidence double!, created_at datetime!, reviewed_at datetime, reviewed_by string, decision_reason string",
    "investigation_case": "title string!, status string!, priority string!, created_by string!, created_at datetime!, updated_at datetime!",
    "case_note": "body string!, author_id string!, created_at datetime!, updated_at datetime!",
    "saved_graph_view": "name string!, state_json string!, created_by string!, created_at datetime!, updated_at datetime!",
    "search_term": "value string!, normalized_value string!, term_type string!, phonetic_key string, created_at datetime!",
    "platform_setting": "key string!, value_json string!, updated_at datetime!",
    "evidence_snippet": "evidence_id string!, source_type string!, source_name string!, source_uri string, snippet_text string, confidence double!, created_at datetime!",
    "source_record": "source_id string!, source_name string!, source_type string!, source_uri string, ingested_at datetime!, checksum string, record_count int",
    "import_batch": "batch_id string!, source_name string!, file_name string!, status string!, row_count int!, created_count int!, merged_count int!, error_count int!, started_at datetime!, completed_at datetime, created_at datetime!",
    "investigation_task": "title string!, description string, status string!, priority string!, assigned_to string, created_at datetime!, updated_at datetime!",
    "alert": "title string!, severity string!, status string!, rule_id string, description string, triggered_at datetime!, resolved_at datetime, created_at datetime!",
    "report": "title string!, format string!, status string!, content_json string, generated_by string!, generated_at datetime!, created_at datetime!",
}
_MADE = "created_at datetime!"
OPERATIONAL_EDGES = dict.fromkeys(("PRODUCED", "RECORDED_FOR", "HAS_NOTE", "HAS_SAVED_VIEW", "GENERATED_REVIEW", "PERFORMED_BY", "PROCESSES", "INGESTED_IN", "GENERATED_REPORT"), _MADE) | {
    "HAS_SUBJECT": "subject_role string!, added_at datetime!, added_by string!",
    "CANDIDATE_MATCH": "score double!, reasons_json string!",
    "PROPOSES_MERGE": "confidence double!, created_at datetime!",
    "RESOLVES_TO": "weight double!, source string!, confidence double!",
    "SUPPORTED_BY": "confidence double!, claim string, created_at datetime!",
    "EXTRACTED_FROM": "position_start int, position_end int, created_at datetime!",
    "MENTIONS": "confidence double!, context string, created_at datetime!",
    "HAS_TASK": "created_at datetime!, assigned_by string",
    "TRIGGERED_ALERT": "created_at datetime!, confidence double",
    "LINKS_TO": "link_type string!, description string, confidence double, created_at datetime!",
}


def tag_schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField("vid", T.StringType(), False), *struct(columns)])


def edge_schema(columns: str) -> T.StructType:
    ends = [T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False), T.StructField("rank", T.LongType(), False)]
    return T.StructType([*ends, *struct(columns)])
