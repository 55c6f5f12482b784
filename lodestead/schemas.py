"""Tables of the engine and the values their coded columns may take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIDENCE = "decimal(3,2)"
_NAME = "struct<given:string,surnames:array<string>>"

SCHEMAS = {
    "documents": "id bigint, url string, url_hash string, content_hash string, extracted_text string, "
                 "processing_status string, fetch_timestamp timestamp",
    "claims": "id bigint, document_id bigint, memo_id bigint, fact_type string, subject_name string, subject_role string, "
              "fact_value string, related_name string, relationship_type string, extracted_context string, is_inferred boolean, "
              "inference_basis string, confidence_score decimal(3,2), entity_id bigint, registry_person_id string, "
              "resolution_status string, created_timestamp timestamp",
    "entities": "id bigint, canonical_name string, name_variants array<string>, nicknames array<string>, maiden_names array<string>, "
                "registry_person_id string, confidence_score decimal(3,2), source_count int, fact_count int, entity_status string",
    "citations": "id bigint, document_id bigint, entity_id bigint, registry_person_id string, registry_source_id string, "
                 "registry_citation_id string, citation_type string, document_name string, confidence string, "
                 "created_timestamp timestamp, created_by string",
    "memo": "id bigint, document_id bigint, provider string, model string, prompt_hash string, response_text string, parsed_json string, "
            "tokens_prompt int, tokens_completion int, cost_usd decimal(10,6), duration_ms int, api_error string",
    "registry_people": f"registry_id string, handle string, gender int, primary_name {_NAME}, alternate_names array<{_NAME}>, "
                       "event_refs array<string>, citation_list array<string>",
    "registry_events": "handle string, type string, dateval array<int>, place string",
    "registry_families": "registry_id string, handle string, parents array<string>, children array<string>",
    "registry_sources": "registry_id string, handle string, attributes array<struct<type:string,value:string>>",
    "outbox": "key string, step int, kind string, url string, title string, document_id bigint, registry_person_id string, confidence int, created_timestamp timestamp",
    "mentions": "document_id bigint, full_name string, role string",
    "settings": "setting_key string, setting_value string, setting_type string, description string",
}

# The domains of coded columns.
DOMAINS = {
    "fact_type": ["person_name", "person_nickname", "person_death_date", "person_death_age", "person_birth_date", "person_gender",
                  "maiden_name", "relationship", "marriage", "marriage_duration", "location_birth", "location_death",
                  "location_residence", "survived_by", "preceded_in_death"],
    "resolution_status": ["unresolved", "clustered", "resolved", "conflicting", "rejected"],
    "entity_status": ["unverified", "verified", "conflicting", "resolved"],
    "processing_status": ["pending", "processing", "completed", "failed"],
    "setting_type": ["string", "integer", "float", "boolean", "json"],
    "citation_confidence": ["low", "medium", "high", "very_high"],
}
#: Default settings: key, value, type.
SETTINGS = [
    ("confidence_threshold_auto_store", "0.85", "float"),
    ("confidence_threshold_review", "0.60", "float"),
    ("llm_default_provider", "openai", "string"),
    ("llm_default_model", "gpt-4-turbo-preview", "string"),
    ("fuzzy_match_threshold", "0.85", "float"),
    ("cache_expiry_days", "365", "integer"),
]
# End of fixed values.


def in_domain(c: Column, domain: str) -> Column:
    return c.isin(DOMAINS[domain])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
