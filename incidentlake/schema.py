"""Declared schemas of the tables the jobs read and write."""

from __future__ import annotations

INCIDENTS = (
    "incident_id bigint, organization_code string, industry string, host_count int, threat_code int, "
    "success int, region string, incident_date timestamp_ntz, regional_time timestamp_ntz"
)
REGISTRY = (
    "threat_code int, name string, description string, source_characteristics string, "
    "object_of_impact string, confidentiality_breach int, integrity_breach int, availability_breach int, "
    "date_added timestamp_ntz, last_modified timestamp_ntz, status string, notes string"
)
ORGANIZATIONS = "id bigint, name string, code string"
SETTINGS = "organization_id bigint, region string, industry string, host_count int, technologies array<string>"
VULNERABILITIES = (
    "asset_id string, asset_name string, asset_type string, vulnerability_code string, "
    "title string, severity string, description string"
)
RULES = (
    "rule_ord int, tokens array<string>, threat_id string, match_score double, reason string, "
    "recommendation_method string"
)
CATALOG = (
    "threat_id string, name string, description string, category string, severity string, "
    "likely_targets array<string>, common_methods array<string>, source string"
)
RECOMMENDATIONS = "method string, pos int, code string, title string, description string, priority int"

_recommendation = "struct<code:string,title:string,description:string,priority:int>"
SCORING_JSON = (
    "vulnerability_count_weight double, attack_intensity_weight double, asset_criticality_weight double, "
    "risk_score_normalizer double, confidence_base double, confidence_multiplier double, "
    "asset_criticality_by_target map<string,double>"
)
RULES_JSON = (
    "tokens array<string>, threat_id string, match_score double, reason string, recommendation_method string"
)
CATALOG_JSON = (
    "threats array<struct<threat_id:string,name:string,description:string,category:string,severity:string,"
    "likely_targets:array<string>,common_methods:array<string>,source:string>>, "
    f"recommendations map<string,array<{_recommendation}>>"
)
