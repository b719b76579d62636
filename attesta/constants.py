"""Fixed values of the domain: enums, thresholds and policy tables."""

# Enumerations, in their meaningful order.
CONFIDENCE_LEVELS = ["low", "medium", "high"]
ENTITY_TYPES = [
    "campus", "academic_unit", "program", "program_offering", "office", "official",
    "announcement", "document", "scholarship", "fee_estimate", "procedure",
]
INGEST_METHODS = ["crawl", "manual", "partner_feed", "seed"]
SOURCE_STATUSES = ["active", "unavailable", "suspended", "blocked", "retired"]
UNIT_TYPES = ["college", "department", "institute", "center", "program_group"]
DEGREE_LEVELS = [
    "certificate", "diploma", "associate", "baccalaureate", "masters", "doctorate",
    "post_baccalaureate",
]
OFFERING_STATUSES = ["active", "suspended", "phased_out", "unknown", "removed"]
UNIT_STATUSES = ["active", "unknown", "removed"]

# Confidence policy.
BASE_BY_METHOD = {"crawl": "high", "manual": "high", "partner_feed": "high", "seed": "medium"}
CAP_BY_ENTITY = {
    "office": "medium", "official": "medium", "document": "medium", "procedure": "medium",
    "scholarship": "low", "fee_estimate": "low",
}
DECAY_TO_MEDIUM = {
    "announcement": 7, "official": 30, "office": 60, "procedure": 60, "program_offering": 90,
    "academic_unit": 120, "program": 180, "document": 180, "campus": 365,
}
DECAY_TO_LOW = {
    "announcement": 30, "official": 120, "office": 180, "procedure": 180,
    "program_offering": 270, "academic_unit": 365, "program": 365, "document": 365,
}
OLD_EDITION_DAYS = 3 * 365
UNREACHABLE_LOW_DAYS = 30
PCT_HIGH_EXCLUDED = ["scholarship", "fee_estimate"]

# Recrawl cadence in hours.
RECRAWL_HOURS = {
    "announcement": 6, "official": 7 * 24, "office": 7 * 24, "procedure": 7 * 24,
    "program_offering": 7 * 24, "academic_unit": 7 * 24, "program": 365 * 24,
    "document": 30 * 24, "scholarship": 30 * 24, "fee_estimate": 30 * 24, "campus": 30 * 24,
}
DEFAULT_RECRAWL_HOURS = 7 * 24
MANUAL_OVERDUE_DAYS = 120

# Thresholds.
TRIGRAM_THRESHOLD = 0.85
SUGGEST_THRESHOLD = 0.2
SUGGEST_LIMIT = 3
GUARD_DROP = 0.7
GUARD_DOUBLE = 2
GUARD_FLOOR = 10
MISSES_TO_REMOVE = 3
PAGE_BUDGET = 500
PAGE_SIZE = 20
STALE_AFTER_HOURS = 36
RETENTION_MONTHS = 12
RRF_K = 60
ARM_DEPTH = 50
SPLIT_TOKENS = 800
MERGE_TOKENS = 100
BM25_K1 = 1.2
BM25_B = 0.75
LIVE_MIN_BYTES = 5120
PUBLISH_ORDER = ["academic_unit", "program_offering"]
