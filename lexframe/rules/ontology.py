"""Enumerations of the regulation data model."""

# Hierarchy levels from strongest to weakest.
HIERARCHY_LEVELS = (
    "law",
    "administrative_regulation",
    "departmental_rule",
    "normative_document",
    "local_normative",
    "normative_reply",
)

# Effect statuses.
EFFECT_STATUSES = (
    "not_yet_effective",
    "effective",
    "partially_repealed",
    "repealed",
    "superseded",
    "draft",
)
CITABLE_STATUSES = ("effective", "partially_repealed")

# Text units and those that can be cited.
GRANULARITY_LEVELS = ("chapter", "section", "article", "paragraph", "item", "subitem")
CITABLE_LEVELS = ("article", "paragraph", "item")

# Edge types, scopes, review states.
RELATION_TYPES = (
    "based_on",
    "amends",
    "amended_by",
    "repeals",
    "repealed_by",
    "references",
    "referenced_by",
    "excepts",
    "excepted_by",
)
REGION_SCOPES = ("national", "provincial", "municipal", "district")
REVIEW_STATES = ("pending_review", "published", "rejected")

# Official validity wording and the status it stands for.
OFFICIAL_STATUS = {
    "全文有效": "effective",
    "部分失效": "partially_repealed",
    "已修改": "superseded",
    "全文废止": "repealed",
    "全文失效": "repealed",
    "尚未生效": "not_yet_effective",
}

# Levels whose documents may be named by title when they carry no number.
NAME_IDENTIFIED_LEVELS = ("law", "administrative_regulation")
