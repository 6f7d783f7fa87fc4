"""Weights, priors and word lists of retrieval."""

# Fusion.
RRF_K = 60
ROUTE_WEIGHTS = {"structured": 1.0, "semantic": 0.8, "glossary_expansion": 0.5}
BOOSTS = {
    "exact_document_number": 0.5,
    "recent_amendment": 0.2,
    "local_normative_penalty": -0.2,
}
RECENT_DAYS = 365

# Rerank weights and priors. The prior table names the levels that exist.
RERANK_WEIGHTS = {
    "relevance": 0.45,
    "intent": 0.20,
    "multi_route": 0.13,
    "hierarchy": 0.12,
    "level": 0.05,
    "effect": 0.05,
}
RANK_DECAY = 0.35
HIERARCHY_PRIOR = {
    "law": 1.00,
    "administrative_regulation": 0.90,
    "departmental_rule": 0.80,
    "normative_document": 0.75,
    "local_normative": 0.50,
    "normative_reply": 0.30,
}
DEFAULT_PRIOR = 0.60
LEVEL_VALUE = {"article": 1.0, "paragraph": 0.6, "item": 0.4}
DEFAULT_LEVEL = 0.5
EFFECT_VALUE = {"effective": 1.0, "partially_repealed": 0.5}

# Retrieval intents, words in order of weight, and the content hints.
INTENT_WORDS = {
    "procedure": ("流程", "怎么办", "如何办理", "申报", "材料", "手续", "步骤"),
    "liability": ("处罚", "罚款", "滞纳金", "风险", "责任", "后果"),
    "calculation": ("税率", "计算", "税额", "多少钱", "怎么算", "计税", "减免"),
    "scope": ("哪些", "范围", "适用", "对象", "条件"),
}
INTENT_HINTS = {
    "procedure": ("申报", "办理", "报送", "材料", "流程", "期限"),
    "liability": ("处罚", "罚款", "滞纳金", "责令", "没收"),
    "calculation": ("税率", "税额", "计税", "应纳税额", "扣除", "税率表"),
    "scope": ("适用", "范围", "对象", "以下", "不包括"),
}

# Depth of the routes and of the answer.
ROUTE_DEPTH = 30
STRUCTURED_DEPTH = 10
ANSWER_DEPTH = 10

# Tokens and vector spaces.
TOKEN_PATTERN = r"[一-鿿]|[A-Za-z]+|[0-9]+(?:[.\-][0-9]+)*"
SPARSE_SPACE = 1_048_576
DENSE_DIM = 1024
