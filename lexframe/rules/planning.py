"""Techniques, risk levels and profile rules of planning."""

# Allowed values of a profile.
ENUMS = {
    "entity_type": ("有限公司", "股份有限公司", "合伙企业", "个体工商户", "个人独资企业"),
    "taxpayer_type": ("一般纳税人", "小规模纳税人"),
    "risk_preference": ("保守", "稳健", "进取"),
    "goal": ("降低税负", "递延纳税", "合规整改", "特定事项"),
}
NON_NEGATIVE = ("employees", "revenue", "cost", "profit", "total_assets", "taxable_income")
REQUIRED = ("entity_type", "taxpayer_type", "goal", "risk_preference", "flexible", "business_authentic")
MONEY_FIELDS = (
    "annual_revenue", "revenue", "cost", "profit", "total_assets", "taxable_income", "historical_loss",
)

# Techniques with their conditions as (field, op, value).
TECHNIQUES = (
    {"code": "vat_small_scale_threshold", "category": "政策适用型", "risk_level": "green", "cost": "低", "measure": "exempt",
     "conditions": (("taxpayer_type", "=", "小规模纳税人"), ("annual_revenue", "<=", 1200000)),
     "citations": ("财政部 税务总局公告2023年第19号", "中华人民共和国增值税法 第二十三条")},
    {"code": "cit_small_low_profit", "category": "政策适用型", "risk_level": "green", "cost": "低", "measure": "small_low_profit",
     "conditions": (("entity_type", "in", ("有限公司", "股份有限公司", "合伙企业", "个人独资企业")),
                    ("taxable_income", "<=", 3000000), ("employees", "<=", 300), ("total_assets", "<=", 50000000)),
     "citations": ("中华人民共和国企业所得税法 第二十八条", "财政部 税务总局公告2023年第12号")},
    {"code": "rd_super_deduction", "category": "政策适用型", "risk_level": "green", "cost": "中", "measure": "rd_super_deduction",
     "conditions": (("industry", "exists", True), ("taxable_income", ">", 0)),
     "citations": ("财政部 税务总局公告2023年第7号", "中华人民共和国企业所得税法实施条例 第九十五条")},
    {"code": "surcharge_half_small_business", "category": "政策适用型", "risk_level": "green", "cost": "低", "measure": "halve",
     "conditions": (("taxpayer_type", "in", ("小规模纳税人",)),),
     "citations": ("财政部 税务总局公告2023年第12号",)},
    {"code": "entity_form_selection", "category": "主体架构型", "risk_level": "yellow", "cost": "高", "measure": None,
     "conditions": (("flexible", "truthy", "can_change_entity"),),
     "citations": ("中华人民共和国企业所得税法 第一条", "中华人民共和国个人所得税法 第二条")},
    {"code": "revenue_timing", "category": "时点安排型", "risk_level": "yellow", "cost": "低", "measure": None,
     "conditions": (("flexible", "truthy", "can_change_timing"),),
     "citations": ("中华人民共和国企业所得税法实施条例 第九条",)},
    {"code": "equipment_one_off_deduction", "category": "资产与投资型", "risk_level": "green", "cost": "低", "measure": "equipment_one_off",
     "conditions": (("industry", "exists", True),),
     "citations": ("财政部 税务总局关于中小微企业设备器具所得税税前扣除有关政策的公告",)},
    {"code": "regional_preference", "category": "区域型", "risk_level": "red", "cost": "高", "measure": None,
     "conditions": (("region", "in", ("自贸区", "保税区", "西部大开发地区", "特定园区", "海南自由贸易港")),),
     "citations": ("中华人民共和国企业所得税法 第二十九条",)},
)
TECHNIQUE_FIELDS = ("code", "category", "risk_level", "conditions", "citations", "cost")

# Path of a category, order of costs, action per risk level.
PATHS = {
    "政策适用型": "A", "主体架构型": "B", "业务模式型": "B", "资产与投资型": "B", "区域型": "B",
    "时点安排型": "C", "递延型": "C",
}
COSTS = {"低": 1, "中": 2, "高": 3}
RISK_ACTIONS = {"green": "output", "yellow": "output_with_prompt", "red": "review_only"}
PROMPT = "建议与主管税务机关沟通确认"
SLA_HOURS = 24


class TechniqueError(ValueError):
    """A technique that must not be used."""


def validate(techniques=TECHNIQUES) -> None:
    for t in techniques:
        for name in TECHNIQUE_FIELDS:
            if name not in t:
                raise TechniqueError(f"{t.get('code')}: {name} is missing")
        if t["risk_level"] not in RISK_ACTIONS:
            raise TechniqueError(f"{t['code']}: unknown risk level {t['risk_level']!r}")


validate()
