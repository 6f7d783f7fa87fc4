"""Tax rule tables and their validation."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

# Citations.
VAT_GENERAL_CITATION = "中华人民共和国增值税法 第十四条"
VAT_NET_CITATION = "中华人民共和国增值税法 第十六条"
VAT_LEVY_CITATION = "中华人民共和国增值税法 第十一条"

# VAT rates with the words of the business they apply to, in order.
VAT_RATES = (
    {
        "rate": "0.13",
        "name": "销售货物、加工修理修配服务、有形动产租赁服务、进口货物",
        "citation": "中华人民共和国增值税法 第十条（一）",
        "keywords": ("货物", "销售货物", "加工修理修配", "有形动产租赁", "进口"),
    },
    {
        "rate": "0.09",
        "name": "交通运输、邮政、基础电信、建筑、不动产租赁、销售不动产、转让土地使用权及列举货物",
        "citation": "中华人民共和国增值税法 第十条（二）",
        "keywords": (
            "交通运输", "邮政", "基础电信", "建筑", "不动产租赁", "销售不动产", "土地使用权",
            "农产品", "图书", "饲料", "化肥", "农药", "农机", "自来水", "天然气",
        ),
    },
    {
        "rate": "0.06",
        "name": "销售服务、无形资产（除另有规定外）",
        "citation": "中华人民共和国增值税法 第十条（三）",
        "keywords": ("服务", "无形资产", "现代服务", "生活服务", "金融", "咨询", "技术服务"),
    },
    {
        "rate": "0",
        "name": "出口货物、跨境销售国务院规定范围内的服务和无形资产",
        "citation": "中华人民共和国增值税法 第十条（四）（五）",
        "keywords": ("出口货物", "跨境销售", "出口", "跨境", "零税率"),
    },
)
VAT_LEVY_RATE = "0.03"

# Corporate income tax.
CIT_RATE = "0.25"
CIT_CITATION = "中华人民共和国企业所得税法 第四条"
CIT_SMALL = {
    "code": "small_low_profit",
    "name": "小型微利企业优惠",
    "include_ratio": "0.25",
    "rate": "0.20",
    "citation": "财政部 税务总局公告2023年第12号",
    "period": ("2023-01-01", "2027-12-31"),
}

# Surcharges on VAT and consumption tax.
SURCHARGES = (
    {
        "code": "urban_maintenance",
        "name": "城市维护建设税",
        "citation": "中华人民共和国城市维护建设税法 第四条",
        "rates": (
            ("0.07", "纳税人所在地在市区"),
            ("0.05", "纳税人所在地在县城、镇"),
            ("0.01", "纳税人所在地不在市区、县城或者镇"),
        ),
    },
    {
        "code": "education_surcharge",
        "name": "教育费附加",
        "citation": "征收教育费附加的暂行规定 第三条",
        "rates": (("0.03", ""),),
    },
    {
        "code": "local_education_surcharge",
        "name": "地方教育附加",
        "citation": "财政部关于统一地方教育附加政策有关问题的通知（财综〔2010〕98号）",
        "rates": (("0.02", ""),),
    },
)

# Discounts; the period is closed on both ends.
DISCOUNTS = (
    {
        "code": "small_business_half_surcharges",
        "name": "增值税小规模纳税人、小型微利企业和个体工商户减半征收“六税两费”",
        "taxes": ("urban_maintenance", "education_surcharge", "local_education_surcharge"),
        "taxpayers": ("小规模纳税人", "小型微利企业", "个体工商户"),
        "factor": "0.5",
        "period": ("2023-01-01", "2027-12-31"),
        "citation": "财政部 税务总局公告2023年第12号",
    },
    {
        "code": "small_scale_vat_exemption",
        "name": "小规模纳税人月销售额未超过10万元免征增值税",
        "taxes": ("vat",),
        "taxpayers": ("小规模纳税人",),
        "month_limit": "100000",
        "quarter_limit": "300000",
        "period": ("2023-01-01", "2027-12-31"),
        "citation": "财政部 税务总局公告2023年第19号 一、",
    },
    {
        "code": "small_scale_levy_rate_reduction",
        "name": "小规模纳税人适用3%征收率的应税销售收入减按1%征收率征收增值税",
        "taxes": ("vat",),
        "taxpayers": ("小规模纳税人",),
        "to_rate": "0.01",
        "period": ("2023-01-01", "2027-12-31"),
        "citation": "财政部 税务总局公告2023年第19号 二、",
    },
)

# Notes on results, as code and our own wording.
NOTES = {
    "method_unknown": "纳税人身份未确认，计税方法无法确定",
    "sales_missing": "缺少销售额或销项税额",
    "rate_unknown": "业务类型对不上任何税率，请补充业务或税率",
    "input_missing": "未提供进项税额，按 0 计算",
    "carry_forward": "销项小于进项，差额留待下期抵扣",
    "year_scope": "免税额按月或按季判断，全年数据不能判断",
    "scope_conflict": "按月与按季的结论不同，请说明申报周期",
    "basis_conflict": "两种换算口径的结论不同，请向主管税务机关确认",
    "income_missing": "缺少应纳税所得额",
    "no_income": "应纳税所得额不为正，不产生税额",
    "no_base": "计税依据为零，无需计算",
    "location_unknown": "所在地未确认，城建税暂按最低档",
}


class RuleError(ValueError):
    """A rule table that must not be used."""


def rule_rate(value: object, where: str) -> Decimal:
    """A rate of a rule table: ``0.13`` or ``13%``. A bare 13 is ambiguous and rejected."""
    text = str(value if value is not None else "").strip()
    try:
        number = Decimal(text[:-1]) / 100 if text.endswith("%") else Decimal(text)
    except InvalidOperation:
        raise RuleError(f"{where}: not a rate: {value!r}") from None
    if not 0 <= number <= 1:
        raise RuleError(f"{where}: ambiguous or out of range: {value!r}")
    return number


def validate(rates=VAT_RATES, surcharges=SURCHARGES, discounts=DISCOUNTS) -> None:
    """Every rate in range, every rate and discount cited, every period with two ends."""
    for entry in rates:
        rule_rate(entry.get("rate"), "rates")
        if not entry.get("citation"):
            raise RuleError(f"rate without citation: {entry}")
    for item in surcharges:
        if not (item.get("code") and item.get("name") and item.get("citation")):
            raise RuleError(f"incomplete surcharge: {item}")
        if not item.get("rates"):
            raise RuleError(f"surcharge without rate: {item}")
        for value, _ in item["rates"]:
            rule_rate(value, item["code"])
    for item in discounts:
        if not item.get("citation"):
            raise RuleError(f"discount without citation: {item}")
        if len(item.get("period") or ()) != 2:
            raise RuleError(f"discount period needs two ends: {item}")


validate()
