"""The rule tables that come with the library, for questions about banking regulation. All are fixed values."""

from __future__ import annotations

# Intents as (intent, pattern, confidence), the earlier one first among equals; case does not matter.
INTENTS = (
    ("greeting", r"^(你好|您好|hi|hello|hey|在吗|在不在|谢谢|感谢)\s*[！!？?。.]*$", 0.95),
    ("clause_query", r"第[一二三四五六七八九十百千\d]+条", 0.90),
    ("clause_query", r"《[^》]+》第[一二三四五六七八九十百千\d]+条", 0.95),
    ("clause_query", r"文号.*?号|〔\d{4}〕\d+号|银发\[\d{4}]\d+号", 0.85),
    ("clause_query", r"条款|条文|第[一二三四五六七八九十百千\d]+章", 0.80),
    ("table_lookup", r"附件\d+|附表\d+", 0.85),
    ("table_lookup", r"表\s*\d+", 0.80),
    ("table_lookup", r"(指标|数值|数据|取值).*(?:多少|是什么|查询)", 0.70),
    ("threshold", r"(?:最低|最高|不少于|不超过|至少|至多|不低于|不高于)", 0.85),
    ("threshold", r"(?:比例|比率|要求).*(?:多少|是什么|几)", 0.75),
    ("threshold", r"(?:充足率|资本要求|杠杆率|拨备率|覆盖率).*(?:多少|要求|标准)", 0.80),
    ("definition", r"(?:什么是|什么叫|什么意思|是指|定义|含义|概念)", 0.85),
    ("definition", r"(?:解释|说明).*(?:是什么|含义)", 0.70),
    ("comparison", r"(?:比较|对比|区别|差异|不同|vs|versus|VS)", 0.80),
    ("comparison", r"(?:哪个.*(?:高|低|大|小|严|松)|哪个.*好)", 0.75),
    ("compliance", r"(?:是否(?:符合|满足|合规|达标|违反)|合规性|是否可以)", 0.85),
    ("compliance", r"(?:能不能|可不可以|允许.*?吗)", 0.70),
    ("overview", r"(?:概述|概览|简介|包括哪些|包含哪些|有哪些|主要内容)", 0.75),
    ("overview", r"(?:介绍|说明).*(?:内容|规定|要求)", 0.65),
)

# Entities as (kind, pattern, group that is the value, confidence).
PATTERNS = (
    ("doc_name", r"《([^》]+)》", 1, 0.95),
    ("clause_number", r"第([一二三四五六七八九十百千零\d]+)条", 1, 0.90),
    ("chapter_number", r"第([一二三四五六七八九十百千零\d]+)章", 1, 0.85),
    ("attachment_no", r"附[件表]([一二三四五六七八九十\d]+)", 1, 0.85),
    ("table_name", r"表([一二三四五六七八九十\d]+(?:\.\d+)?)", 0, 0.80),
    ("date", r"(\d{4}年(?:\d{1,2}月?|Q[1-4]|第[一二三四]季度))", 1, 0.85),
    ("percentage", r"(\d+(?:\.\d+)?%)", 1, 0.90),
    ("amount", r"(\d+(?:\.\d+)?(?:万亿|亿|万|千)元)", 1, 0.85),
)
# Names as (kind, confidence, names), and terms, cut to 30 characters at most, as (pattern, confidence).
GAZETTEERS = (
    ("organization", 0.85, ("银保监会", "金融监督管理总局", "国家金融监督管理总局", "人民银行", "中国人民银行", "央行", "国务院", "财政部", "证监会", "保监会")),
    (
        "metric_name",
        0.85,
        (
            "资本充足率", "核心一级资本充足率", "一级资本充足率", "杠杆率", "拨备覆盖率", "拨贷比", "不良贷款率", "流动性覆盖率", "流动性比例", "净稳定资金比例",
            "存贷比", "资产利润率", "资本利润率", "核心一级资本", "一级资本", "总资本", "风险加权资产", "储备资本", "逆周期资本", "附加资本",
            "系统重要性银行附加资本", "总资产", "总负债",
        ),
    ),
    (
        "scope",
        0.80,
        (
            "系统重要性银行", "非系统重要性银行", "国内系统重要性银行", "全球系统重要性银行", "大型商业银行", "中型银行", "小型银行", "城市商业银行",
            "农村商业银行", "民营银行", "外资银行", "政策性银行", "开发性金融机构", "全部", "所有银行",
        ),
    ),
)
TERMS = ((r"什么是(.+?)[？?。.\n]", 0.80), (r"(.+?)是指", 0.75))
LONGEST_TERM = 30

# Constraints. Times as patterns, the others as words with their meaning; the first that matches counts, of states all do.
TIMES = (r"(\d{4}年(?:\d{1,2}月?|Q[1-4]|第[一二三四]季度))", r"(\d{4}-\d{2})", r"((?:今年|去年|前年|上半年|下半年))")
STATES = (
    ("现行有效", "active"), ("现行", "active"), ("有效", "active"), ("最新", "active"), ("已废止", "repealed"), ("废止", "repealed"), ("已失效", "expired"),
    ("失效", "expired"), ("已修订", "superseded"), ("修订", "superseded"), ("草案", "draft"), ("征求意见稿", "draft"),
)
SCOPES = (*((s, s) for s in GAZETTEERS[2][2] if s not in ("开发性金融机构", "所有银行")), ("所有银行", "全部"))
NORMS = (
    ("不得", "prohibitive"), ("禁止", "prohibitive"), ("严禁", "prohibitive"), ("应当", "obligatory"), ("必须", "obligatory"), ("应", "obligatory"),
    ("须", "obligatory"), ("可以", "permissive"), ("可", "permissive"), ("宜", "advisory"), ("建议", "advisory"), ("鼓励", "advisory"), ("是指", "definitional"),
    ("定义为", "definitional"),
)
