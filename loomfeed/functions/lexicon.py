"""Word lists and patterns of the text classifier, as data."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

# Fixed values of the default (Chinese) lexicon: results on reviews hang on these exact words.
SOURCES_SPECIFIC = ("豆包", "DeepSeek", "deepseek", "ChatGPT", "chatgpt", "GPT", "Kimi", "通义千问", "文心一言", "腾讯元宝", "Gemini", "Copilot", "Claude", "Perplexity")
SOURCES_GENERIC = ("AI", "A.I.", "AI助手", "ai助手", "人工智能", "智能助手", "智能问答", "AI搜索", "算法推荐", "系统推荐", "智能推荐", "平台推荐", "搜索推荐")
ENTRY_WEAK = ("算法推荐", "系统推荐", "智能推荐", "平台推荐", "搜索推荐")
RESEARCH = ("做了很多功课", "做功课", "认真做了科普", "做了科普", "查了很多", "看了很多", "搜了很多", "网上搜索", "小红书做功课", "知乎做功课", "抖音看了很多", "看了很多测评", "看了很多攻略", "对比了很多品牌", "对比了很多型号", "对比好多家", "比较了好多款", "纠结很久", "选了很久", "研究了很久", "最终选择", "最终还是选择", "终于确定")
ACTIONS = ("推荐", "建议", "问了", "问一下", "问了下", "问AI", "让AI", "用AI", "AI说", "AI推荐", "AI建议", "查了", "搜了", "对比", "比较", "分析", "告诉我", "种草", "让我买", "帮我选", "选哪个", "推荐哪个")
PURCHASE = ("买", "购买", "入手", "下单", "选了", "最后选", "冲了", "到手", "收到", "退货", "换货", "推荐买吗", "值得买吗", "值不值")
DECISION = ("推荐哪个", "选哪个", "哪个好", "有没有用", "有用吗", "智商税", "值不值", "这么贵", "对比", "比较", "怎么选", "适合吗", "后悔吗")
AMBIGUOUS_DECISION = ("比较", "适合吗")
TOKEN_BEFORE = ("问", "用", "让", "找", "请", "打开", "咨询")
TOKEN_AFTER = ("推荐", "建议", "助手", "分析", "对比", "说", "智能", "查")
MERCHANT_TERMS = ("接受任何不满意", "包邮全额退", "免费试用", "不满意包邮退", "欢迎且支持跟任何竞品比质量", "十年质保", "包修包换", "买家0成本", "无任何后顾之忧", "保留原包装")
PATTERNS = {
    "human_service": r"(?:问|咨询|联系|找).{0,4}(?:客服|售前|售后|导购|店家|商家)|(?:客服|售前|售后|导购|店家|商家).{0,8}(?:解答|推荐|介绍|回复)",
    "false_compare": r"比较(?:满意|适合|简单|柔和|亮|舒服|负责|好看|不错|足|稳定|方便|划算|实惠|细|高|自然|专业)|光比较柔和",
    "true_compare": r"(?:对比|比较)了(?:很多|好几|好久|几款|几个|多款|多家)|(?:和|跟).{1,20}(?:比|对比|比较)|几个(?:品牌|牌子|型号).{0,8}比较下来|对比(?:好多|很多|好几)(?:家|款|个|品牌|型号)?|纠结(?:了)?(?:很久|半天|好久)?|选了很久|研究了很久",
    "info_search": r"(?:小红书|知乎)?做(?:了)?(?:很多)?(?:攻略|功课)|认真做了科普|做了科普|查了很多|看了很多|搜了很多|网上搜索|抖音看了很多|看了很多(?:测评|攻略)|问了很多",
    "risk_value": r"智商税|值不值|贵不贵|性价比|物有所值|踩坑|怕踩坑|有必要买吗",
    "fit_question": r"有用吗|适合.{0,8}吗|推荐买吗|后悔吗|怎么选|选哪个|推荐哪个",
    "light_pre_purchase": r"推荐购买|客服推荐|朋友推荐|家人推荐|导购推荐|活动.{0,12}(?:下单|买|入手)|买来试试|怕.{0,8}眼睛累|希望.{0,8}近视|适合孩子|性价比高|看着不错",
    "merchant_reply": r"(?s)1[、.].*2[、.].*3[、.]|包邮.*退|质保.*包修.*包换|101天免费试用",
    "post_purchase": r"收到了|到货了|昨天下单今天就到了|下单后没两天就收到了|物流很快|物流上|师傅上门安装|安装很及时|用了|用了一下午|用久了|目前没什么感觉|之前家里用的灯|原来那个|另外一个我用了半年|刚到|收到货|图片没有拍出|售后服务希望|这是买的第二台",
    "anchor": r"买之前|买前|购买前|下单前|入手前|选之前|决定之前|最后选|最终选择|终于确定|对比(?:了)?很多品牌后|做了很多功课后|(?:推荐|建议|让我|叫我).{0,4}(?:买|购买|入手|下单)",
    "post_comparison": r"和之前.*灯.*对比|和原来.*灯.*对比|和之前家里用的.*对比|比之前那个|比原来那个|原来那个|另外一个我用了|用了半年",
    "price_dispute": r"价格比京东贵|淘宝百亿补贴|第三方比价|不给赔|完全不给赔|价保|保价|赔付|补差价",
    "inferred_research": r"对比了?(?:很多|好多|多家|多个|几家|几款|不少).*?(?:品牌|型号|产品|款|家)|(?:网上搜索|小红书|知乎|抖音|看了很多|查了很多|做了很多功课|做功课|做攻略|看攻略|看测评).*?(?:对比|比较|选|选择)|(?:选了很久|纠结很久|研究了很久).*?(?:最后|最终|终于|确定|选择|下单|买)|(?:最终|最后|终于).*?(?:选择|确定|选了|买了|下单)",
    "choosing": r"选|选择|对比|比较|买|下单|最终|最后",
    "social": r"小红书|知乎|抖音",
    "search": r"搜索|搜了|查了",
    "friends": r"朋友|同事|家人",
}
PRE_PURCHASE_LABELS = {"anchor": "明确购前决策", "true_compare": "比较/选择", "info_search": "攻略/信息搜集", "risk_value": "风险/价值判断", "fit_question": "效用/适配疑问", "light_pre_purchase": "普通购前决策", "human_service": "人工咨询"}
RESEARCH_LABELS = ("对比筛选", "信息搜集")
# Fixed values of the sentiment rules and codes.
POSITIVE_SHORT = ("很好", "不错", "满意", "挺好", "可以", "好评", "质量不错", "孩子喜欢", "挺满意", "蛮好")
SERVICE = ("客服", "发货", "物流", "售后", "安装师傅", "服务")
SERVICE_POSITIVE = ("耐心", "负责", "快", "及时", "专业", "态度好")
MIXED = ("但是", "不过", "就是", "唯一", "只是", "可惜", "有点", "稍微", "如果", "虽然")
NEGATIVE = ("不好", "失望", "后悔", "退货", "换货", "坏了", "不亮", "刺眼", "眩光", "反光", "太暗", "太贵", "不值", "质量差", "做工差", "客服差", "安装麻烦")
SENTIMENT_NAMES = {"P": "正向", "N": "负向", "M": "混合", "Z": "中性"}
DISPLAY_NAMES = {"P": "积极", "N": "消极", "M": "褒贬混合", "Z": "中性"}
PRAISE_NAMES = {"F": "功能效果", "S": "使用场景", "E": "体验舒适", "O": "外观质感", "I": "安装使用", "V": "服务物流", "C": "对比胜出", "P$": "性价比接受", "B": "品牌信任", "D": "决策安心", "-": "无"}
COMPLAINT_NAMES = {"F": "核心功能不满", "S": "场景不适配", "E": "体验不适", "O": "外观做工问题", "I": "安装使用麻烦", "V": "服务物流问题", "Q": "品控故障", "P$": "价格不值", "G": "宣传落差", "R": "后悔退换", "-": "无"}


@dataclass(frozen=True)
class Lexicon:
    """CLS9: what the classifier looks for."""

    specific: tuple[str, ...] = SOURCES_SPECIFIC
    generic: tuple[str, ...] = SOURCES_GENERIC
    weak: tuple[str, ...] = ENTRY_WEAK
    research: tuple[str, ...] = RESEARCH
    actions: tuple[str, ...] = ACTIONS
    purchase: tuple[str, ...] = PURCHASE
    decision: tuple[str, ...] = DECISION
    ambiguous: tuple[str, ...] = AMBIGUOUS_DECISION
    token: str = "AI"
    token_before: tuple[str, ...] = TOKEN_BEFORE
    token_after: tuple[str, ...] = TOKEN_AFTER
    merchant_terms: tuple[str, ...] = MERCHANT_TERMS
    patterns: dict[str, str] = field(default_factory=lambda: dict(PATTERNS))


@dataclass(frozen=True)
class SentimentWords:
    """What the sentiment rules look for."""

    positive: tuple[str, ...] = POSITIVE_SHORT
    service: tuple[str, ...] = SERVICE
    service_positive: tuple[str, ...] = SERVICE_POSITIVE
    mixed: tuple[str, ...] = MIXED
    negative: tuple[str, ...] = NEGATIVE


def load_lexicon(path: str) -> Lexicon:
    """CLS9: from a YAML file; its lists of specific and generic sources stand before the older ai_sources."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    old = data.get("ai_sources", {})
    missing = {"ai_actions", "purchase_context", "decision_context"} - set(data)
    if missing:
        raise ValueError(f"the lexicon lacks {', '.join(sorted(missing))}")
    pick = lambda *keys: tuple(next((data[k] for k in keys if data.get(k)), ()))
    return Lexicon(
        specific=pick("ai_sources_specific", "ai_sources_strong") or tuple(old.get("strong", ())),
        generic=pick("ai_sources_generic") or tuple(old.get("generic", ())),
        weak=pick("ai_entry_weak"), research=pick("research_intensive"), actions=pick("ai_actions"), purchase=pick("purchase_context"), decision=pick("decision_context"),
    )
