"""Patterns, word lists and tables that results depend on, stated as data."""

# Fixed: personal data, in the order of redaction: name, pattern, replacement
PII = [
    ("phone", r"(?<!\d)1[3-9]\d{9}(?!\d)", "[PHONE]"),
    ("id", r"(?<!\d)\d{17}[\dXx](?!\d)", "[ID]"),
    ("email", r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", "[EMAIL]"),
    ("ip", r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)", "[IP]"),
]
CARD = r"(?<!\d)\d{13,19}(?!\d)"
CARD_TEXT = "[BANKCARD]"

# Fixed: low information
SUBSTANTIVE = r"[A-Za-z0-9一-鿿]"
BOILERPLATE_LINES = [r"^\s*(click\s+here|点击(这里|此处))\s*$", r"^\s*(next\s+page|previous\s+page|上一页|下一页)\s*$", r"^\s*(table of contents|目录)\s*$"]
BOILERPLATE_PHRASES = [r"\ball\s+rights\s+reserved\b", r"版权所有", r"\bcookie\s*(policy|settings|consent)\b"]

# Fixed: secrets in output
LEAKS = [r"(sk|pk)-[A-Za-z0-9_-]{16,}", r"(?i)api[_-]?key\s*[:=]\s*['\"]?[A-Za-z0-9_-]{16,}", r"BEGIN\s+(?:RSA\s+|DSA\s+|EC\s+|OPENSSH\s+)?PRIVATE\s+KEY", r"(?i)system\s+prompt:?"]

# Fixed: prompt injection, first match wins; the last has a negative look-ahead
INJECTIONS = [
    r"ignore\s+(all\s+)?(previous|prior)\s+instructions?",
    r"disregard\s+(the\s+)?above",
    r"you\s+are\s+now\s+(a|an|the)\b",
    r"forget\s+(your|all)\s+(role|rules|instructions)",
    r"(print|reveal|show\s+me|output)\s+(your|the)\s+(system\s+)?prompt",
    r"\bDAN\b|\bjailbreak\b",
    r"repeat\s+the\s+words\s+above",
    r"忽略[^\n]{0,10}?(指令|规则|要求)",
    r"(不要|无视)[^\n]{0,10}?(指令|规则|要求)",
    r"(忘记|抛开)(你的|所有)?(身份|角色|规则)",
    r"(展示|打印|输出|告诉我)[^\n]{0,20}?(系统\s*)?(提示\s*词?|prompt)",
    r"(现在|从现在起)你是一个?(?!客服|助手)",
]

CJK = "一-鿿㐀-䶿豈-﫿"
STOPWORDS = "a an and are as at be by for from have i if in into is it of on or that the to was were will with".split()

# Fixed: query intent and source type
RELEASE = r"(?i)(which\s+version|what's\s+new|introduced|release\s+note|breaking|哪个版本|新增|发布|更新|变更|release\s*\d|\bv\s*\d)"
TROUBLE = r"(?i)(error|fail|issue|bug|crash|broken|can'?t|cannot|不能|报错|失败|问题|排错|排查)"
HOWTO = r"(?i)(how\s*(to|do|can)|set\s*up|configure|setup|install|tutorial|guide|step|怎么|如何|怎样|教程|入门|步骤|开始|设置|配置)"
PRIORS = {
    ("howto", "getting_started"): 0.06, ("howto", "doc"): 0.03, ("howto", "release"): -0.04, ("howto", "faq"): 0.01,
    ("release", "release"): 0.06, ("release", "doc"): -0.02, ("release", "getting_started"): -0.03,
    ("trouble", "faq"): 0.05, ("trouble", "issue"): 0.04, ("trouble", "doc"): 0.01,
    ("neutral", "getting_started"): 0.02, ("neutral", "doc"): 0.01,
}

# Fixed: dialogue routing
META = [
    r"(?:我)?刚刚(?:说|讲|提到|翻译|回答|问(?!一?下)|咨询|聊)",
    r"(?:我)?刚才(?:说|讲|提到|翻译|回答|问(?!一?下)|咨询|聊)",
    r"上(?:面|述|一句|一条|一段|一轮)(?:的|是|说)",
    r"上(?:面|述)(?:翻译|内容|说的|提到)",
    r"前(?:面|一(?:句|条|段|轮))(?:说|提到|的|问(?!一?下))",
    r"(?:我)?之前(?:问(?!一?下)|提到|说|讲|回答|咨询|聊|的)",
    r"你刚(?:才|刚)?(?:说|讲|提到|回答|问(?!一?下)|的(?:回答|话|内容|那(?:句|段|条)))",
    r"(?:翻译|总结|解释|重(?:复|说))(?:一下|下)?(?:上面|上述|刚刚|刚才|前面|你说的|你刚(?:才)?|之前)",
    r"^(?:翻译|总结)(?:一下|下)?(?:上面|刚才|刚刚|前面|之前)",
    r"\bwhat (?:did|do) you (?:just )?say\b",
    r"\bwhat was (?:the )?(?:above|previous|last)\b",
    r"\bwhat (?:did )?you (?:just )?(?:translate|answer|mention)\b",
    r"\b(?:summari[sz]e|translate|repeat|explain) (?:the )?(?:above|previous|last|that)\b",
    r"\byour (?:previous|last) (?:answer|reply|response|message)\b",
]
CHITCHAT = [
    r"^你好[啊呀\s!.。？?]*$",
    r"^(?:你好|您好|hi|hey|hello)[，,\s]*(?:你是(?:谁|什么)|请问你是)",
    r"^你是(?:谁|什么|哪个|什么人)",
    r"^你能(?:做|帮我做|帮)(?:什么|啥|哪些)",
    r"^(?:在吗|您在吗|in吗)",
    r"^(?:谢谢|多谢|感谢)(?:你|您)?[\s!.。]*$",
    r"^(?:再见|拜拜|bye)[\s!.。]*$",
    r"^(?:hi|hey|hello|yo)[\s!.,]*$",
    r"^(?:hi|hey|hello)[\s,]+who are you\b",
    r"^who are you\b",
    r"^what can you do\b",
    r"^(?:thanks|thank you|thx|ty)[\s!.]*$",
    r"^(?:bye|goodbye)[\s!.]*$",
]
META_LENGTH = 40

# Fixed: complaints
SEVERITY_HIGH = [
    "12315", "工商局", "消协", "消费者协会", "市场监管", "315", "投诉电话", "黑猫投诉", "微博曝光", "发朋友圈", "上电视", "媒体曝光", "向媒体", "小红书曝",
    "打官司", "起诉", "报警", "法院", "律师函", "法律途径", "马上(?:给我)?(?:退|换|处理)", "必须(?:今天|立即|马上)", "否则(?:我)?(?:投诉|曝光|退货|起诉)",
    "再不(?:处理|解决|回复)", "气死我了", "太垃圾了", "什么破玩意", "傻[逼屄]", "骗子", "垃圾(?:客服|平台)", "滚",
]
SEVERITY_MEDIUM = [
    "不满意", "不满", "失望", "很差", "质量差", "(?:有|太)(?:多)?问题", "(?:破|坏|裂|碎|缺)(?:了|损)", "投诉", "申诉", "抱怨", "差评", "不合适", "跟描述不符", "货不对板", "图文不符",
    "要退(?:货|钱|款)", "想退", "太慢了", "等了", r"(?:几|\d+)天(?:还)?没(?:到|发货|处理)", "客服(?:态度)?(?:差|不好|垃圾|不理人)", "能不能(?:快|处理)一下",
]
TOPICS = [
    ("delivery", "(?:没到|没发货|物流|快递|运输|迟到|延误|未签收)"),
    ("quality", "(?:坏了|碎了|破损|损坏|质量|假货|次品|缺货|缺件|漏发|错发)"),
    ("refund", "(?:退款|退钱|退货|refund|退不了|退不下来)"),
    ("service", "(?:客服(?:态度|不理)|人工|机器人|回复慢|不回复)"),
    ("price", "(?:差价|降价|价保|价格不一|贵|虚假标价)"),
]
SLA_HOURS = {"high": 1, "medium": 4, "low": 24}

# Fixed: utterances of customers
POLICY_FAMILIES = [
    ("return", ["退货", "退款", "无理由", "return", "refund"]),
    ("shipping", ["运费", "邮费", "shipping", "freight", "运费险"]),
    ("membership", ["plus", "88vip", "会员", "member"]),
    ("aftersale", ["售后", "保价", "维修", "投诉", "维权", "介入"]),
]
RETURN_KINDS = [("exchange", ["换货", "exchange", "换一件"]), ("price_protect", ["价保", "保价", "price protect", "差价"]), ("return", ["退货", "return", "退回", "退掉"]), ("refund", ["退款", "refund", "退钱"])]
ACCOUNT_INTENTS = [
    ("change_phone", ["改手机", "换手机", "换个手机", "换绑", "绑定新手机", "新手机号", "新号码", "更换手机", "更换号码"]),
    ("set_default_address", ["改默认", "设为默认", "设置为默认", "默认地址", "设默认", "换默认", "改默认地址"]),
    ("add_address", ["加地址", "新增地址", "添加地址", "加个地址", "加收货地址", "新地址", "加一个", "新增一个", "新增收货地址", "添加收货地址", "新增一条", "加一条"]),
    ("list_addresses", ["查地址", "我的地址", "收货地址", "所有地址", "地址列表", "查我地址", "地址都有哪些"]),
    ("profile", ["我的账号", "账户信息", "个人信息", "我的个人", "profile", "账户资料"]),
    ("list_addresses", ["地址"]),
]
ORDER_ID = r"(?i)\b(?:JD|TB)\d{8,16}\b"
TAX_ID = r"\b[A-Z0-9]{15,18}\b"

LATENCY_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0]

#: Fixed: the frame of an answer made without a model, its query line, and what stands for no hits.
EXTRACT_HEAD = "(LLM 服务暂不可用,以下内容为基于知识库的直接摘录。)"
EXTRACT_QUERY = "关于「{}」,以下知识库条目可能相关:"
EXTRACT_TAIL = "建议您稍后重试获取完整的 LLM 生成答复。"
EXTRACT_NONE = "当前知识库内信息不足,且 LLM 服务暂不可用。"

# The request for a chunk's context.
CONTEXT_TOP, CONTEXT_PARENT = "(top level)", 1500
CONTEXT_HEADS = ["Document title: ", "\nSection: ", "\nParent section text:\n", "\nChunk to situate:\n", "\n\nWrite the 1-2 sentence contextual summary."]

# How preferences are told to a planner.
PREFERENCE_ITEMS = 6
PREFERENCE_HEAD, PREFERENCE_LINE, PREFERENCE_MORE = "用户长期偏好(跨会话持久化的):", "  - {key}: {value} (来源: {source})", "  - ... 另有 {n} 项偏好"

# A company's name on an invoice, and what stands without one.
INVOICE_TITLE, INVOICE_PERSONAL = r"([一-龥A-Za-z0-9（）() ]{2,40}(?:公司|集团|研究院|中心))", "个人"

# How long rows are kept, and the states of a return that is over.
RETENTION_DAYS = {"audit_logs": 180, "feedback": 365, "return_requests": 365}
RETURN_OVER = ["completed", "rejected", "cancelled"]

# Why there is no answer.
ABSTAIN_NONE, ABSTAIN_LOW = "no_retrieval_hits", "top_score_below_threshold (%.3f)"
