"""Query routing as a table of rules.

Rules are rows (intent, kind, pattern, weight, source) of fixed size; signals are
what they find in a query's text, one a (kind, value, source), and scores their
sums, adjusted by a few conditions between intents. All queries are routed in
one plan; the rules are expressions of one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH, MARGIN = 0.50, 0.80, 0.15
# Patterns, phrases and weights of the rules.
PATH = r"(?<!\w)(?:[\w.-]+/)+[\w.-]+(?:\.[A-Za-z0-9]+)?"
FUNCTION = r"\b[A-Za-z_][A-Za-z0-9_]*\(\)"
MACRO = r"\bCONFIG_[A-Z0-9_]+\b"
ERROR = r"\b(?:ERR|E)_[A-Z0-9_]+\b|0x[0-9A-Fa-f]+\b"
SYMBOL = r"\b[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]+\b(?!\(\))|\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b(?!\(\))|\b[A-Za-z_][A-Za-z0-9_]*::[A-Za-z_][A-Za-z0-9_]*\b(?!\(\))"
PHRASES = {
    ("code_exact", "lookup_phrase", 0.35): ("在哪里", "在哪", "定义", "声明", "谁引用", "属于哪个模块", "属于哪个"),
    ("code_concept", "concept_phrase", 0.35): ("如何实现", "怎么实现", "机制", "原理", "负责什么", "主要负责什么", "为什么这样", "如何把"),
    ("call_trace", "trace_phrase", 0.45): ("调用链", "调用链怎么走", "谁调用", "谁调用了", "被谁调用", "链路怎么走", "入口到"),
    ("runtime_flow", "runtime_phrase", 0.45): ("中断之后", "事件如何进入", "初始化顺序", "处理链路", "事件链", "消息链", "任务切换", "启动时"),
    ("profile_diff", "profile_keyword", 0.35): ("profile", "board", "defconfig", ".config", "kconfig", "影响哪些模块", "哪些 defconfig", "哪些 profile", "差异", "对比", "compare_to", "启用", "裁剪"),
    ("api_lookup", "api_keyword", 0.30): ("api", "接口", "参数", "返回值", "示例", "调用方式", "怎么用", "如何调用"),
    ("widget_lookup", "widget_keyword", 0.40): ("控件", "组件", "widget", "属性", "样式", "布局", "绑定", "绑定数据", "数据绑定", "点击事件"),
    ("workspace_nav", "navigation_phrase", 0.45): ("在哪看", "去哪里改", "目录结构", "哪个仓", "从哪些目录开始", "新同事", "新人入口", "职责边界", "该去哪看"),
    ("product_context", "product_keyword", 0.40): ("需求", "功能范围", "产品范围", "prd", "用户故事", "验收", "产品定义", "为什么要做"),
    ("project_context", "project_keyword", 0.40): ("里程碑", "排期", "风险", "进度", "版本计划", "release", "issue", "owner", "阻塞", "交付", "本周"),
    ("runtime_flow", "runtime_keyword", 0.25): ("isr", "task", "thread", "queue", "timer", "semaphore", "mutex", "event", "fault", "boot", "startup", "中断", "任务"),
    ("evidence_lookup", "evidence_keyword", 0.12): ("请带证据", "带证据", "给出处", "附上依据"),
}
EVIDENCE = ("证据包", "出处是什么", "原文依据", "给我.+证据", "给出.+出处", "引用")
VAGUE = ("这个", "这里", "那个", "那边", "东西")
ANCHORS = (
    (PATH, "path_like", {"code_exact": 0.35, "workspace_nav": 0.20, "code_concept": 0.15, "evidence_lookup": 0.15}),
    (FUNCTION, "symbol_like", {"code_exact": 0.35, "call_trace": 0.20, "evidence_lookup": 0.15}),
    (MACRO, "macro_name", {"code_exact": 0.25, "profile_diff": 0.25, "evidence_lookup": 0.15}),
    (ERROR, "error_code", {"code_exact": 0.25}),
    (SYMBOL, "symbol_like", {"code_exact": 0.22, "call_trace": 0.15, "evidence_lookup": 0.12}),
)
BY_DOMAIN = {"api": ("api_lookup", 0.55), "widget": ("widget_lookup", 0.55), "product": ("product_context", 0.55), "project": ("project_context", 0.55), "code": ("code_exact", 0.20), "engineering": ("code_concept", 0.20), "docs": ("api_lookup", 0.15), "design": ("product_context", 0.15)}
BY_VIEW = {"runtime": ("runtime_flow", 0.50), "profile": ("profile_diff", 0.50), "workspace": ("workspace_nav", 0.45), "layer": ("workspace_nav", 0.35), "domain": ("code_concept", 0.25), "feature": ("product_context", 0.20), "evidence": ("evidence_lookup", 0.40), "code": ("code_exact", 0.25)}
BY_GRANULARITY = {
    "symbol": {"code_exact": 0.45}, "file": {"code_exact": 0.45}, "function": {"code_exact": 0.40}, "flow": {"call_trace": 0.35, "runtime_flow": 0.35}, "profile": {"profile_diff": 0.45},
    "module": {"workspace_nav": 0.30, "code_concept": 0.25}, "directory": {"workspace_nav": 0.35}, "workspace": {"workspace_nav": 0.35},
    "feature": {"product_context": 0.20, "code_concept": 0.15}, "doc_section": {"api_lookup": 0.15, "widget_lookup": 0.15, "evidence_lookup": 0.10},
}
BY_CALLER = {
    "code_trace": {"call_trace": 0.40, "runtime_flow": 0.30}, "config_impact": {"profile_diff": 0.45}, "docs_search": {"api_lookup": 0.15, "widget_lookup": 0.15, "product_context": 0.15, "project_context": 0.15},
    "workspace_view": {"workspace_nav": 0.35}, "evidence_bundle": {"evidence_lookup": 0.45}, "code_resolve": {"code_exact": 0.40}, "code_context": {"code_concept": 0.35}, "kb_search": {"unknown": 0.10},
}
#: Intent: view, granularity, and weights of symbol, full-text, vector and graph retrieval (fixed values).
INTENTS = {
    "code_exact": ("code", "symbol", (0.55, 0.30, 0.05, 0.10)),
    "code_concept": ("domain", "module", (0.10, 0.35, 0.30, 0.25)),
    "call_trace": ("code", "flow", (0.40, 0.15, 0.05, 0.40)),
    "runtime_flow": ("runtime", "flow", (0.15, 0.20, 0.10, 0.55)),
    "profile_diff": ("profile", "profile", (0.15, 0.30, 0.05, 0.50)),
    "api_lookup": ("evidence", "doc_section", (0.10, 0.50, 0.30, 0.10)),
    "widget_lookup": ("feature", "doc_section", (0.10, 0.45, 0.30, 0.15)),
    "workspace_nav": ("workspace", "module", (0.10, 0.25, 0.10, 0.55)),
    "product_context": ("feature", "feature", (0.05, 0.45, 0.35, 0.15)),
    "project_context": ("evidence", "doc_section", (0.05, 0.50, 0.30, 0.15)),
    "evidence_lookup": ("evidence", "doc_section", (0.20, 0.35, 0.15, 0.30)),
    "unknown": ("evidence", "doc_section", (0.15, 0.40, 0.20, 0.25)),
}
RETRIEVERS = ("symbol", "fts", "vector", "graph")
PROFILE_SENSITIVE = ("profile_diff", "call_trace", "runtime_flow")
CODE_SIGNALS = ("symbol_like", "path_like", "macro_name", "error_code")
#: Intent: mode, tool, tools to fall back to, tools that follow (fixed values).
PLANS = {
    "unknown": ("explore", "kb_search", ("code_resolve", "docs_search", "workspace_view", "config_impact"), ()),
    "code_exact": ("direct", "code_resolve", ("code_context", "evidence_bundle", "kb_search"), ()),
    "code_concept": ("explore", "kb_search", ("workspace_view", "docs_search", "evidence_bundle"), ()),
    "call_trace": ("chain", "code_resolve", ("code_context", "kb_search", "evidence_bundle"), ("code_trace", "evidence_bundle")),
    "runtime_flow": ("chain", "workspace_view", ("docs_search", "kb_search", "evidence_bundle"), ("docs_search", "evidence_bundle")),
    "profile_diff": ("chain", "config_impact", ("code_resolve", "workspace_view", "evidence_bundle"), ("evidence_bundle",)),
    "api_lookup": ("direct", "docs_search", ("code_resolve", "kb_search", "evidence_bundle"), ()),
    "widget_lookup": ("direct", "docs_search", ("workspace_view", "code_resolve", "evidence_bundle"), ()),
    "workspace_nav": ("direct", "workspace_view", ("code_context", "kb_search", "evidence_bundle"), ()),
    "product_context": ("direct", "docs_search", ("workspace_view", "evidence_bundle"), ()),
    "project_context": ("direct", "docs_search", ("evidence_bundle", "workspace_view"), ()),
    "evidence_lookup": ("direct", "evidence_bundle", ("code_resolve", "docs_search", "kb_search"), ()),
}


@dataclass(frozen=True)
class Request:
    """Columns that requests may have besides the query's text; what is absent is ``auto``."""

    domain: str = "domain"
    view: str = "view"
    granularity: str = "granularity"
    profile_id: str = "profile_id"
    caller_tool: str = "caller_tool"
    selected_symbol: str = "selected_symbol"
    active_file: str = "active_file"
    previous_intent: str = "previous_intent"
    absent: dict[str, str] = field(default_factory=lambda: {"domain": "auto", "view": "auto", "granularity": "auto"})


def normalized(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(query, "　", " "), r"\s+", " "))


def _signal(intent: str, kind: Column | str, value: Column, weight: Column | float, source: str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    return F.struct(F.lit(intent).alias("intent"), lit(kind).alias("kind"), value.alias("value"), lit(weight).cast("double").alias("weight"), F.lit(source).alias("source"))


def _each(values: Column, intent: str, kind: str, weight: float, bare: bool = False) -> Column:
    """A signal for each value; ``bare`` leaves a call's parentheses out."""
    return F.transform(values, lambda v: _signal(intent, kind, F.regexp_replace(v, r"\(\)$", "") if bare else v, weight, "query"))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _holds(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def signals(requests: DataFrame, names: Request = Request()) -> DataFrame:
    """Adds ``q`` (the normalised text) and ``signals`` (H8): one a (intent, kind, value, source), the first of equals."""
    have = set(requests.columns)
    c = lambda f: F.col(getattr(names, f)) if getattr(names, f) in have else F.lit(names.absent.get(f)).cast("string")
    q = F.col("q")
    parts: list[Column] = []
    one = lambda when, *s: F.when(when, F.array(*s)).otherwise(F.array().cast(_TYPE))
    for d, (intent, weight) in BY_DOMAIN.items():
        kind = {"api": "api_keyword", "widget": "widget_keyword", "product": "product_keyword", "design": "product_keyword", "project": "project_keyword"}.get(d, "client_context_hint")
        parts.append(one(c("domain") == d, _signal(intent, kind, F.lit(d), weight, "explicit_param")))
    for v, (intent, weight) in BY_VIEW.items():
        parts.append(one(c("view") == v, _signal(intent, "client_context_hint", F.lit(v), weight, "explicit_param")))
    for g, several in BY_GRANULARITY.items():
        parts.append(one(c("granularity") == g, *[_signal(i, "client_context_hint", F.lit(g), w, "explicit_param") for i, w in several.items()]))
    parts.append(one(~F.coalesce(c("profile_id"), F.lit("auto")).isin("auto", "current"), _signal("profile_diff", "profile_keyword", c("profile_id"), 0.35, "explicit_param")))
    for tool, several in BY_CALLER.items():
        parts.append(one(c("caller_tool") == tool, *[_signal(i, "caller_tool_hint", F.lit(tool), w, "caller_tool") for i, w in several.items()]))
    for pattern, kind, several in ANCHORS:
        for intent, weight in several.items():
            bare = (intent, pattern) == ("evidence_lookup", FUNCTION)
            parts.append(_each(_found(q, pattern), intent, kind, weight, bare))
    dotted = F.filter(_found(q, SYMBOL), lambda v: F.contains(v, F.lit(".")))
    parts.append(F.transform(dotted, lambda v: _signal("api_lookup", "symbol_like", v, 0.15, "query")))
    for (intent, kind, weight), terms in PHRASES.items():
        for term in terms:
            quoted = r"(?i)\Q" + term + r"\E"
            parts.append(_each(_found(q, quoted), intent, kind, weight))
    for pattern in EVIDENCE:
        parts.append(F.transform(_found(q, "(?i)" + pattern), lambda v: _signal("evidence_lookup", "evidence_keyword", v, 0.50, "query")))
    anchored = reduce(lambda a, b: a | b, [q.rlike(p) for p in (FUNCTION, PATH, MACRO, SYMBOL)])
    vague = ~anchored & ((F.length(q) <= 10) | _holds(F.lower(q), VAGUE))
    parts.append(one(vague, _signal("unknown", "vague_query", q, 0.45, "query")))
    symbol, active = F.nullif(F.trim(c("selected_symbol")), F.lit("")), c("active_file")
    is_macro = symbol.rlike(f"^(?:{MACRO})$")
    parts.append(one(symbol.isNotNull() & is_macro, _signal("profile_diff", "macro_name", symbol, 0.20, "client_context")))
    parts.append(one(symbol.isNotNull() & ~is_macro, _signal("code_exact", "symbol_like", symbol, 0.20, "client_context")))
    parts.append(one(symbol.isNotNull(), _signal("call_trace", "client_context_hint", symbol, 0.10, "client_context")))
    parts.append(one(F.trim(active) != "", _signal("workspace_nav", "client_context_hint", active, 0.15, "client_context"), _signal("code_concept", "client_context_hint", active, 0.10, "client_context")))
    for intent in INTENTS:
        parts.append(one(c("previous_intent") == intent, _signal(intent, "client_context_hint", F.lit(intent), 0.10, "history")))
    rows = requests.withColumn("q", normalized(F.col("query")))
    return rows.withColumn("signals", F.flatten(F.array(*parts)))


_TYPE = "array<struct<intent:string,kind:string,value:string,weight:double,source:string>>"


def scores(requests: DataFrame, key: str = "query_id", names: Request = Request()) -> DataFrame:
    """(key, q, intent, score, signals) of every intent of every query, before the choice."""
    rows = signals(requests, names).select(key, "q", F.posexplode_outer("signals").alias("at", "s"))
    # Of signals that differ in nothing but their weight, the first counts.
    once = rows.groupBy(key, "q", F.col("s.intent").alias("intent"), F.col("s.kind").alias("kind"), F.col("s.value").alias("value"), F.col("s.source").alias("source")).agg(F.min_by("s.weight", "at").alias("weight"))
    kept = once.groupBy(key, "q").agg(F.filter(F.collect_list(F.struct("intent", "kind", "value", "source", "weight")), lambda s: s["intent"].isNotNull()).alias("signals"))
    q, low = F.col("q"), F.lower("q")
    of = lambda i: F.filter("signals", lambda s: s["intent"] == i)
    total = lambda i: F.aggregate(of(i), F.lit(0.0), lambda a, s: a + s["weight"])
    phrase = {kind: words for (_, kind, _), words in PHRASES.items()}
    raw = {i: total(i) for i in INTENTS}
    with_raw = kept.select("*", *[x.alias(f"s_{i}") for i, x in raw.items()])
    s = {i: F.col(f"s_{i}") for i in INTENTS}
    others = F.greatest(*[s[i] for i in INTENTS if i != "evidence_lookup"])
    modifier = _holds(low, phrase["evidence_keyword"])
    s["evidence_lookup"] = F.when(modifier & (others >= 0.45), F.least(s["evidence_lookup"], F.lit(0.20))).otherwise(s["evidence_lookup"])
    plus = lambda i, when, x: F.when(when, s[i] + x).otherwise(s[i])
    project, navigates = _holds(low, phrase["project_keyword"]), _holds(q, phrase["navigation_phrase"])
    s["code_exact"] = plus("code_exact", _holds(q, phrase["lookup_phrase"]) & ~_holds(low, phrase["profile_keyword"]), 0.10)
    s["workspace_nav"] = plus("workspace_nav", navigates, 0.10)
    symbols = F.size(F.filter(of("call_trace"), lambda x: x["kind"] == "symbol_like"))
    s["call_trace"] = plus("call_trace", _holds(q, phrase["trace_phrase"]) & (symbols >= 1), F.when(symbols >= 2, 0.15).otherwise(0.10))
    s["runtime_flow"] = plus("runtime_flow", _holds(q, phrase["runtime_phrase"]) & _holds(low, phrase["runtime_keyword"]), 0.15)
    s["workspace_nav"] = plus("workspace_nav", F.contains(q, F.lit("职责边界")) & F.contains(q, F.lit("和")), 0.20)
    path = F.exists(of("code_concept"), lambda x: x["kind"] == "path_like")
    s["code_concept"] = plus("code_concept", _holds(q, phrase["concept_phrase"]) & path & ~navigates, 0.15)
    s["project_context"] = plus("project_context", project, 0.15)
    s["product_context"] = F.when(project, F.greatest(F.lit(0.0), s["product_context"] - 0.05)).otherwise(s["product_context"])
    s["product_context"] = plus("product_context", _holds(low, phrase["product_keyword"]) & ~project, 0.10)
    both = F.exists(of("api_lookup"), lambda x: x["kind"] == "api_keyword") & F.exists(of("api_lookup"), lambda x: x["kind"] == "symbol_like")
    s["api_lookup"] = plus("api_lookup", both, 0.05)
    each = F.array(*[F.struct(F.least(F.lit(1.0), F.round(s[i], 9)).alias("score"), F.lit(i).alias("intent")) for i in INTENTS])
    return with_raw.select(key, "q", "signals", F.sort_array(each, asc=False).alias("ranked"))


def route(requests: DataFrame, key: str = "query_id", names: Request = Request(), enabled: tuple[str, ...] = RETRIEVERS) -> DataFrame:
    """The route of each query (H9-H12): intent, confidence, warnings, view,
    granularity, whether a profile is required, retriever weights, tool plan."""
    ranked = scores(requests, key, names)
    top, second = F.col("ranked")[0], F.col("ranked")[1]
    low = top["score"] < LOW
    intent = F.when(low, "unknown").otherwise(top["intent"])
    close = (top["score"] < HIGH) & (F.round(top["score"] - second["score"], 9) < MARGIN)
    warned = F.when(low, F.array(F.lit("router.low_confidence"))).otherwise(F.filter(F.array(F.when(top["score"] < HIGH, "router.medium_confidence"), F.when(close, "router.ambiguous_intent")), lambda w: w.isNotNull()))
    own = F.filter("signals", lambda s: s["intent"] == top["intent"])
    vague = F.filter("signals", lambda s: s["intent"] == "unknown")
    rows = ranked.select(key, "q", intent.alias("intent"), F.round(top["score"], 6).alias("confidence"), warned.alias("warnings"), F.when(low & (F.size(own) == 0), vague).otherwise(own).alias("matched"))
    extra = [c for c in ("domain", "view", "granularity", "profile_id") if getattr(names, c) in requests.columns]
    asked = requests.select(key, *[F.col(getattr(names, c)).alias(f"asked_{c}") for c in extra])
    rows = rows.join(asked, key)
    said = lambda c: F.col(f"asked_{c}") if c in extra else F.lit("auto")
    is_kind = lambda *kinds: F.exists("matched", lambda s: s["kind"].isin(*kinds))
    i = F.col("intent")
    default = lambda at: F.create_map(*[F.lit(x) for k, v in INTENTS.items() for x in (k, v[at])])[i]
    view = F.when((i == "code_concept") & is_kind("path_like"), "code").when((i == "workspace_nav") & F.exists("matched", lambda s: s["value"] == "职责边界"), "layer").otherwise(default(0))
    folder = F.exists("matched", lambda s: F.contains(s["value"], F.lit("目录")) | F.contains(s["value"], F.lit("/")))
    grain = F.when((i == "code_exact") & is_kind("path_like"), "file").when((i == "workspace_nav") & folder, "directory").when((i == "evidence_lookup") & is_kind(*CODE_SIGNALS), "symbol").otherwise(default(1))
    given = lambda c, other: F.when(F.coalesce(said(c), F.lit("auto")) != "auto", said(c)).otherwise(other)
    rows = rows.withColumns({"view": given("view", view), "granularity": given("granularity", grain)})
    asked_profile = said("profile_id")
    # A request that says nothing of profiles is an automatic one.
    needs = F.coalesce(asked_profile, F.lit("auto")).isin("current") | ~F.coalesce(asked_profile, F.lit("auto")).isin("auto") | (F.col("view") == "profile") | i.isin(*PROFILE_SENSITIVE) | is_kind("profile_keyword")
    rows = rows.withColumn("needs_profile", needs)
    rows = rows.withColumn("weights", F.create_map(*[x for k, (_, _, w) in INTENTS.items() for x in (F.lit(k), weights_of(w, enabled))])[i])
    anchored = is_kind(*CODE_SIGNALS)
    plan = lambda at: F.create_map(*[x for k, v in PLANS.items() for x in (F.lit(k), F.lit(v[at]) if isinstance(v[at], str) else F.array(*map(F.lit, v[at])).cast("array<string>"))])[i]
    tool = F.when((i == "code_concept") & anchored, "code_context").when((i == "runtime_flow") & anchored, "code_trace").otherwise(plan(1))
    mode = F.when((i == "code_concept") & anchored, "direct").otherwise(plan(0))
    return rows.select(key, "intent", "confidence", "warnings", "view", "granularity", "needs_profile", "weights", mode.alias("route_mode"), tool.alias("tool"), plan(2).alias("fallback_tools"), plan(3).alias("chain"), "matched")


def weights_of(raw: tuple[float, ...], enabled: tuple[str, ...]) -> Column:
    """Weights of the enabled retrievers, made to sum to one; without any, full text alone."""
    left = {n: w for n, w in zip(RETRIEVERS, raw, strict=True) if n in enabled and w > 0}
    total = sum(left.values())
    out = {n: round(w / total, 6) for n, w in left.items()} if total > 0 else {"fts": 1.0}
    return F.create_map(*[x for n, w in out.items() for x in (F.lit(n), F.lit(w))])
