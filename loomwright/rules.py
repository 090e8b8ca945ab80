"""Rule sets as one frozen object: defaults here, overrides from a YAML file of the same sections."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Rules:
    """Everything the text operators take from configuration; all of it may be replaced."""

    url_blacklist: tuple[str, ...] = ("quote.", "stockpage", "/guba", "finance.yahoo.com", "baike.")
    title_blacklist: tuple[str, ...] = ("股票行情", "股吧", "百科", "stock quote")
    filename_blacklist: tuple[str, ...] = ("行情中心", "公司简介", "百科")
    name_blacklist: tuple[str, ...] = ("有限公司", "股份公司", "集团公司")
    min_content: int = 100
    noise: tuple[str, ...] = (r"^(关于|联系|首页|导航|菜单)", r"^(about|contact|menu|navigation)\b", r"(登录|注册|订阅|版权所有)", r"(copyright|all rights reserved|privacy policy)", r"^[-=_#*\s]{10,}$", r"^[|:\s]+$")
    weights: dict = field(default_factory=lambda: {"content_length": 0.15, "has_action_verbs": 0.1, "has_entity_names": 0.2, "has_specific_numbers": 0.25, "no_noise_ratio": 0.15, "sentence_diversity": 0.15})
    accept: float = 0.5
    review: float = 0.2
    grades: dict = field(default_factory=lambda: {"S": 0.8, "A": 0.5, "B": 0.2})
    number_units: str = r"[0-9]+(?:[.][0-9]*)?\s*(?:%|GB|TB|mm|nm|Q[1-4]|倍|元|万|亿)"
    entity_words: str = r"(Intel|TSMC|AMD|NVIDIA|芯片|半导体|股份|集团|公司)"
    action_words: tuple[str, ...] = ("grew", "acquired", "announced", "launched", "收购", "投资", "增长", "下降", "突破", "宣布", "推出", "发布")
    industry_words: tuple[str, ...] = ("芯片", "半导体", "GPU", "AI", "营收", "利润", "产能", "revenue", "profit", "capacity")
    role_words: str = r"(CEO|总裁|董事长|总经理|集团|股份|公司)"
    positive: tuple[str, ...] = ("增长", "突破", "领先", "growth", "record", "strong")
    negative: tuple[str, ...] = ("下降", "亏损", "风险", "decline", "loss", "weak")
    info_types: tuple[tuple[str, str], ...] = ((r"(营收|利润|财报|revenue|earnings)", "财务"), (r"(发布|推出|新品|launch)", "产品"), (r"(收购|并购|投资|融资|acqui)", "投资"), (r"(合作|签约|partner)", "合作"), (r"(政策|监管|regulat)", "政策"), (r"(研发|专利|突破|patent)", "技术"), (r"(人事|任命|辞职|appoint)", "人事"))
    file_types: tuple[tuple[str, str, float], ...] = ((r"(半年|semi.?annual|interim)", "semi_annual_report", 0.95), (r"(年报|年度报告|annual)", "annual_report", 0.95), (r"(季报|季度|quarter|q[1-4])", "quarterly_report", 0.9), (r"(招股|prospectus|ipo)", "prospectus", 0.95), (r"(投资者关系|调研|investor)", "investor_relations", 0.85), (r"(研报|研究|research)", "research", 0.8), (r"(公告|announce)", "announcement", 0.7), (r"(新闻|news)", "news", 0.6))
    name_patterns: tuple[str, ...] = (r"[一-鿿]{2,8}(?:股份|科技|集团|电子)", r"[A-Z][A-Za-z]+ (?:Inc|Corp|Ltd|Technologies)", r"\b[A-Z]{2,5}\b(?=[:\s]+(?:NASDAQ|NYSE))")
    question_words: tuple[str, ...] = ("?", "？", "如何", "哪些", "什么", "why", "how", "which")
    topic_keywords: dict = field(default_factory=dict)
    specificity: dict = field(default_factory=dict)
    default_specificity: float = 0.5
    min_specificity: float = 0.3
    keyword_max: float = 0.7
    hint_score: float = 1.0
    cascade_score: float = 0.8
    mention_score: float = 0.3
    min_score: float = 0.3
    prominent_chars: int = 500
    prominent_count: int = 3


def load_rules(path: str | None = None) -> Rules:
    """Rules from YAML; sections that are missing, empty or unreadable keep their defaults."""
    base = Rules()
    if not path or not os.path.exists(path):
        return base
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            y = yaml.safe_load(f) or {}
        except yaml.YAMLError:
            return base
    get = lambda *ks: _dig(y, ks)
    over = {}
    for name, keys in {"url_blacklist": ("low_quality_sources", "url_patterns"), "title_blacklist": ("low_quality_sources", "title_patterns"), "filename_blacklist": ("low_quality_sources", "filename_patterns"), "noise": ("noise_patterns",)}.items():
        if isinstance(v := get(*keys), list):
            over[name] = tuple(str(x) for x in v)
    if "noise" in over:
        over["noise"] = tuple(p for p in over["noise"] if _compiles(p))
    for name, keys in {"min_content": ("collection_quality", "min_content_length"), "accept": ("quality_grading", "thresholds", "accept"), "review": ("quality_grading", "thresholds", "review")}.items():
        if isinstance(v := get(*keys), int | float):
            over[name] = v
    if isinstance(w := get("quality_grading", "weights"), dict):
        over["weights"] = {**base.weights, **w}
    if isinstance(g := get("quality_grading", "grading"), dict):
        over["grades"] = {k: g.get(k, {}).get("min_score", d) for k, d in base.grades.items()}
    if isinstance(t := get("topic_keywords"), dict):
        over["topic_keywords"] = {k: tuple(v) for k, v in t.items() if isinstance(v, list)}
    return replace(base, **over)


def with_settings(rules: Rules, settings: dict) -> Rules:
    """Rules with the settings section of a graph file: blacklist, keyword specificity, relevance weights."""
    s = settings or {}
    meta, rel = s.get("keyword_meta") or {}, s.get("relevance_weights") or {}
    pick = {"hint_score": rel.get("company_hint"), "cascade_score": rel.get("sector_cascade"), "keyword_max": rel.get("keyword_max"), "mention_score": rel.get("company_mention"), "min_score": rel.get("min_score_threshold"), "prominent_chars": rel.get("prominent_mention_chars"), "prominent_count": rel.get("prominent_mention_count"), "default_specificity": meta.get("default_specificity"), "min_specificity": meta.get("min_specificity_threshold")}
    over = {k: v for k, v in pick.items() if v is not None}
    if s.get("name_blacklist"):
        over["name_blacklist"] = tuple(s["name_blacklist"])
    if meta.get("specificity_overrides"):
        over["specificity"] = dict(meta["specificity_overrides"])
    return replace(rules, **over)


def _dig(d, keys):
    for k in keys:
        d = d.get(k) if isinstance(d, dict) else None
    return d


def _compiles(p: str) -> bool:
    try:
        re.compile(p)
        return True
    except re.error:
        return False


def to_bool(value, default: bool = False) -> bool:
    if value is None:
        return default
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")


def to_number(value, kind=float, default=0):
    try:
        return kind(value)
    except (TypeError, ValueError):
        return default


@dataclass(frozen=True)
class OpsConfig:
    """Operational settings; the environment wins over the file, the file over these defaults."""

    as_of: str = ""
    search_days: int = 7
    llm_provider: str = "rules"
    llm_timeout: float = 60.0
    retries: int = 3
    dry_run: bool = False

    @staticmethod
    def load(path: str | None = None, env: dict | None = None, prefix: str = "KB_") -> OpsConfig:
        env = os.environ if env is None else env
        flat: dict = {}
        if path and os.path.exists(path):
            import yaml

            with open(path, encoding="utf-8") as f:
                flat = yaml.safe_load(f) or {}
        kinds = {"as_of": str, "search_days": int, "llm_provider": str, "llm_timeout": float, "retries": int, "dry_run": to_bool}
        out = {}
        for name, kind in kinds.items():
            raw = env.get(prefix + name.upper(), flat.get(name))
            if raw is not None:
                out[name] = to_bool(raw) if kind is to_bool else to_number(raw, kind, getattr(OpsConfig, name))
        c = OpsConfig(**out)
        if c.retries < 0 or c.llm_timeout <= 0:
            raise ValueError("retries and llm_timeout must be positive")
        return c
