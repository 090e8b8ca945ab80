"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["warc", "decontaminate", "bpe", "fertility", "lines", "pii", "substrings", "ngram_join", "compaction", "toxicity"]


def _modules():
    return [import_module(f"{__package__}.{m}") for m in _MODULES]


def queries():
    return {m.QUERY: m.query for m in _modules()}


def oracle_sql():
    return {m.QUERY: m.SQL for m in _modules() if getattr(m, "SQL", None)}
