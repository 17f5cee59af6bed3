"""The queries of this subpackage; importing the operators registers them."""

from tidemark.llm import (
    chat_format,
    decontaminate,
    line_dedup,
    lm_scoring,
    mixing,
    pii,
    prefix_trie,
    quality_rules,
    simhash_trie,
    substring_dedup,
    topk_search,
    turn_repair,
    warc,
)
from tidemark.llm.common import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "chat_format",
    "decontaminate",
    "line_dedup",
    "lm_scoring",
    "mixing",
    "pii",
    "prefix_trie",
    "quality_rules",
    "simhash_trie",
    "substring_dedup",
    "topk_search",
    "turn_repair",
    "warc",
]
