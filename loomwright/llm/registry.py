"""All queries of this subpackage and their SQL, where SQL can express them."""

from loomwright.llm import bpe, chat, context_tree, decontaminate, filter_audit, html, jaccard, language, quality, spelling, token_files, topk, toxicity

_MODULES = (bpe, chat, context_tree, decontaminate, filter_audit, html, jaccard, language, quality, spelling, token_files, topk, toxicity)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
