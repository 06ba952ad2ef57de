"""Registered queries of the library's own operators, each with its SQL."""

from __future__ import annotations

from loomwright.plans import alignments, audits, bridges, calendars, citing, containments, corpora, corrections, decisions, kindred, lookups, ordered, publications, relocations, texts, trees, witnesses, years

_MODULES = (corpora, decisions, calendars, texts, corrections, ordered, witnesses, audits, kindred, years, lookups, alignments, containments, bridges, relocations, trees, citing, publications)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
flagship = corpora.range_rule_resolve
