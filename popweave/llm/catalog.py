"""Queries of this package, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from popweave.llm import (
    conversations,
    exact_dedup,
    html_text,
    jaccard_join,
    langid,
    line_dedup,
    mixing,
    nearest,
    packing,
    pieces,
    quality,
    sharding,
    spelling,
)

MODULES = (pieces, line_dedup, mixing, exact_dedup, html_text, jaccard_join, langid, nearest, quality, sharding,
           spelling, conversations, packing)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
