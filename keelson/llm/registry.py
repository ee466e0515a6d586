"""All registered queries of this package: name -> (query, SQL or None)."""

from __future__ import annotations

from . import q_dedup, q_search, q_text, q_tokens

QUERIES = {**q_dedup.QUERIES, **q_text.QUERIES, **q_tokens.QUERIES, **q_search.QUERIES}
