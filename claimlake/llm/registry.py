"""The queries of this subpackage and their SQL."""

from claimlake.llm import language, lines, mixing, packing, pii, quality, simhash, token_files, topk, warc

_MODULES = (packing, mixing, warc, token_files, quality, simhash, topk, lines, pii, language)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
