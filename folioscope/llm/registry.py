"""Queries of this subpackage and their oracles."""

from folioscope.llm import brown_lm, byte_bpe, exact_dedup, filter_audit, jaccard_join, language_id, nearest, packing, prefix_trie, quality, secret_scan, url_filter, warc

_MODULES = (brown_lm, byte_bpe, exact_dedup, filter_audit, jaccard_join, language_id, nearest, packing, prefix_trie, quality, secret_scan, url_filter, warc)
_ALL = {k: v for m in _MODULES for k, v in m.QUERIES.items()}

QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items() if sql}
