"""All queries of this subpackage, and the SQL of those that SQL can express."""

from . import bpe, html_extract, language, media, near_dedup, packing, quality, sharding, url_filter, warc

_MODULES = (near_dedup, html_extract, sharding, media, url_filter, warc, packing, bpe, quality, language)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
