"""The registered queries of this subpackage and their SQL."""

from gleaner.llm import audit, bpe, collocations, fingerprints, licenses, media, minhash, mixing, private, quality, scoring, site_lines, tokens

MODULES = (tokens, private, media, licenses, site_lines, minhash, bpe, scoring, mixing, quality, fingerprints, collocations, audit)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
