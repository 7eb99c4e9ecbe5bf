"""All queries of the text operators, with the SQL of those that SQL can express."""

from gridloom.llm import decontaminate, exact_dedup, licenses, line_dedup, merkle, ngram_join, packing, pii, quality, sharding, spelling, token_files, toxicity

MODULES = [line_dedup, token_files, toxicity, exact_dedup, pii, ngram_join, licenses, packing, decontaminate, quality, sharding, spelling, merkle]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
