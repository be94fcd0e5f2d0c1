"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from tessera.llm import alignment, counts, imatch, langid, knn, licenses, minhash, nbest, packing, pii, turns, urls, warc

MODULES = (pii, warc, packing, counts, imatch, langid, minhash, licenses, nbest, knn, urls, alignment, turns)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
