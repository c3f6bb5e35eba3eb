"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from . import bpe, embeddings, lm, mixing, ogg, simhash, substring, suffix, toxicity

MODULES = [embeddings, simhash, bpe, mixing, lm, ogg, substring, suffix, toxicity]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
