"""The queries of this subpackage by name."""

from . import ann, decontaminate, language, lm_score, pii, quality, sentencepiece_bpe, sharding, simhash, toxicity

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (quality, pii, language, sentencepiece_bpe, decontaminate, ann, toxicity, sharding, simhash, lm_score):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
