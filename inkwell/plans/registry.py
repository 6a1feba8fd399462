"""All registered queries of the reference's operators, with their DuckDB SQL."""

from inkwell.plans import corpus, retrieval, rules

FLAGSHIP = "h10_semantic_search"
QUERIES: dict = {**corpus.QUERIES, **retrieval.QUERIES, **rules.QUERIES}
SQL: dict = {**corpus.SQL, **retrieval.SQL, **rules.SQL}
