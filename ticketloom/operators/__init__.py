"""DataFrame operators: relational, aggregation, ranking, retrieval, routing, drafting, evaluation, quality."""
