"""DataFrame operators: frames, search, ranking, retrieval, regions, pairs, statistics, matching."""
