"""umbel: vector search, ranking and retrieval analytics as DataFrame plans."""
