"""DataFrame operators: features, documents, retrieval, curation, ranking, places, keyed state."""
