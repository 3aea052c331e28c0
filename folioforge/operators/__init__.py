"""DataFrame operators: labelling, chunking, retrieval, generation, verification, metrics."""
