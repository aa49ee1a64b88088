"""Column functions: text keys, scores and classes, ids and fingerprints, vectors."""
