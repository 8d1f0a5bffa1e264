"""Column functions: text folds, redaction, crypto, edit distance, time."""
