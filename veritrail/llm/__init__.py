"""Training-data operators: tokens, near-duplicates, decontamination, language, lines, search, quality and secrets."""
