"""Training-data operators: sharding, pseudonyms, archives, tokens, search, language, duplicates, leaks and secrets."""
