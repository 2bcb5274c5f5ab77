"""Training-data operators: deduplication, classification, mixing, archives, personal data and tokenising."""
