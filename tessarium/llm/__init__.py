"""Training-data operators: tokenizers, deduplication, filters, packing, archives, search and classifiers."""
