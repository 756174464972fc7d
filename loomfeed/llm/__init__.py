"""Training-data operators: deduplication, packing, filters, scans and splits of text corpora."""
