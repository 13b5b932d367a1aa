"""Training-data operators: mixing, near-duplicates, search, classifiers, formatting, media, packing and scoring."""
