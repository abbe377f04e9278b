"""Training-data operators: text preparation for large corpora, each a DataFrame -> DataFrame function."""
