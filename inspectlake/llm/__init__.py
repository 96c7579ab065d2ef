"""Training-data operators: cleaning, matching, labelling, formatting and encoding of text corpora."""
