"""Training-data operators: tokens, cleaning, duplicates, leaks, output and scoring."""
