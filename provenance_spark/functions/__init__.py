"""Column expressions: text normalisation and cleaning, tokenisation, losses, probabilities."""
