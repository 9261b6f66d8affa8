"""DataFrame operators of the folding engine."""
