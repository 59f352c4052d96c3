"""DataFrame operators: views, normalisation, profiling, positional tables."""
