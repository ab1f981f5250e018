"""DataFrame-in, DataFrame-out analytical operators."""
