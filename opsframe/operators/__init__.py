"""Table operators: DataFrame in, DataFrame (or a few of them) out."""
