"""Row operators: DataFrame in, DataFrame out."""
