"""The data steps: DataFrame in, DataFrame out."""
