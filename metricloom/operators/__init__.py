"""Table operators: lazy DataFrame in, DataFrame out."""
