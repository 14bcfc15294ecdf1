"""Table and series operators, DataFrame in, DataFrame out."""
