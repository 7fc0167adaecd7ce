"""Table jobs: every function takes and returns DataFrames."""
