"""clausewright: versioned-clause analytics and training-data operators, written for Spark."""
