"""Functions of the transaction engine."""
