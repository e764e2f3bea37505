"""Operators that prepare language-model training data: each module holds one operator, `catalog` registers their queries."""
