"""Operators for preparing language-model training data (see README, "Training-data operators").

Nothing outside this subpackage imports it; ``registry`` lists its queries and their SQL.
"""
