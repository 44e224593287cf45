"""Listing analytics on Spark: extraction, filtering, dispatch, features, evaluation and DOM analytics as DataFrame plans."""
