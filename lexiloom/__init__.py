"""Lexiloom: inference rules from dependency n-grams, by distributional similarity, on Spark."""
