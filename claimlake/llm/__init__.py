"""Operators for preparing training data. Nothing else in claimlake imports this folder."""
