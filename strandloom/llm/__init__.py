"""Operators for building training data: decontamination, secrets, PII, mixing,
chat formatting, exact and near deduplication, language ID, media and sharding.

Nothing else in the library imports this subpackage.
"""
