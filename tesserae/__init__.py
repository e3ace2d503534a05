"""Conversational-memory analytics expressed as PySpark DataFrame operators."""
