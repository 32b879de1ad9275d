"""Relational building blocks: facts, top-k, de-duplication, extraction, vectors."""
