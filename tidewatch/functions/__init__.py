"""Column-level building blocks: scores, text, timestamps, signatures."""
