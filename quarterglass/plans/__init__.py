"""Compositions of operators: the research panel and the audit run."""
