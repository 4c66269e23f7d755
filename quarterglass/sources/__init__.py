"""Readers, writers and the adapters that shape other tables into panels."""
