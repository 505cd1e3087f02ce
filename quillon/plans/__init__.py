"""Execution helpers shared by operators: sessions, staging and iteration."""
