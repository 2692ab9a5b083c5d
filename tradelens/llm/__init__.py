"""Operators for preparing training corpora: filters, de-duplication, scoring, tokenising, mixing."""
