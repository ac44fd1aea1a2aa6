"""Operators on training text: splitting, page repair, tokenizing, leakage and toxicity. Nothing else imports this."""

from lexweave.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
