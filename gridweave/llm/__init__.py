"""Operators of a training-data pipeline: ten operators, their queries, nothing else imports them."""
