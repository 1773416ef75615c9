"""Operators for preparing training data: ten text, page, chat and media operators and their queries."""
