"""Operators for preparing training data; nothing else in millrace imports this subpackage."""
