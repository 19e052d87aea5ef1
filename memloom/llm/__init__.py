"""Operators for preparing large training collections; nothing outside imports this."""
