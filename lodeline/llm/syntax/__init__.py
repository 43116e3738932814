"""Syntactic validity of source files: a lexer with a pushdown stack for each language, then its grammar."""
