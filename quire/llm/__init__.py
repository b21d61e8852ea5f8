"""Operators that turn raw crawled text into language-model training data."""
