"""Operators that prepare text corpora for training; optional, and imported by nothing else in the library."""
