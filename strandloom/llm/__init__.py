"""Operators for preparing text corpora: ten DataFrame-in, DataFrame-out jobs and their queries."""
