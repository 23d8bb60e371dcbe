"""Composed jobs: prepare, report, train, score, study."""
