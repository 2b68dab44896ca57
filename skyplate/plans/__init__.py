"""Whole pipelines, composed of operators and keyed by chart, so that one job handles all charts."""
