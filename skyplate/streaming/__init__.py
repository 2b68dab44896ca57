"""Cycles as a stream: each batch of catalog rows is one step of the rollover."""
