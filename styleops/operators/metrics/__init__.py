"""Scores of hypotheses against references; input ``pair_id, hyp, refs array<string>``."""
