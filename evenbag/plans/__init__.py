"""Barriers, comparison of bags, plan shapes, generation of stacked rewrites."""
