"""Defect-triage analytics as batch Spark jobs: search, ranking, mining, graph and grading."""
