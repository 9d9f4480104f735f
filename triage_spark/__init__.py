"""Spark-native variant triage: cohort building, features, scoring, evidence and reply checks."""
