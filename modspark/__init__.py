"""Spark-native moderation, pseudonymisation and admission control.

Every operator is a function from DataFrame (or Column) to DataFrame (or
Column).  "Now" is always a parameter, thresholds are parameters, and ties are
broken on a unique id, so a re-run gives the same answer.
"""
