"""Operators over DataFrames: ranking, linking, gating, evaluation, validation, answers."""
