"""Compositions: model fitting, evaluation, end-to-end runs."""
