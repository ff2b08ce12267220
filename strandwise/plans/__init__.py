"""Fitted estimators and the user-level jobs built from the operators."""
