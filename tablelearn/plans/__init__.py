"""Training, comparison, promotion and scoring jobs built from the operators."""
