"""The four jobs, each built from the operators."""
