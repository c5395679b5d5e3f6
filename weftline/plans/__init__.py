"""Multi-step jobs built from operators."""
