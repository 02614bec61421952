"""End-to-end compositions of the operators (feature pipeline, runs, trial)."""
