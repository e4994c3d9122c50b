"""Multi-operator pipelines: monthly run, daily detector run, model training."""
