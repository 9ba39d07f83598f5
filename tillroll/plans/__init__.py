"""Multi-step plans: distributed prefix sums and quantiles, group attachment, full runs."""
