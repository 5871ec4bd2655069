"""Multi-step plans: order statistics, running totals, feature tables, fold training."""
