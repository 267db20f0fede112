"""Physical-shape helpers: checked broadcasts, hot-key splitting, runs, exact quantiles."""
