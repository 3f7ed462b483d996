"""Plans of several operators each: feature extraction, scoring, lifecycle merge, notification."""
