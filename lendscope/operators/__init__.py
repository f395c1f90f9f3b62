"""DataFrame operators: features, fitted state, splits, profiles, metrics, training, monitoring, scoring."""
