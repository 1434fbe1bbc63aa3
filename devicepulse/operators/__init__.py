"""DataFrame operators: profiling, evaluation, splitting, training, scoring."""
