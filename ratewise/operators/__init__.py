"""DataFrame operators: splits, bias, evaluation, statistics, clustering, matrix."""
