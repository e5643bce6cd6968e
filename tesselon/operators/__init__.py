"""DataFrame operators: observations, relations, graphs, audits and profiles."""
