"""DataFrame operators: samples, metrics, graph, agents, datasets."""
