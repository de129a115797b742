"""Query graphs, statistics, shares, costs and plans."""
