"""DataFrame operators: intervals, longest-prefix match, graphs, policies, reachability, rules."""
