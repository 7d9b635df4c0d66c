"""DataFrame -> DataFrame operators: registry audit, rules, comparisons, reports, links."""
