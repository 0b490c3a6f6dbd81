"""DataFrame operators of the funnel: expansion, filters, branches, revenue, enrichment."""
