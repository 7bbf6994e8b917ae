"""Plans: compositions of operators over sources, and the registered queries."""
