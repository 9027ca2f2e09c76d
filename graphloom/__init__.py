"""A property-graph engine on Spark: declared models, audits, pattern matches, profiles, drift and migration as DataFrame plans."""
