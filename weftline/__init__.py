"""weftline: schema-driven property-graph analytics expressed as Spark plans."""
