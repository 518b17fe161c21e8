"""Model-driven graph and facet analytics, expressed as Spark DataFrame plans."""
