"""Review analytics and neighbourhood recommendation as Spark DataFrame operators."""
