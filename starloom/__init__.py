"""Rating analytics on Spark: features, models, routing and audits over user-item reviews."""
