"""ledgermill: a Spark-first engine for record cleaning, rule evaluation and entity resolution."""
