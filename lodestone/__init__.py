"""Lodestone: grounded retrieval, its evaluation and its dashboards as Spark plans."""
