"""Record linkage and rule audit over catalogs, written for Spark."""
