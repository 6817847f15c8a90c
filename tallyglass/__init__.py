"""Evidence-driven recognition analytics on Spark: votes, similarity joins, alignment, mergeable state."""
