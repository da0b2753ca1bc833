"""evenhand: auditing text scores for identity bias as Spark jobs."""
