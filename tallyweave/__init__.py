"""tallyweave: label, signal and corpus analytics as Spark DataFrame jobs."""
