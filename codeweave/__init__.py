"""codeweave: catalogue-code resolution and corpus preparation as Spark jobs."""
