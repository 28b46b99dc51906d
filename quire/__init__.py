"""quire: a Spark-first engine for cleaning, grading and preparing converted documents."""
