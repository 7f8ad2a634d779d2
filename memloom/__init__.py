"""memloom: a Spark engine for preparing and evaluating long-context question-answering corpora."""
