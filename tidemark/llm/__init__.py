"""Training-data operators: dedup, filters, extraction, decontamination, mixing.

Nothing outside this folder imports it; ``llm.queries`` holds the registered
queries, ``corpus_pipeline`` (repository top) chains five of the operators.
"""
